"""Registered queries over entities, versioned scripts and stored indexes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import qualified
from ..operators import migrate, store
from ..shared import fresh_path
from ..sources import docs
from ..tables import load
from . import search
from .registry import query


def _verdict(call) -> str:
    try:
        call()
    except (ValueError, LookupError) as e:
        return type(e).__name__
    return "ok"


def _people(spark: SparkSession, d: str) -> store.Store:
    """A store whose users are the nations, each with a link."""
    s = store.Store(spark, fresh_path(spark, "store"))
    nations = load(spark, d, "nation").orderBy("n_nationkey").collect()
    s.insert_many("users", [{"username": f" {r['n_name']} ", "password": f"p{r['n_nationkey']}", "role": "ADMIN" if r["n_regionkey"] == 0 else "user", "status": "Active"} for r in nations])
    s.insert_many("database_links", [{"user_id": r["n_regionkey"] + 1, "name": f"db {r['n_name']}", "type": "postgis", "url": f"jdbc:postgresql://h/{r['n_nationkey']}", "schemas": ["public"]} for r in nations])
    return s


@query("""
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS username, CASE WHEN n_regionkey = 0 THEN 'admin' ELSE 'user' END AS role,
  CASE WHEN n_nationkey = 3 THEN 'disabled' ELSE 'active' END AS status, 'username,role,status' AS shown
FROM nation WHERE n_nationkey <> 5
""")
def entity_rows(spark: SparkSession, d: str) -> DataFrame:
    """Users inserted, one updated, one deleted; the public columns in order of their ids."""
    s = _people(spark, d)
    s.update("users", 4, status="DISABLED")
    s.delete("users", 6)
    rows = s.public("users").orderBy("id")
    shown = ",".join(c for c in rows.columns if c in ("username", "password", "role", "status"))
    return rows.select("id", "username", "role", "status", F.lit(shown).alias("shown"))


@query("""
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS user_id, 'db ' || n_name AS name, 'Postgis' AS type FROM nation WHERE n_regionkey <> 2
""")
def entity_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A deleted user's links go too; the rest stay, also when the log is compacted."""
    s = _people(spark, d)
    s.delete("users", 3)
    s.compact("database_links")
    return s.public("database_links").select("id", "user_id", "name", "type").orderBy("id")


@query("""
SELECT n_nationkey AS k,
  CASE n_nationkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'ValueError' WHEN 4 THEN 'LookupError' ELSE 'ValueError' END AS verdict,
  CASE WHEN n_nationkey % 3 = 0 THEN 'ValueError' ELSE 'ok' END AS id_verdict
FROM nation
""")
def entity_checks(spark: SparkSession, d: str) -> DataFrame:
    """What inserts check: blank and repeated values, values of no kind, references that find nothing, missing columns; ids."""
    s, out = _people(spark, d), []
    for r in load(spark, d, "nation").orderBy("n_nationkey").collect():
        k, n = r["n_nationkey"], r["n_name"]
        user = {"username": f"new {n}", "password": "x", "role": "user", "status": "active"}
        values = [user, user | {"username": " "}, user | {"role": "king"}, user | {"username": n}, {"user_id": 999}, {"username": "y"}][k % 6]
        name = "chat_sessions" if k % 6 == 4 else "users"
        found = _verdict(lambda name=name, values=values: s.insert(name, **values))
        out.append((k, found, _verdict(lambda k=k: store.positive_id([0, str(k), f" {k} "][k % 3]))))
    return spark.createDataFrame(out, "k int, verdict string, id_verdict string")


@query("""
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS chat_id, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 1 AS BIGINT) END AS request_id,
  CASE WHEN n_nationkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 'About ' || n_name AS content
FROM nation
""")
def chat_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chats and their messages; a question is its own request."""
    s = _people(spark, d)
    s.insert_many("chat_sessions", [{"user_id": r["r_regionkey"] + 1} for r in load(spark, d, "region").orderBy("r_regionkey").collect()])
    said = load(spark, d, "nation").orderBy("n_nationkey").collect()
    s.insert_many("chat_history", [{"chat_id": r["n_regionkey"] + 1, "role": "assistant" if r["n_nationkey"] % 2 else "USER", "content": f" About {r['n_name']}"} for r in said])
    return s.table("chat_history").select("id", "chat_id", "request_id", "role", "content").orderBy("id")


@query("""
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS user_id, CASE WHEN n_nationkey % 3 = 0 THEN 'failure' ELSE 'success' END AS execute_status,
  CAST(n_nationkey * 5 AS BIGINT) AS ms, CASE WHEN n_regionkey = 1 THEN NULL ELSE CAST(n_regionkey + 1 AS BIGINT) END AS database_id
FROM nation
""")
def execution_rows(spark: SparkSession, d: str) -> DataFrame:
    """The execution log of guarded statements: a row that does not check is not the caller's failure, and a link that is
    deleted leaves its rows."""
    s = _people(spark, d)
    rows = load(spark, d, "nation").orderBy("n_nationkey").collect()
    s.insert_many("sql_execution_logs", [{"user_id": r["n_regionkey"] + 1, "database_id": r["n_regionkey"] + 1, "execute_status": "failure" if r["n_nationkey"] % 3 == 0 else "SUCCESS", "sql_text": "SELECT 1", "execution_time_ms": 5 * r["n_nationkey"], "row_count": 1} for r in rows])
    assert s.log_execution(user_id=1, execute_status="odd", sql_text="x", execution_time_ms=1, row_count=1) is None
    s.delete("database_links", 2)
    return s.table("sql_execution_logs").select("id", "user_id", "execute_status", F.col("execution_time_ms").alias("ms"), "database_id").orderBy("id")


@query("""
SELECT r_regionkey, r_name, CASE WHEN r_regionkey = 1 THEN 'seeded' ELSE 'there' END AS came, (SELECT count(*) FROM region) AS n FROM region
""")
def seeded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Seed rows are inserted where their key has no equal yet, as often as they come."""
    s = store.Store(spark, fresh_path(spark, "store"))
    regions = load(spark, d, "region").orderBy("r_regionkey").collect()
    user = lambda r, word: {"username": r["r_name"], "password": word, "role": "user", "status": "active"}
    s.insert_many("users", [user(r, "there") for r in regions if r["r_regionkey"] != 1])
    s.insert_missing("users", "username", [user(r, "seeded") for r in regions])
    again = s.insert_missing("users", "username", [user(r, "again") for r in regions])
    held = s.table("users").select("username", F.col("password").alias("came"))
    total = held.agg((F.count(F.lit(1)) + again).alias("n"))
    return load(spark, d, "region").join(held, F.col("r_name") == F.col("username")).select("r_regionkey", "r_name", "came").crossJoin(F.broadcast(total))  # one row


@query("""
SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS known, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_regionkey = 0 THEN 'admin' ELSE 'user' END END AS role,
  n_nationkey % 2 = 0 AS login FROM nation
""")
def entity_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Rows by id and owner, and users by name and password."""
    s, out = _people(spark, d), []
    for r in load(spark, d, "nation").orderBy("n_nationkey").collect():
        k = r["n_nationkey"]
        row = s.get("users", k + 1 if k % 2 == 0 else 1000 + k)
        out.append((k, row is not None, row and row["role"], s.login(r["n_name"], f"p{k}" if k % 2 == 0 else "wrong") is not None))
    return spark.createDataFrame(out, "k int, known boolean, role string, login boolean")


_scripts = {
    "V1__first.sql": "CREATE TABLE {t}_a (k INT, v STRING) USING parquet; -- not; a statement\nINSERT INTO {t}_a VALUES (1, 'a;b')",
    "V1_10__later.sql": "INSERT INTO {t}_a VALUES (3, 'it''s')",
    "V1_2__second.sql": "/* one; */ INSERT INTO {t}_a VALUES (2, 'x')",
    "notes.sql": "DROP TABLE {t}_a",
}


@query("SELECT * FROM (VALUES (1, 'a;b', 'V1__first.sql'), (2, 'x', 'V1_2__second.sql'), (3, 'it''s', 'V1_10__later.sql')) t(k, v, script)")
def scripts_applied(spark: SparkSession, d: str) -> DataFrame:
    """Versioned scripts run once, in order of their versions, statement by statement; other files are not scripts."""
    folder = fresh_path(spark, "scripts")
    table = "m_" + folder.rsplit("-", 1)[1]
    files = {name: text.format(t=table) for name, text in _scripts.items()}
    done = migrate.run(spark, files, folder) + migrate.run(spark, files, folder)
    rows = spark.table(qualified(f"{table}_a")).orderBy("k").collect()
    spark.sql(f"DROP TABLE {qualified(f'{table}_a')}")
    return spark.createDataFrame([(r["k"], r["v"], name) for r, name in zip(rows, done, strict=True)], "k int, v string, script string")


@query("""
SELECT n_nationkey AS k, sha256('INSERT INTO t VALUES (' || n_nationkey || ')') AS checksum, n_nationkey >= 10 AS pending, n_nationkey % 4 = 0 AND n_nationkey < 10 AS changed FROM nation
""")
def scripts_compared(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of scripts, which are still to run, and which are another text now."""
    keys = [r["n_nationkey"] for r in load(spark, d, "nation").orderBy("n_nationkey").collect()]
    found = migrate.scripts({f"V{k}__n.sql": f"INSERT INTO t VALUES ({k})" for k in keys} | {"V__x.sql": "", "v1__y.sql": ""})
    mine = spark.createDataFrame([(s.version, s.name, s.checksum) for s in found], "version string, script_name string, checksum string")
    now = dt.datetime(2024, 1, 1)
    applied = spark.createDataFrame([(s.version, s.name, "other" if int(s.version) % 4 == 0 else s.checksum, now) for s in found if int(s.version) < 10], migrate.APPLIED)
    marks = lambda df, name: df.select("version", F.lit(True).alias(name))
    out = mine.join(marks(migrate.pending(mine, applied), "pending"), "version", "left").join(marks(migrate.changed(mine, applied), "changed"), "version", "left")
    no = F.lit(False)
    return out.select(F.col("version").cast("int").alias("k"), "checksum", F.coalesce("pending", no).alias("pending"), F.coalesce("changed", no).alias("changed"))


_tokens = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda t: length(t) >= 2))"


@query(f"""
SELECT doc_id, CAST(2 * list_contains(w, 'the')::INT + list_contains(w, 'and')::INT AS BIGINT) AS score, sha256(text) AS digest
FROM (SELECT doc_id, text, {_tokens} AS w
FROM documents)
WHERE list_contains(w, 'the') OR list_contains(w, 'and')
ORDER BY score DESC, doc_id LIMIT 15
""")
def keyword_index_saved(spark: SparkSession, d: str) -> DataFrame:
    """A keyword index saved as Parquet by buckets of tokens, loaded and searched; a step with content is not done again."""
    folder = fresh_path(spark, "index")
    if not docs.has_content(spark, folder):
        search.KeywordIndex.build(load(spark, d, "documents").select("doc_id", "text"), text_col="text").save(folder)
    assert docs.has_content(spark, folder)
    found = search.KeywordIndex.load(spark, folder).search("the and THE", 15)
    return found.select("doc_id", "score", F.sha2("document", 256).alias("digest"))


@query("""
SELECT n_nationkey AS doc_id, CAST(1 AS BIGINT) AS score, n_name || chr(10) || 'nation of ' || n_regionkey AS document
FROM nation
WHERE n_regionkey = 2
ORDER BY doc_id LIMIT 3
""")
def keyword_index_recovered(spark: SparkSession, d: str) -> DataFrame:
    """A JSON index without texts takes them from the documents that it was made of."""
    source, folder = fresh_path(spark, "docs"), fresh_path(spark, "index")
    listed = F.struct(F.col("n_name").alias("function_id"), F.concat(F.lit("nation of "), F.col("n_regionkey").cast("string")).alias("description"), "n_nationkey")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", listed.alias("doc")))), lambda x: x["doc"])
    load(spark, d, "nation").agg(F.to_json(ordered).alias("value")).coalesce(1).write.text(source)
    made = docs.read(spark, source)
    words = made.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("document"), r"\W+"))).alias("token"))
    lists = words.groupBy("token").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    tokens = lists.agg(F.map_from_entries(F.collect_list(F.struct("token", "ids"))).alias("token_to_docs"))
    places = made.agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: F.create_map(F.lit("doc_id"), i.cast("string"))).alias("docs"))
    tokens.crossJoin(places).select(F.lit(source).alias("doc_source"), "token_to_docs", "docs").coalesce(1).write.json(folder)
    region = load(spark, d, "nation").filter("n_regionkey = 2").agg(F.concat_ws(" ", F.collect_list("n_name"))).first()[0]
    found = search.KeywordIndex.from_json(spark, folder).search(region, 3)
    return found.select(F.col("doc_id").cast("int").alias("doc_id"), "score", "document")


@query("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id = 11 THEN (SELECT embedding FROM embeddings WHERE vec_id = 7) ELSE embedding END AS embedding FROM embeddings),
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7),
s AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)) * (CAST(v.embedding[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)))) AS distance FROM v, q)
SELECT 'v' || vec_id AS id, CASE WHEN vec_id = 11 THEN 'again' ELSE 'document ' || vec_id END AS document, CASE WHEN vec_id = 11 THEN '{}' ELSE '{"label":"x"}' END AS metadata, round(distance, 6) AS distance, (SELECT count(*) FROM embeddings) AS held
FROM s ORDER BY distance, id LIMIT 6
""")
def vector_store_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors inserted with their documents and metadata, one of them again; the nearest of one."""
    s = search.VectorStore(spark, fresh_path(spark, "vectors"))
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    rows = load(spark, d, "embeddings").select(name.alias("id"), F.concat(F.lit("document "), F.col("vec_id").cast("string")).alias("document"), "embedding", F.create_map(F.lit("label"), F.lit("x")).alias("metadata"))
    asked = list(rows.filter("id = 'v7'").first()["embedding"])
    s.insert(rows, metadata_col="metadata")
    s.insert(spark.createDataFrame([("v11", "again", asked)], "id string, document string, embedding array<float>"))
    return s.search(asked, 6).withColumn("distance", F.round("distance", 6)).withColumn("held", F.lit(s.count()).cast("long"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'ok' ELSE 'ValueError' END AS verdict FROM nation")
def vector_store_checks(spark: SparkSession, d: str) -> DataFrame:
    """What inserts of vectors check: missing embeddings, other lengths, missing and repeated ids."""
    s, out = search.VectorStore(spark, fresh_path(spark, "vectors")), []
    for k in [r["n_nationkey"] for r in load(spark, d, "nation").orderBy("n_nationkey").collect()]:
        rows = [[(f"n{k}", [1.0, 2.0])], [("a", None)], [("a", [1.0])], [(None, [1.0, 2.0])], [("a", [1.0, 2.0]), ("a", [1.0, 3.0])]][k % 5]
        df = spark.createDataFrame([(i, "text", e) for i, e in rows], "id string, document string, embedding array<float>")
        out.append((k, _verdict(lambda df=df: s.insert(df))))
    return spark.createDataFrame(out, "k int, verdict string")
