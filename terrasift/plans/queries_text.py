"""Registered queries over text functions: features, requests, contexts, values, SQL as text, addresses and settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions import text as X
from ..operators import execute, guard, requests
from ..shared import fresh_path
from ..sources import config, docs, jdbc
from ..streaming import events
from ..tables import load
from .registry import query


def _listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _words(c: str) -> str:
    """Trimmed values of a list column without blanks."""
    return f"list_filter(list_transform({c}, lambda v: trim(v)), lambda v: v <> '')"


def _unique(c: str) -> str:
    """Of values equal but for case the first."""
    return f"list_filter({c}, lambda v, i: list_position(list_transform({c}, lambda w: lower(w)), lower(v)) = i)"


def _joined(c, mark: str = "|"):
    return F.array_join(c, mark)


# Questions about parts: their type, brand and name are words, quoted spans and capitalised runs.
_asked = "'Find ' || p_name || ' near \"' || p_brand || '\" or Old ' || p_type || ', Hotel ' || p_size || CASE WHEN p_size % 2 = 0 THEN ' and hotels' ELSE '' END"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("p_size") % 2 == 0, F.lit(" and hotels")).otherwise(F.lit(""))
    text = F.concat(F.lit("Find "), "p_name", F.lit(' near "'), "p_brand", F.lit('" or Old '), "p_type", F.lit(", Hotel "), F.col("p_size").cast("string"), end)
    return load(spark, d, "part").select("p_partkey", "p_type", "p_size", text.alias("q"))


_entities = f"""
SELECT p_partkey, p_type, p_size, q, {_unique("list_concat(a, b)")} AS e FROM (
  SELECT *, list_transform(regexp_extract_all(q, '[''"“”]([^''"“”]{{2,120}})[''"“”]', 1), lambda x: trim(x)) AS a,
    list_filter(regexp_extract_all(q, '\\b([A-Z][\\w&''/-]*(?:\\s+[A-Z][\\w&''/-]*){{0,5}})\\b', 1), lambda r: NOT list_contains({_listed(X.QUESTION_WORDS)}, split_part(r, ' ', 1))) AS b
  FROM (SELECT p_partkey, p_type, p_size, {_asked} AS q FROM part))
"""


@query(f"SELECT p_partkey, array_to_string(e[1:5], '|') AS entities FROM ({_entities})")
def question_entities(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("p_partkey", _joined(X.entities(F.col("q"))).alias("entities"))


_none = "CAST([] AS VARCHAR[])"


@query(f"""
WITH e AS ({_entities}), f AS (SELECT *, list_filter({_listed(X.CATEGORIES)}, lambda c: regexp_matches(lower(q), '(^|[^a-z0-9_])' || c || 's?($|[^a-z0-9_])')) AS cats FROM e)
SELECT p_partkey, array_to_string(list_concat(string_split(q, ' ')[1:10], [p_type, 'v']), '|') AS keywords,
  'id|name|distance' || CASE WHEN len(cats) > 0 THEN '|category' ELSE '' END AS outputs,
  CASE WHEN len(cats) > 0 THEN 'fclass|category|type' ELSE '' END AS filters,
  CASE WHEN p_size % 3 = 0 THEN 'public' ELSE 's' || p_size END AS schemas,
  CAST(least(len(e), 1) * 2 + least(len(cats), 1) AS INTEGER) AS hints, CAST(8 AS INTEGER) AS max_tables, CAST(12 AS INTEGER) AS max_columns,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 's' || p_size END AS context_schema, p_type AS context_tables
FROM f
""")
def evidence_requests(spark: SparkSession, d: str) -> DataFrame:
    """Default evidence requests: words, tables and views, outputs, filters, schemas, hints, limits and the context."""
    schema = F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("s"), F.col("p_size").cast("string")))
    r = X.default_evidence(F.col("q"), schema, F.array("p_type"), F.array(F.lit("v")))
    found = _questions(spark, d).select("p_partkey", r.alias("r"))
    return found.select(
        "p_partkey",
        _joined("r.keywords").alias("keywords"),
        _joined("r.expected_outputs").alias("outputs"),
        _joined("r.likely_filters").alias("filters"),
        _joined("r.schema_whitelist").alias("schemas"),
        F.size("r.probe_hints").alias("hints"),
        F.col("r.max_tables").alias("max_tables"),
        F.col("r.max_columns_per_table").alias("max_columns"),
        F.col("r.runtime_context.schema_name").alias("context_schema"),
        _joined("r.runtime_context.table_list").alias("context_tables"),
    )


@query(f"""
SELECT event_id, array_to_string(list_concat({_listed(X.TOPICS)}, CASE WHEN event_type IN ('click', 'linear') THEN {_listed(X.NEAR_TOPICS)} ELSE {_listed(X.OTHER_TOPICS)} END), '|') AS topics,
  event_type = 'error' AS need_websearch, CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error_text
FROM events
""")
def knowledge_requests(spark: SparkSession, d: str) -> DataFrame:
    """Default knowledge requests; a word for nearness counts inside other words too."""
    kind = F.col("event_type")
    asked = F.when(kind == "click", F.lit("linear roads")).otherwise(F.lit("all roads"))
    error = F.when(kind == "error", F.concat(F.lit("failed "), F.col("event_id").cast("string")))
    r = load(spark, d, "events").select("event_id", X.default_knowledge(asked, error).alias("r"))
    return r.select("event_id", _joined("r.topics").alias("topics"), "r.need_websearch", "r.error_text")


@query(f"""
WITH v AS (SELECT p_partkey, [' ' || p_name || ' ', '', upper(p_name), p_brand, '  ', p_type, lower(p_brand)] AS w, p_size % 5 AS k FROM part)
SELECT p_partkey, array_to_string({_words("w")}, '|') AS listed, array_to_string({_unique(_words("w"))}, '|') AS once,
  k IN (0, 1, 2) AS truth, substr(w[3], 1, 6) AS preview,
  CASE k WHEN 0 THEN 'like' WHEN 1 THEN 'dislike' END AS mark,
  CASE k WHEN 0 THEN 'Spatialite' WHEN 1 THEN 'Postgis' WHEN 2 THEN 'Sedona' WHEN 3 THEN 'MySQL' END AS kind,
  CASE WHEN k < 3 THEN 'public|s' || k ELSE 's' || k || '|' || w[6] END AS schemas
FROM v
""")
def value_forms(spark: SparkSession, d: str) -> DataFrame:
    """Lists, truth values, previews, feedback marks, database types and schema lists."""
    k = F.col("p_size") % 5
    w = F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.lit(""), F.upper("p_name"), "p_brand", F.lit("  "), "p_type", F.lower("p_brand"))
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    name = F.concat(F.lit("s"), k.cast("string"))
    schemas = F.when(k < 3, F.concat(F.lit('["public", " '), name, F.lit('", "public", ""]'))).otherwise(F.concat(name, F.lit(", "), "p_type", F.lit(", ,"), name))
    return load(spark, d, "part").select(
        "p_partkey",
        _joined(X.string_list(w)).alias("listed"),
        _joined(X.distinct_words(w)).alias("once"),
        X.truthy(pick("1", " Yes ", "ON", "maybe", None)).alias("truth"),
        X.preview(F.upper("p_name"), 6).alias("preview"),
        X.feedback(pick(" Like", "DISLIKE ", "none", "", None)).alias("mark"),
        X.database_type(pick("SPATIALITE", "postgis", " Sedona", "mysql", None)).alias("kind"),
        _joined(X.schema_names(schemas)).alias("schemas"),
    )


@query("""
WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS s, c_custkey % 4 AS m FROM customer)
SELECT k, CASE WHEN m IN (1, 2) THEN k END AS chat_id, CASE WHEN m = 3 THEN 'old' WHEN m = 1 THEN s ELSE 'old' END AS schema_name,
  CASE m WHEN 1 THEN c_name || '|' || s WHEN 2 THEN '' ELSE 't1|t2' END AS tables, CASE WHEN m = 1 THEN 'POINT (1 2)' WHEN m = 2 THEN NULL ELSE 'g' END AS geometry
FROM c
""")
def context_forms(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of JSON text, sound, partial, invalid and blank, merged into one that is there already."""
    k, m = F.col("c_custkey"), F.col("c_custkey") % 4
    whole = F.to_json(F.struct(k.alias("chat_id"), F.concat(F.lit(" "), "c_mktsegment").alias("schema_name"), F.array("c_name", F.lit(" "), "c_mktsegment").alias("table_list"), F.lit("POINT (1 2)").alias("geometry")))
    part = F.concat(F.lit('{"chat_id": '), k.cast("string"), F.lit(', "schema_name": "  ", "table_list": null, "geometry": " "}'))
    raw = F.when(m == 1, whole).when(m == 2, part).when(m == 3, F.lit("not JSON"))
    old = X.context(F.lit('{"schema_name": "old", "table_list": ["t1", "t2"], "geometry": "g"}'))
    present = F.when(m.isin(1, 2), F.array(F.lit("table_list"), F.lit("geometry"))).otherwise(F.array().cast("array<string>"))
    out = load(spark, d, "customer").select(k.alias("k"), X.merged_context(old, X.context(raw), present).alias("c"))
    return out.select("k", "c.chat_id", "c.schema_name", _joined("c.table_list").alias("tables"), "c.geometry")


@query("SELECT conv_id, turn, role || chr(10) || text AS message FROM conversations")
def message_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks of messages; blocks of other types are left out."""
    block = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    blocks = F.array(block("text", F.col("role")), block("image", F.lit("x")), block("text", F.col("text")))
    return load(spark, d, "conversations").select("conv_id", "turn", X.message_text(blocks).alias("message"))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || '_' || n_nationkey AS vector_id,
  n_name || chr(10) || 'chapter ' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE chr(10) || 'A nation.' END || chr(10) || 'f' || n_nationkey || chr(10) || 'example' || chr(10) || 'How big?' || chr(10) || 'SELECT ' || n_nationkey AS document
FROM nation
""")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """A JSON list of function documents, written and read again: their place, key and text."""
    path, made = fresh_path(spark, "docs"), []
    for r in _nations(spark, d):
        k = r["n_nationkey"]
        steps = [{"question": "How big?", "sql": f"SELECT {k}"}]
        functions = [{"function_name": f"f{k}", "signature_str": None}]
        made.append({"function_id": r["n_name"], "chapter_info": f"chapter {r['n_regionkey']}", "description": "A nation." if k % 2 else "", "function_definitions": functions, "examples": [{"name": "example", "steps": steps}]})
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.text(path)
    return docs.read(spark, path).select("doc_id", "vector_id", "document")


# SQL as text. These are functions of single statements, so the few nations stand for them.


def _nations(spark: SparkSession, d: str) -> list:
    return load(spark, d, "nation").orderBy("n_nationkey").collect()


@query("""
SELECT n_nationkey AS k, '`' || n_name || '`' AS ident, '`s`.`t' || n_nationkey || '`' AS full_name, '"a""' || n_name || '"' AS quoted,
  '''O''''' || n_name || '''' AS text_literal, '(' || n_nationkey || ', ''' || n_name || ''', NULL, TRUE)' AS list_literal,
  'SELECT a::int, '':k'' FROM t WHERE k = ' || n_nationkey || ' AND n = ''' || n_name || ''' AND z = NULL' AS rendered
FROM nation
""")
def sql_forms(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers, qualified names, literals, and statements with their binds as literals."""
    out = []
    for r in _nations(spark, d):
        k, n = r["n_nationkey"], r["n_name"]
        sql = sqltext.render("SELECT a::int, ':k' FROM t WHERE k = :k AND n = :n AND z = :z", {"k": k, "n": n})
        out.append((k, sqltext.quoted(sqltext.identifier(f" {n} ")), sqltext.qualified(f"t{k}", "s"), sqltext.quoted(f'a"{n}', '"'), sqltext.literal(f"O'{n}"), sqltext.literal([k, n, None, True]), sql))
    return spark.createDataFrame(out, "k int, ident string, full_name string, quoted string, text_literal string, list_literal string, rendered string")


@query("""
SELECT n_nationkey AS k, 'SELECT ' || n_nationkey AS sql, n_nationkey % 2 = 0 AS is_sql, 'Here:' || chr(10) || chr(10) || n_name AS summary,
  CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'last' WHEN 2 THEN 'tag' ELSE NULL END AS found,
  n_name || '|' || 'x' AS once
FROM nation
""")
def answers_parsed(spark: SparkSession, d: str) -> DataFrame:
    """SQL, summaries and JSON objects out of models' answers; values without repeats."""
    out = []
    for r in _nations(spark, d):
        k, n = r["n_nationkey"], r["n_name"]
        fenced = f"Here:\n\n\n\n```sql\nSELECT {k}\n```\n{n}<structured_json>{{\"a\": 1}}</structured_json>"
        answer = [json.dumps({"v": n}), '```json\n{"v": "first"}\n```\n```\n{"v": "last"}\n```', 'text <structured_json>{"v": "tag"}</structured_json>', "nothing [1, 2]"][k % 4]
        found = sqltext.first_json(answer)
        begins = sqltext.looks_like_sql(" with a AS (SELECT 1) SELECT 2" if k % 2 == 0 else "selected rows")
        out.append((k, sqltext.sql_of(fenced), begins, sqltext.summary_of(fenced), found and found["v"], "|".join(sqltext.unique([n, f" {n.lower()} ", "", None, "x", "X"]))))
    return spark.createDataFrame(out, "k int, sql string, is_sql boolean, summary string, found string, once string")


@query("""
SELECT n_nationkey AS k, 'SELECT ''--' || n_name || ''' AS a ' || chr(10) || ' FROM t' AS bare,
  CASE WHEN n_nationkey % 5 IN (0, 1) THEN 'ok' ELSE 'ValueError' END AS strict, CASE WHEN n_nationkey % 5 IN (0, 1, 2) THEN 'ok' ELSE 'ValueError' END AS parsed
FROM nation
""")
def guarded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Comments stripped; statements that the text rules and the parse tree allow or reject."""

    def verdict(check) -> str:
        try:
            check()
        except ValueError:
            return "ValueError"
        return "ok"

    out = []
    for r in _nations(spark, d):
        k, n = r["n_nationkey"], r["n_name"]
        sql = [f"SELECT '{n}' AS a", f"/* x */ WITH a AS (SELECT 1 AS last_update) SELECT * FROM a -- {n}", f"SELECT 'drop {n}' AS a", f"DROP TABLE {n}", " ; "][k % 5]
        bare = guard.without_comments(f"SELECT '--{n}' AS a -- {n}\n/* a /* b */ c */ FROM t")
        out.append((k, bare, verdict(lambda sql=sql: guard.read_only_text(sql)), verdict(lambda sql=sql: guard.read_only(spark, sql))))
    return spark.createDataFrame(out, "k int, bare string, strict string, parsed string")


@query("""
SELECT n_nationkey AS k, greatest(1, n_nationkey - 3) AS page, least(500, greatest(1, n_nationkey * 40 - 20)) AS size, CAST(ceil(n_nationkey * 7 / 5.0) AS INTEGER) AS pages,
  CASE WHEN n_nationkey = 0 THEN 'ValueError' ELSE 'ok' END AS question, CASE WHEN n_nationkey > 20 OR n_nationkey = 0 THEN 'ValueError' ELSE 'ok' END AS execution, (SELECT count(*) FROM nation) - n_nationkey AS sessions
FROM nation
""")
def request_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Pages clamped and counted, requests within bounds, and sessions that are open."""

    def verdict(make) -> str:
        try:
            make()
        except ValueError:
            return "ValueError"
        return "ok"

    held, nations, out = requests.Sessions(), _nations(spark, d), []
    keys = [held.open({"id": r["n_nationkey"]}) for r in nations]
    for r in nations:
        k = r["n_nationkey"]
        page, size = execute.clamp_page(k - 3, k * 40 - 20)
        asked = verdict(lambda k=k: requests.Question(k, "q" * (20_000 if k else 20_001)))
        run = verdict(lambda k=k: requests.Execution("SELECT 1", page=k, page_size=25 * k))
        out.append((k, page, size, execute.page_count(7 * k, 5), asked, run, held.count()))
        held.close(keys[k])
    return spark.createDataFrame(out, "k int, page int, size int, pages int, question string, execution string, sessions long")


@query("""
SELECT n_nationkey AS k, 'postgresql+psycopg2://u%40' || n_name || ':p+w@h' || n_nationkey || ':5432/d?ssl=1' AS client, 'jdbc:postgresql://h' || n_nationkey || ':5432/d?ssl=1' AS url, 'u@' || n_name AS username,
  CASE WHEN n_nationkey % 3 = 0 THEN 'jdbc:mysql://h/d?user=' || n_name || '&password=x%261' ELSE 'jdbc:mysql://h/d' END AS patched,
  CASE WHEN n_nationkey % 2 = 0 THEN 'sqlite://' ELSE 'sqlite:////data/' || n_name || '.db' END AS file, 'jdbc:mysql://h:3306/d?user=' || n_name || '&password=a+b%26c' AS built
FROM nation
""")
def jdbc_addresses(spark: SparkSession, d: str) -> DataFrame:
    """JDBC addresses read, patched with credentials, and built."""
    out = []
    for r in _nations(spark, d):
        k, n = r["n_nationkey"], r["n_name"]
        a = jdbc.parse(f"jdbc:postgresql://h{k}:5432/d?user=u%40{n}&password=p%20w&ssl=1")
        options = a.reader_options()
        patched = jdbc.with_credentials("jdbc:mysql://h/d", ["mysql", "spatialite", "postgis"][k % 3], n if k % 3 != 2 else " ", "x&1")
        file = jdbc.parse("jdbc:sqlite::memory:" if k % 2 == 0 else f"jdbc:sqlite:/data/{n}.db").client_url()
        out.append((k, a.client_url(), options["url"], options["user"], patched, file, jdbc.build("mysql", "h", 3306, "d", n, "a b&c")))
    return spark.createDataFrame(out, "k int, client string, url string, username string, patched string, file string, built string")


@query("SELECT n_nationkey AS k, n_name AS held, 'none' AS missing, n_nationkey % 2 = 1 AS complete FROM nation")
def settings_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Settings of text, by dotted path with a default, and whether required ones are there."""
    out = []
    for r in _nations(spark, d):
        k, n = r["n_nationkey"], r["n_name"]
        s = config.load(json.dumps({"a": {"b": {"name": n}, "c": "x" if k % 2 else ""}}))
        try:
            config.required(s, ["a.b.name", "a.c"])
            complete = True
        except ValueError:
            complete = False
        out.append((k, config.get(s, "a.b.name"), config.get(s, "a.x.y", "none"), complete))
    return spark.createDataFrame(out, "k int, held string, missing string, complete boolean")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at, CASE event_type WHEN 'error' THEN 'error' ELSE 'progress' END AS kind, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'r' || user_id END AS request_id,
  'event: ' || CASE event_type WHEN 'error' THEN 'error' ELSE 'progress' END || chr(10) || 'data: {"type":"' || CASE event_type WHEN 'error' THEN 'error' ELSE 'progress' END || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","request_id":"' || CASE WHEN event_id % 2 = 0 THEN '' ELSE 'r' || user_id END || '","payload":"' || event_type || '"}' || chr(10) || chr(10) AS sent
FROM events
""")
def event_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Progress events in their envelope, and as server-sent events."""
    kind = F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("progress"))
    request = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("r"), F.col("user_id").cast("string")))
    made = load(spark, d, "events").select("event_id", events.envelope(kind, F.col("event_type"), F.col("ts"), request).alias("e"))
    return made.select("event_id", F.col("e.timestamp").alias("at"), F.col("e.type").alias("kind"), F.col("e.request_id").alias("request_id"), events.sse(F.col("e.type"), F.col("e")).alias("sent"))
