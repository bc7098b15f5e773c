"""Retrieval, catalog, entities, questions and streams."""

import pytest
from pyspark.sql import functions as F

from terrasift.operators import catalog, history
from terrasift.operators.store import Store, orphans, positive_id, users_with_links
from terrasift.plans import nl, search
from terrasift.streaming import events
from terrasift.tables import load


def test_keyword_search(spark, tmp_path):
    docs = spark.createDataFrame([(0, "near park"), (1, "Debugging the address standardizer: debug_standardize_address"), (2, "")], "doc_id long, document string")
    index = search.KeywordIndex.build(docs)
    assert [(r["doc_id"], r["score"]) for r in index.search("near near").collect()] == [(0, 2)]
    index.save(str(tmp_path / "i"))
    again = search.KeywordIndex.load(spark, str(tmp_path / "i"))
    assert again.search("debugging address standardizer", 5).first()["doc_id"] == 1 and again.search("").count() == 0
    index.to_json(str(tmp_path / "j"), "s")
    assert search.KeywordIndex.from_json(spark, str(tmp_path / "j")).search("park").first()["document"] == "near park"
    assert tuple(index.counts().first()) == (3, 7)


def test_request_ids_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(history, "STRETCH", 3)
    asked = {1, 2, 9}
    df = spark.range(0, 14).select(F.lit(5).alias("c"), F.col("id").alias("turn")).unionByName(spark.createDataFrame([(6, 4)], "c int, turn long"))
    got = {(r["c"], r["turn"]): r["request_id"] for r in history.request_ids(df, "c", "turn", F.col("turn").isin(*asked) & (F.col("c") == 5)).collect()}
    assert got == {(5, t): max((a for a in asked if a <= t), default=None) for t in range(14)} | {(6, 4): None}


def test_vectors(spark, small):
    v = load(spark, small, "embeddings")
    one = v.filter("vec_id = 9").first()["embedding"]
    assert search.neighbours(v, list(one), 1, "vec_id").first()["vec_id"] == 9


def test_hybrid_order(spark):
    v = spark.createDataFrame([("c", "v", 0.1), ("d", "v", 0.5), ("a", "", 0.9)], "key string, document string, distance double")
    k = spark.createDataFrame([("a", "k", 2), ("b", "k", 1)], "key string, document string, score long")
    rows = search.merged(v, k, 8).collect()
    assert [r["key"] for r in rows] == ["a", "b", "c", "d"] and rows[0]["document"] == "k"
    assert spark.range(1).select(search.function_key(F.lit("st_x_12"))).first()[0] == "st_x"
    with pytest.raises(ValueError):
        search.page_search(v, " ")


def test_catalog(spark, small):
    own = spark.newSession()
    load(own, small, "nation").createOrReplaceTempView("cat_nation")
    load(own, small, "region").createOrReplaceTempView("cat_region")
    assert catalog.object_columns(own, "cat_region") == [("r_regionkey", "int"), ("r_name", "string")]
    assert catalog.ddl(own, "cat_region").endswith(";") and catalog.estimated_rows(own, "cat_region") == (5, "count")
    with pytest.raises(LookupError):
        catalog.object_type(own, "nothing_here")
    with pytest.raises(ValueError):
        catalog.ddl(own, "x; DROP")
    keys = catalog.declare_keys(own, [(None, "cat_nation", "fk", ["n_regionkey"], "cat_region", ["r_regionkey"])])
    rows = {r["table"]: r for r in catalog.introspect(own, keys=keys).collect()}
    assert rows["cat_nation"]["keys"][0]["kind"] == "fk" and len(rows["cat_region"]["columns"]) == 2
    options = catalog.join_options(own, {"n": load(own, small, "nation"), "r": load(own, small, "region")}, {"r": "r_regionkey"}).collect()
    assert [(o["column"], o["cardinality"]) for o in options] == [("n_regionkey", "many-to-one")]
    assert catalog.category_profile(own.createDataFrame([(None,), ("a",), ("a",)], "c string"), "c").first()["freq"] == 2


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    u = s.insert("users", username=" ann ", password="x1", role="User", status="active")
    with pytest.raises(ValueError):
        s.insert("users", username="ann", password="y", role="user", status="active")
    with pytest.raises(ValueError):
        s.insert("users", username="bob", password="y", role="king", status="active")
    link = s.insert("database_links", user_id=u, name="db", type="postgis", url="jdbc:postgresql://h/d")
    with pytest.raises(LookupError):
        s.insert("chat_sessions", user_id=99)
    chat = s.insert("chat_sessions", user_id=u)
    q = s.insert("chat_history", chat_id=chat, role="user", content="hi")
    assert s.get("chat_history", q)["request_id"] == q
    s.log_execution(user_id=u, chat_id=chat, database_id=link, execute_status="success", sql_text="SELECT 1", execution_time_ms=5, row_count=1)
    assert s.log_execution(user_id=u, execute_status="odd", sql_text="x", execution_time_ms=5, row_count=1) is None
    assert users_with_links(s.table("users"), s.table("database_links")).first()["links"][0]["name"] == "db"
    assert "password" not in s.public("users").columns and s.login("ann", "x1")["last_login"] and s.login("ann", "no") is None
    s.delete("database_links", link)
    assert s.table("sql_execution_logs").first()["database_id"] is None
    s.update("users", u, status="disabled")
    assert s.login("ann", "x1") is None
    assert orphans(s.table("chat_history"), "chat_id", s.table("chat_sessions").withColumnRenamed("id", "cid"), "cid").count() == 0
    s.delete("users", u)
    assert s.table("chat_history").count() == 0 and s.table("sql_execution_logs").count() == 0
    assert positive_id("7") == 7
    with pytest.raises(ValueError):
        positive_id("0")


def places(spark):
    own = spark.newSession()
    own.createDataFrame([(1, "Blue Lake", "lake", 0.0, 0.0), (2, "Inn", "hotel", 3.0, 4.0), (3, "Lodge", "hotel", 30.0, 40.0), (4, "Cup", "cafe", 1.0, 0.0)], "id long, name string, fclass string, x double, y double").createOrReplaceTempView("places")
    return own, [nl.Layer("places", "id", "name", "x", "y", "fclass")]


@pytest.mark.parametrize(("question", "rows"), [("Find the nearest hotel to Blue Lake", [(2, 5.0)]), ("Show hotels within 100 of 'Blue Lake'", [(2, 5.0), (3, 50.0)])])
def test_questions(spark, question, rows):
    own, layers = places(spark)
    seen = []
    a = nl.answer(own, question, nl.rule_planner(own), nl.rule_evidence(own, layers), nl.rule_builder(layers), emit=lambda k, p: seen.append(k))
    assert [(r["id"], r["distance"]) for r in a.result.rows] == rows and seen[0] == "start" and seen[-1] == "end" and seen.count("end") == 1
    assert ":x" not in a.sql and own.sql(a.sql).count() == len(rows)
    assert nl.traces(own, a.rounds).first()["verdict"] == "PASS"


def test_questions_without_answer(spark):
    own, layers = places(spark)
    a = nl.answer(own, "Find the nearest hotel", nl.rule_planner(own), nl.rule_evidence(own, layers), nl.rule_builder(layers))
    assert a.sql is None and len(a.rounds) == 3 and "start from" in a.text
    assert own.sql(nl.answer(own, "How many cafes are there", nl.rule_planner(own), nl.rule_evidence(own, layers), nl.rule_builder(layers)).sql).first()[0] == 1
    assert nl.step_order({"fanout_order": ["kb"]}) == ["knowledge", "db_context"] and nl.step_order({"execution_order": ["x"]}) == list(nl.STEPS)
    bad = nl.answer(own, "nearest", nl.rule_planner(own), nl.rule_evidence(own, layers), lambda *a: nl.Draft("SELECT * FROM no_such LIMIT 1", {}, "list"), lambda *a: nl.Review("PASS"), max_rounds=1)
    assert bad.sql is None  # what a reviewer says does not count if the draft fails


def test_deltas():
    def run(texts):
        state, out = ("", "unknown"), []
        for t in texts:
            d, *state = events.step(*state, t)
            out.append(d)
        return out

    assert run(["a", "ab", "ab", "abc"]) == ["a", "b", "", "c"] and run(["ab", "cd"]) == ["ab", "cd"]
    assert run(["abc", "ab", "abcd"]) == ["abc", "", "d"] and run(["", "a", "a"]) == ["", "a", ""]


def stream(spark, tmp_path, rows, schema, op, keys):
    src = str(tmp_path / "src")
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = op(df).writeStream.format("memory").queryName("out_" + tmp_path.name.replace("-", "_")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(q.name).orderBy(*keys).collect()


def test_stream_deltas(spark, tmp_path):
    parts = [[("s", 1, "a"), ("s", 2, "ab"), ("t", 1, "x")], [("s", 3, "abc"), ("t", 2, "yz")]]
    got = stream(spark, tmp_path, parts, "stream_id string, seq long, text string", events.stream_deltas, ["stream_id", "seq"])
    assert [tuple(r) for r in got] == [("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c"), ("t", 1, "x"), ("t", 2, "yz")]


def test_stream_buffers(spark, tmp_path):
    parts = [[("s", 1, "a", False)], [("s", 2, "b", False), ("s", 3, "", True), ("t", 1, "x", False)]]
    got = stream(spark, tmp_path, parts, "stream_id string, seq long, delta string, is_end boolean", events.stream_buffers, ["stream_id"])
    assert [tuple(r) for r in got] == [("s", "ab")]


def test_stream_windows(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    got = stream(spark, tmp_path, [[(t(1), "a"), (t(2), "a")], [(t(40), "a")], [(t(59), "b")]], "ts timestamp, k string", lambda df: events.tumbling(df, "ts", "10 minutes", ["k"], late="5 minutes"), ["window_start"])
    assert [(r["k"], r["n"]) for r in got][:1] == [("a", 2)]


def test_events(spark):
    row = spark.range(1).select(events.sse(F.lit("end"), F.struct(F.lit(1).alias("a"))).alias("s"), events.envelope(F.lit("start"), F.lit("p"), F.lit("2024-01-01").cast("timestamp"), F.lit(None).cast("string")).alias("e")).first()
    assert row["s"] == 'event: end\ndata: {"a":1}\n\n' and row["e"]["request_id"] == "" and row["e"]["timestamp"] == "2024-01-01T00:00:00.000000"
    df = spark.createDataFrame([("r", 1, "start"), ("r", 2, "end"), ("r", 3, "end"), ("q", 1, "start")], "request_id string, seq long, kind string")
    assert events.until_end(df).count() == 3
    assert history.last_turns(df, "request_id", "seq", 1).count() == 2


def test_nearest_plan_keeps_few_rows(spark, small):
    """Neighbours of many queries against a plain sort, ties by id, vectors of another length and null ones left out."""
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(60)] + [(100, [1.0]), (101, None)]
    v = spark.createDataFrame(rows, "i long, v array<double>").repartition(5)
    got = {(r["query_id"], r["neighbour_id"], r["rank"]) for r in search.neighbours_of(v.filter("i % 11 = 0"), v, 4, "i", "i", "v", "v").collect()}
    whole = dict(rows[:60])
    want = set()
    for q in range(0, 60, 11):
        order = sorted(whole, key=lambda i: (sum((a - b) ** 2 for a, b in zip(whole[i], whole[q], strict=True)), i))
        want |= {(q, i, k) for k, i in enumerate(order[:4], 1)}
    assert got == want
    assert search.neighbours_of(v.filter("false"), v, 4, "i", "i", "v", "v").count() == 0


def test_store_in_batches(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    user = {"password": "x", "role": "user", "status": "active"}
    assert s.insert_many("users", [user | {"username": f"u{i}"} for i in range(5)]) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        s.insert_many("users", [user | {"username": "a"}, user | {"username": "a"}])
    assert s.insert_many("users", []) == [] and s.table("users").count() == 5
    s.delete("users", 5)
    s.compact("users")
    assert s.insert("users", **user, username="later") == 6  # deleted ids stay taken
    assert sorted(r["id"] for r in s.table("users").collect()) == [1, 2, 3, 4, 6]


def test_shared_tables_are_removed(spark):
    import os

    from terrasift import shared

    with shared.tables_of_run(spark) as kept:
        paths = [shared.fresh_path(spark, "t") for _ in range(2)]
        for p in paths:
            spark.range(3).write.parquet(p)
        kept.append(paths[0])
    assert [os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in paths] == [True, False]
    shared.remove(spark, paths[0], paths[0])
