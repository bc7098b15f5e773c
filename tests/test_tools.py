import pytest
from pyspark.sql import functions as F

from terrasift.functions.vectors import HashingEmbedder, embedder_udf
from terrasift.operators.requests import Execution, Question, Sessions, changes
from terrasift.plans import search
from terrasift.plans.tools import Toolkit, called_by
from terrasift.tables import load


@pytest.fixture(scope="module")
def kit(spark):
    own = spark.newSession()
    load(own, "/root/testdata/sf0.001", "nation").createOrReplaceTempView("tool_nation")
    docs = own.createDataFrame([(0, "st_buffer", "buffer around a shape"), (1, "st_area", "area of a shape")], "doc_id long, function_id string, document string")
    vectors = docs.select(F.concat_ws("_", "function_id", "doc_id").alias("id"), "document", embedder_udf(HashingEmbedder())("document").alias("embedding"))
    seen = []
    k = Toolkit(own, search.KeywordIndex.build(docs), vectors, load(own, "/root/testdata/sf0.001", "pages"), emit=lambda kind, p: seen.append((kind, p)))
    k.seen = seen
    return k


def test_tools(kit):
    assert kit.call("top_distinct", table="tool_nation", column="n_regionkey", k=2)["values"][0]["freq"] == 5
    assert kit.call("estimate_rows", table="tool_nation")["rows"] == 25
    assert kit.call("execute", sql="SELECT count(*) AS n FROM tool_nation")["rows"] == [{"n": 25}]
    assert kit.call("keyword_search", query="area")["hits"][0]["doc_id"] == 1
    assert kit.call("vector_search", query="area of a shape", k=1)["hits"][0]["id"] == "st_area_1"
    merged = kit.call("search", query="area of a shape", k=1)
    assert merged["hits"][0]["key"] == "st_area" and kit.call("search", query="area of a shape", k=2, merge=False)["count"] >= merged["count"]
    assert kit.call("pages", query="the", top_k=3)["ok"] and kit.call("explain", sql="SELECT 1")["plan"]
    assert any(t["table"] == "tool_nation" for t in kit.call("introspect")["tables"])
    assert kit.call("execute", sql="DROP TABLE x")["status"] == "ERROR" and not kit.call("explain", sql="DROP TABLE x")["ok"] and not kit.call("none")["ok"]


def test_events_and_roles(kit):
    kit.seen.clear()
    with called_by(kit.spark, "db_context", 2, "evidence"):
        kit.of("db_context")["execute"](sql="SELECT 1 AS a")
    (a, first), (b, last) = kit.seen
    assert (a, b) == ("start", "end") and first["call_id"] == last["call_id"] and (last["agent"], last["round"]) == ("db_context", 2)
    kit.call("none")
    assert kit.seen[-1][0] == "error" and "agent" not in kit.seen[-1][1]
    assert set(kit.of("knowledge")) == {"search", "pages"} and not kit.of("orchestrator")


def test_requests():
    assert Question("3", " hi ").query == "hi" and Execution("SELECT 1", 2, 500).page == 2
    for bad in (lambda: Question(0, "x"), lambda: Question(1, ""), lambda: Question(1, "x", database_id=2), lambda: Execution("x" * 200_001), lambda: Execution("x", 1, 501), lambda: changes(a=None)):
        with pytest.raises(ValueError):
            bad()
    s = Sessions()
    k = s.open({"id": 1})
    assert s.get(k)["user"] == {"id": 1} and s.update(k, database_links=[1]) and s.count() == 1
    assert s.close(k) and not s.close(k) and s.get(None) is None and not s.update("x")
