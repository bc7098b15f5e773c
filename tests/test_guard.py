import pytest

from terrasift.operators.execute import clamp_page, execute_readonly, explain, page_count, page_of, sql_page
from terrasift.operators.guard import read_only, read_only_text, without_comments


def test_comments():
    assert without_comments("SELECT '--x' /* a /* b */ c */ -- t").rstrip() == "SELECT '--x'"
    assert without_comments("a /* x\ny */ b") == "a \n b"
    assert without_comments('SELECT "a--b" /* open') == 'SELECT "a--b" '
    assert without_comments(None) == ""


@pytest.mark.parametrize("sql", ["WITH a AS (SELECT 1) SELECT * FROM a", "SHOW TABLES", "SELECT last_update FROM t"])
def test_text_accepts(sql):
    assert read_only_text(sql) == sql


@pytest.mark.parametrize("sql", ["", "  ", "DROP TABLE t", "SELECT 'drop'", "SELECT replace(a,'b','c')", "(SELECT 1)"])
def test_text_rejects(sql):
    with pytest.raises(ValueError):
        read_only_text(sql)


@pytest.mark.parametrize("sql", ["SELECT 'drop'", "SELECT replace('a','b','c')", "WITH a AS (SELECT 1 x) SELECT * FROM a;", "SHOW TABLES", "DESCRIBE QUERY SELECT 1"])
def test_plan_accepts(spark, sql):
    assert read_only(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 1; VACUUM", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "INSERT INTO t VALUES (1)", "DROP TABLE t", "CREATE TABLE t (a int)", "SELECT java_method('java.lang.System', 'exit', 0)", "CACHE TABLE t", "SET a=b"])
def test_plan_rejects(spark, sql):
    with pytest.raises(ValueError):
        read_only(spark, sql)


def test_execute(spark):
    r = execute_readonly(spark, "SELECT id, id * :k AS b FROM range(10) ORDER BY id", {"k": 3}, max_rows=4)
    assert (r.status, r.row_count, r.truncated, r.rows[1]) == ("OK", 4, True, {"id": 1, "b": 3})
    assert execute_readonly(spark, "SELECT 1/0").status == "ERROR"
    assert execute_readonly(spark, "DROP TABLE x").error
    slow = execute_readonly(spark, "SELECT count(*) FROM range(100000000000) a", timeout_ms=700)
    assert slow.status == "ERROR" and "700 ms" in slow.error


def test_pages(spark):
    assert clamp_page(0, 9999) == (1, 500) and page_count(0, 20) == 0 and page_count(41, 20) == 3
    df = spark.range(45).toDF("k")
    pages = [page_of(df, p, 20) for p in (1, 2, 3, 4)]
    assert [p.page_row_count for p in pages] == [20, 20, 5, 0] and pages[0].total_pages == 3
    assert sorted(r["k"] for p in pages for r in p.rows) == list(range(45))
    assert sql_page(spark, "SELECT 1 AS a", 1, 5).rows == [{"a": 1}]
    with pytest.raises(ValueError):
        sql_page(spark, "SHOW TABLES")
    assert any("Range" in x for x in explain(spark, "SELECT * FROM range(3)"))
