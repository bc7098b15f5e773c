import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrasift.functions import sqltext as S
from terrasift.functions import text as X
from terrasift.functions.vectors import HashingEmbedder, embedder_udf
from terrasift.operators import migrate
from terrasift.sources import config, docs, jdbc


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("Foo_1 a 9x ST_Distance"))) == ["foo_1", "st_distance"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_features(spark):
    assert one(spark, X.entities(F.lit('Find restaurants near "Blue Lake" and Green Hill'))) == ["Blue Lake", "Green Hill"]
    assert one(spark, X.entities(F.lit("Find Central Park"))) == []
    assert one(spark, X.categories(F.lit("hotels and a bar"))) == ["bar", "hotel"]
    assert one(spark, X.asks_nearest(F.lit("linear features"))) is True
    assert one(spark, X.spatial_words(F.lit("Area near"))) == ["near", "area"]
    e = one(spark, X.default_evidence(F.lit("closest cafe to Oak Tree"), F.lit(" "), F.array(F.lit("t"))))
    assert (e.expected_outputs, e.schema_whitelist, e.target_categories) == (["id", "name", "distance", "category"], ["public"], ["cafe"])
    assert one(spark, X.distinct_words(F.array(*map(F.lit, (" A", "a", "", "b"))))) == ["A", "b"]
    assert "ST_DWithin" in one(spark, X.default_topics(F.lit("list roads")))


def test_values(spark):
    assert one(spark, X.truthy(F.lit(" Yes "))) and not one(spark, X.truthy(F.lit(None).cast("string")))
    assert one(spark, X.feedback(F.lit(" LIKE "))) == "like" and one(spark, X.feedback(F.lit("none"))) is None
    with pytest.raises(Exception):
        one(spark, X.feedback(F.lit("meh")))
    assert one(spark, X.database_type(F.lit("postgis"))) == "Postgis"
    assert one(spark, X.schema_names(F.lit('["a", " b", "a"]'))) == ["a", "b"]
    assert one(spark, X.schema_names(F.lit("a, b,,a"))) == ["a", "b"]
    c = one(spark, X.context(F.lit('{"database_id": 3, "table_list": ["a", " "], "geometry": " "}')))
    assert (c.database_id, c.table_list, c.view_list, c.geometry) == (3, ["a"], [], None)
    assert one(spark, X.context(F.lit("{"))).table_list == []


def test_chunks(spark):
    assert one(spark, X.chunks(F.lit("abcde"), 2)) == ["ab", "cd", "e"]
    assert one(spark, X.chunks(F.lit("  "), 2)) == [] and one(spark, X.chunks(F.lit(None).cast("string"))) == []
    assert one(spark, X.chunks(F.lit("x" * 30), 50, 15, 9))[-1].endswith("truncated]")
    assert len(one(spark, X.chunks(F.lit("x" * 100), 10, 0 + 1000, 3))) == 3


def test_sql_text():
    assert [S.literal(x) for x in (None, True, 3, "O'Brien", [1, "a"], dt.date(2024, 1, 2))] == ["NULL", "TRUE", "3", "'O''Brien'", "(1, 'a')", "'2024-01-02'"]
    assert S.render("a::int = :x AND b = :y", {"x": 1}) == "a::int = 1 AND b = NULL"
    assert S.render("x = :x", {}) == "x = :x" and S.render("':x' = :x", {"x": 2}) == "':x' = 2"
    assert S.first_json('no {"a": 1} {"b": 2}') == {"a": 1}
    assert S.first_json('```json\n{"a": 1}\n``` ```json\n{"a": 2}\n```') == {"a": 2}
    assert S.first_json("<structured_json>{\"q\": 1}</structured_json>") == {"q": 1} and S.first_json("[1]") is None
    assert S.sql_of("x ```sql\nSELECT 1\n``` y") == "SELECT 1" and S.looks_like_sql(" with a") and not S.looks_like_sql("withdraw")
    assert S.summary_of("a\n\n\n\n```x```b" + "c" * 2000).endswith("...")
    assert S.unique(["a ", "A", "", None, "b"]) == ["a", "b"]
    assert S.qualified("t", "s") == "`s`.`t`"
    with pytest.raises(ValueError):
        S.identifier("a b")


def test_jdbc():
    a = jdbc.parse("jdbc:postgresql://h:5432/d?user=u&password=p&ssl=1")
    assert a.client_url() == "postgresql+psycopg2://u:p@h:5432/d?ssl=1" and "p@" not in a.redacted().replace("***", "")
    assert a.reader_options()["url"] == "jdbc:postgresql://h:5432/d?ssl=1"
    assert jdbc.parse("jdbc:sqlite::memory:").database == ":memory:" and jdbc.parse("jdbc:mysql:///d").host == "localhost"
    with pytest.raises(ValueError):
        jdbc.parse("jdbc:postgresql:h")
    assert jdbc.with_credentials("jdbc:mysql://h/d", "MySQL", "u", "p") == "jdbc:mysql://h/d?user=u&password=p"
    assert jdbc.with_credentials("jdbc:mysql://h/d?user=x", "MySQL", "u", "p").endswith("user=x")
    assert jdbc.with_credentials("jdbc:sqlite:a", "Spatialite", "u", "p") == "jdbc:sqlite:a"


def test_config():
    c = config.load('{"a": {"b": 1}}')
    assert config.get(c, "a.b") == 1 and config.get(c, "a.c", 5) == 5
    with pytest.raises(ValueError):
        config.required(c, ["a.c"])


def test_docs(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text('[{"function_id": "f", "description": "", "chapter_info": "ch", "function_definitions": [{"function_name": "n", "signature_str": "s"}], "examples": [{"name": "e", "steps": [{"question": "q", "sql": "x"}]}]}, {"function_id": "g"}]')
    rows = docs.read(spark, str(p)).orderBy("doc_id").collect()
    assert [r["document"] for r in rows] == ["f\nch\nn\ns\ne\nq\nx", "g"] and rows[1]["vector_id"] == "g_1"
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        docs.read(spark, str(tmp_path / "o.json"))
    assert docs.has_content(spark, str(p)) and not docs.has_content(spark, str(tmp_path / "none"))


def test_embedder(spark):
    e = HashingEmbedder(16)
    df = spark.createDataFrame([("a b",), (None,)], "t string").select(embedder_udf(e)("t").alias("v")).collect()
    assert abs(sum(x * x for x in df[0]["v"]) - 1) < 1e-5 and df[1]["v"] == [0.0] * 16
    assert HashingEmbedder(**e.config()) == e


def test_migrations(spark, tmp_path):
    found = migrate.scripts({"V1_10__b.sql": "", "V1_2__a.sql": "", "x.sql": ""})
    assert [s.version for s in found] == ["1_2", "1_10"]
    with pytest.raises(ValueError):
        migrate.scripts({"V1__a.sql": "", "V1__b.sql": ""})
    assert migrate.statements("SELECT ';' -- ;\n; /* ; */ SELECT 2;") == ["SELECT ';' -- ;", "/* ; */ SELECT 2"]
    trigger = "CREATE TRIGGER t AFTER UPDATE ON a BEGIN UPDATE a SET b = 1; END"
    assert migrate.statements(trigger + "; SELECT 1") == [trigger, "SELECT 1"]
    files = {"V1__a.sql": "SELECT 1", "V2__b.sql": "SELECT 2; SELECT 3"}
    assert migrate.run(spark, files, str(tmp_path)) == ["V1__a.sql", "V2__b.sql"] and migrate.run(spark, files, str(tmp_path)) == []
    with pytest.raises(ValueError):
        migrate.run(spark, files | {"V1__a.sql": "SELECT 9"}, str(tmp_path))
