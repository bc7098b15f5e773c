"""Registered queries over streams, tools, the question pipeline, and sources that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import HashingEmbedder, embedder_udf
from ..operators import execute
from ..shared import fresh_path
from ..streaming import events
from ..tables import load
from . import nl, search, tools
from .registry import query

# Streams. A table is written to the shared folder and read as a stream, batch by batch, to a table that the query returns.


def _streamed(spark: SparkSession, rows: DataFrame, made, mode: str = "append") -> DataFrame:
    """What made(stream) gives for rows as a stream of files."""
    source, out = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out")
    rows.write.parquet(source)
    stream = made(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source))
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", fresh_path(spark, "stream-state"))
    run.option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Texts of conversations as they grow by 400 characters, up to the whole."""
    last = F.greatest(F.lit(1), F.ceil(F.char_length("text") / 400).cast("int"))
    grown = load(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.explode(F.sequence(F.lit(1), last)).alias("seq"), "text")
    return grown.withColumn("text", F.substring(F.col("text"), F.lit(1), F.col("seq") * 400))


_grown = """
SELECT conv_id || '-' || turn AS stream_id, CAST(seq AS INTEGER) AS seq, substr(text, CAST((seq - 1) * 400 + 1 AS BIGINT), 400) AS delta
FROM (SELECT *, unnest(range(1, greatest(1, CAST(ceil(length(text) / 400.0) AS BIGINT)) + 1)) AS seq FROM conversations) WHERE text <> ''
"""


@query(_grown)
def streamed_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What each text of a stream adds, told from state; its texts are cumulative. One file keeps a stream's order."""
    rows = _snapshots(spark, d).repartition(4, "stream_id")
    return _streamed(spark, rows, events.stream_deltas)


@query("SELECT conv_id || '-' || turn AS stream_id, sha256(text) AS digest, length(text) AS n FROM conversations")
def streamed_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of texts gathered in state until their end comes."""
    snapshots = _snapshots(spark, d)
    piece = F.substring(F.col("text"), (F.col("seq") - 1) * 400 + 1, F.lit(400))
    pieces = snapshots.select("stream_id", "seq", piece.alias("delta"), F.lit(False).alias("is_end"))
    ends = snapshots.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).select("stream_id", "seq", F.lit("").alias("delta"), F.lit(True).alias("is_end"))
    found = _streamed(spark, pieces.unionByName(ends).repartition(4, "stream_id"), events.stream_buffers)
    return found.select("stream_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("n"))


@query("""
SELECT user_id, event_id, event_type
FROM (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS e
FROM events)
WHERE e IS NULL OR event_id <= e
""")
def events_until_end(spark: SparkSession, d: str) -> DataFrame:
    """Each request's events up to its first end."""
    kind = F.when(F.col("event_type") == "error", F.lit("end")).otherwise(F.lit("progress"))
    rows = load(spark, d, "events").withColumn("kind", kind)
    return events.until_end(rows, "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("""
SELECT event_id // 2 AS call_id, epoch_us(max(CASE WHEN event_id % 2 = 1 AND event_type <> 'view' THEN ts END)) // 1000 - epoch_us(min(CASE WHEN event_id % 2 = 0 THEN ts END)) // 1000 AS elapsed_ms,
  bool_or(event_id % 2 = 1 AND event_type = 'error') AS failed
FROM events GROUP BY 1
""")
def tool_call_times(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds of tool calls from their start to their end or error; calls that have not ended have none."""
    later = F.when(F.col("event_type") == "error", F.lit("error")).when(F.col("event_type") == "view", F.lit("progress")).otherwise(F.lit("end"))
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("start")).otherwise(later)
    rows = load(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("call_id"), kind.alias("kind"), "ts")
    return events.tool_times(rows)


@query("SELECT event_type, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY event_type")
def windowed_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first events of each kind within a watermark, and how many there are."""
    rows = load(spark, d, "events")
    kinds = events.distinct_events(rows, "ts", ["event_type"], "1 day").select("event_type")
    return rows.join(kinds, "event_type").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


# Tools and questions.


def _index(spark: SparkSession, d: str) -> search.KeywordIndex:
    return search.KeywordIndex.build(load(spark, d, "documents").select("doc_id", "text"), text_col="text")


@query("""
SELECT tool, ok, n, agent, events FROM (VALUES
  ('introspect', true, 2), ('estimate_rows', true, (SELECT count(*) FROM customer)), ('top_distinct', true, (SELECT least(3, count(DISTINCT c_mktsegment)) FROM customer)),
  ('execute', true, (SELECT count(*) FROM nation)), ('explain', true, 1), ('keyword_search', true, 4), ('vector_search', true, 3), ('search', true, 3), ('pages', true, 2),
  ('nothing', false, 0), ('top_distinct ', false, 0)) t(tool, ok, n), (SELECT 'sql_builder:2:build' AS agent, 'start,end' AS good, 'start,error' AS bad) c
  , LATERAL (SELECT CASE WHEN ok THEN good ELSE bad END AS events) e
""")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every tool called for a role: its envelope, how much it found, who called, and the events it sent."""
    own = spark.newSession()
    for name in ("customer", "nation"):
        load(own, d, name).createOrReplaceTempView(name)
    text = F.concat(F.lit("nation "), "n_name")
    embedder = HashingEmbedder(dimensions=32)
    vectors = load(own, d, "nation").select(F.concat(F.lower("n_name"), F.lit("_0")).alias("id"), text.alias("document"), embedder_udf(embedder)(text).alias("embedding"))
    seen: list[tuple[str, str]] = []
    kit = tools.Toolkit(own, _index(own, d), vectors, load(own, d, "pages"), embedder, lambda kind, about: seen.append((kind, f"{about['agent']}:{about['round']}:{about['stage']}")))
    size = {"introspect": lambda r: len([t for t in r["tables"] if t["table"] in ("customer", "nation")]), "estimate_rows": lambda r: r["rows"], "top_distinct": lambda r: len(r["values"]), "execute": lambda r: r["row_count"], "explain": lambda r: min(1, len(r["plan"])), "pages": lambda r: len(r["results"])}
    asked = {
        "introspect": {},
        "estimate_rows": {"table": "customer"},
        "top_distinct": {"table": "customer", "column": "c_mktsegment", "k": 3},
        "execute": {"sql": "SELECT * FROM nation"},
        "explain": {"sql": "SELECT * FROM nation"},
        "keyword_search": {"query": "the and", "k": 4},
        "vector_search": {"query": "nation", "k": 3},
        "search": {"query": "the", "k": 3},
        "pages": {"query": "the", "top_k": 2},
        "nothing": {},
        "top_distinct ": {"table": "customer", "column": "c; DROP"},
    }
    out = []
    for name, arguments in asked.items():
        seen.clear()
        with tools.called_by(own, "sql_builder", 2, "build"):
            r = kit.call(name.strip(), **arguments)
        n = size.get(name, lambda r: len(r["hits"]))(r) if r["ok"] else 0
        out.append((name, r["ok"], n, seen[0][1], ",".join(k for k, _ in seen)))
    return spark.createDataFrame(out, "tool string, ok boolean, n long, agent string, events string")


_roles = {"orchestrator": "", "db_context": "estimate_rows,execute,explain,introspect,top_distinct", "knowledge": "pages,search", "sql_builder": "estimate_rows,execute,explain,introspect,top_distinct", "sql_reviewer": ""}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', {n}, {str(p).lower()}, '{_roles[r]}')" for r, (n, p) in {"orchestrator": (8, False), "db_context": (8, True), "knowledge": (8, True), "sql_builder": (10, False), "sql_reviewer": (6, False)}.items()) + ") t(role, iterations, parallel, tools)")
def role_tools(spark: SparkSession, d: str) -> DataFrame:
    """Roles, their limits, and the tools that a toolkit gives them."""
    kit = tools.Toolkit(spark)
    rows = [(r, n, p, ",".join(sorted(kit.of(r)))) for r, (n, p) in nl.ROLES.items()]
    return spark.createDataFrame(rows, "role string, iterations int, parallel boolean, tools string")


_sx, _sy = "(CAST((s_suppkey * 7919) % 36000 AS DOUBLE) / 100.0 - 180.0)", "(CAST((s_suppkey * 104729) % 18000 AS DOUBLE) / 100.0 - 90.0)"
_hotels = f"SELECT s_suppkey AS id, s_name AS name, {_sx} AS x, {_sy} AS y FROM supplier WHERE s_suppkey > 0"
_away = f"sqrt(power(x - (SELECT {_sx} FROM supplier WHERE s_suppkey = 0), 2) + power(y - (SELECT {_sy} FROM supplier WHERE s_suppkey = 0), 2))"


def _places(spark: SparkSession, d: str) -> tuple[SparkSession, list[nl.Layer]]:
    """A session whose places are the suppliers: the first a lake, the others hotels."""
    own = spark.newSession()
    x = F.pmod(F.col("s_suppkey") * 7919, F.lit(36000)).cast("double") / 100.0 - 180.0
    y = F.pmod(F.col("s_suppkey") * 104729, F.lit(18000)).cast("double") / 100.0 - 90.0
    first = F.col("s_suppkey") == 0
    kind, name = F.when(first, F.lit("lake")).otherwise(F.lit("hotel")), F.when(first, F.lit("Blue Lake")).otherwise(F.col("s_name"))
    load(own, d, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"), kind.alias("fclass"), x.alias("x"), y.alias("y")).createOrReplaceTempView("places")
    return own, [nl.Layer("places", "id", "name", "x", "y", "fclass")]


def _asked(spark: SparkSession, d: str, question: str, **more) -> tuple[nl.Answer, list[str]]:
    own, layers = _places(spark, d)
    seen: list[str] = []
    made = nl.answer(own, question, nl.rule_planner(own), nl.rule_evidence(own, layers), nl.rule_builder(layers), emit=lambda k, p: seen.append(p.get("stage", k)), **more)
    return made, seen


@query(f"""
SELECT 1 AS round_id, 'within' AS kind, 'PASS' AS verdict, id, name, round({_away}, 6) AS distance
FROM ({_hotels})
WHERE {_away} <= 60
ORDER BY {_away}, id LIMIT 100
""")
def question_within(spark: SparkSession, d: str) -> DataFrame:
    """A question for places within a distance of a named one: its accepted round, and the rows of the SQL it gave."""
    answer, _ = _asked(spark, d, "Show hotels within 60 of 'Blue Lake'")
    trace = nl.traces(spark, answer.rounds).first()
    rows = [(trace["round_id"], trace["kind"], trace["verdict"], r["id"], r["name"], round(r["distance"], 6)) for r in answer.result.rows]
    return spark.createDataFrame(rows, "round_id int, kind string, verdict string, id long, name string, distance double")


@query(f"SELECT id, name, round({_away}, 6) AS distance, 'start,plan,db_context,knowledge,review,end' AS stages FROM ({_hotels}) ORDER BY {_away}, id LIMIT 1")
def question_nearest(spark: SparkSession, d: str) -> DataFrame:
    """A question for the nearest place: the SQL it gave, run again; and the stages it went through."""
    answer, seen = _asked(spark, d, 'Find the nearest hotel to "Blue Lake"')
    own, _ = _places(spark, d)
    rows = [(r["id"], r["name"], round(r["distance"], 6), ",".join(seen)) for r in execute.query(own, answer.sql).collect()]
    return spark.createDataFrame(rows, "id long, name string, distance double, stages string")


@query("""
SELECT (SELECT count(*) - 1
FROM supplier) AS total, 3 AS rounds, 'FAIL,FAIL,FAIL' AS verdicts, true AS asks, 'start,plan,knowledge,db_context,review,end' AS stages,
  'knowledge,db_context' AS steps
""")
def question_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A count; a question without a place to start from, which is asked back after its rounds; and a plan's own order."""
    counted, _ = _asked(spark, d, "How many hotels are there")
    lost, _ = _asked(spark, d, "Find the nearest hotel")
    own, layers = _places(spark, d)
    plain, seen = nl.rule_planner(own), []

    def plan(question: str, context: dict, rounds: list) -> dict:
        return plain(question, context, rounds) | {"fanout_order": ["kb"]}

    nl.answer(own, "How many hotels are there", plan, nl.rule_evidence(own, layers), nl.rule_builder(layers), emit=lambda k, p: seen.append(p.get("stage", k)))
    row = (counted.result.rows[0]["total"], len(lost.rounds), ",".join(r.verdict for r in lost.rounds), lost.sql is None and "start from" in lost.text, ",".join(seen), ",".join(nl.step_order({"execution_order": ["KB", "other"]})))
    return spark.createDataFrame([row], "total long, rounds int, verdicts string, asks boolean, stages string, steps string")


@query("SELECT p_partkey, 16 AS n, true AS unit, true AS same FROM part")
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts embedded in batches by an embedder, and by one made anew of its settings."""
    embedder = HashingEmbedder(dimensions=16)
    again = HashingEmbedder(**embedder.config())
    rows = load(spark, d, "part").select("p_partkey", embedder_udf(embedder)("p_name").alias("a"), embedder_udf(again)("p_name").alias("b"))
    length = F.aggregate("a", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("p_partkey", F.size("a").alias("n"), (F.abs(length - 1) < 1e-5).alias("unit"), (F.col("a") == F.col("b")).alias("same"))


# Sources and lists.


@query("SELECT n_nationkey, n_name, n_regionkey, source FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS source)")
def spark_sources(spark: SparkSession, d: str) -> DataFrame:
    """A table written and read in each of Spark's own formats."""
    nations, out = load(spark, d, "nation"), None
    schema = nations.schema
    for kind in ("csv", "json", "orc", "parquet"):
        path = fresh_path(spark, f"source-{kind}")
        nations.write.format(kind).save(path)
        one = spark.read.format(kind).schema(schema).load(path).withColumn("source", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT p_type, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT p_brand))[1:6], ',') AS brands, (SELECT count(*) FROM nation) AS wanted, 'p_partkey,p_name' AS shape,
  array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT p_brand), ['Brand#1', 'none']))), ',') AS every
FROM part GROUP BY p_type
""")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sorted lists, their first entries, unions without repeats, and the columns of a statement without its rows."""
    own = spark.newSession()
    load(own, d, "part").createOrReplaceTempView("part")
    shape = execute.query(own, "SELECT p_partkey, p_name FROM part LIMIT 0")
    brands = F.array_sort(F.collect_set("p_brand"))
    wanted = load(spark, d, "nation").agg(F.count(F.lit(1)).alias("wanted"))
    rows = load(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), brands.alias("b"))
    every = F.array_join(F.array_sort(F.array_union("b", F.array(F.lit("Brand#1"), F.lit("none")))), ",")
    return rows.crossJoin(F.broadcast(wanted)).select("p_type", "n", F.array_join(F.slice("b", 1, 6), ",").alias("brands"), "wanted", F.lit(",".join(shape.columns)).alias("shape"), every.alias("every"))  # one row


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 99 AS doc_id, o_orderstatus FROM orders")
def sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that count on from a base in the order of a key: ranges are sorted apart, each counts on from those before."""
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    path = fresh_path(spark, "ranges")
    numbered = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    numbered.write.parquet(path)
    held = spark.read.parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
    before, base = [], 100
    for part, n in sizes:
        before.append((part, base))
        base += n
    starts = spark.createDataFrame(before, "part int, base long")
    return held.join(F.broadcast(starts), "part").select("o_orderkey", (F.col("base") + F.col("at")).alias("doc_id"), "o_orderstatus")
