"""Registered queries over geometry functions, shapefiles and SQLite files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import execute
from ..shared import fresh_path
from ..sources import shapefile, sinks, sqlite
from ..tables import load
from .registry import query


def _x(key: str, table: str = "") -> str:
    return f"(CAST(({key} * 7919) % 36000 AS DOUBLE) / 100.0 - 180.0)"


def _y(key: str) -> str:
    return f"(CAST(({key} * 104729) % 18000 AS DOUBLE) / 100.0 - 90.0)"


def _place(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    x = F.pmod(F.col(key) * 7919, F.lit(36000)).cast("double") / 100.0 - 180.0
    y = F.pmod(F.col(key) * 104729, F.lit(18000)).cast("double") / 100.0 - 90.0
    return load(spark, d, table).withColumn("x", x).withColumn("y", y)


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """WKT of a box of whole corners."""
    return F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))", x, y, x + w, y, x + w, y + h, x, y + h, x, y)


@query("SELECT c_custkey, 'POINT' AS kind, 0 AS bare, 4326 AS marked, 0 AS cleared, 32600 + CAST(c_nationkey AS INTEGER) + 1 AS remarked FROM customer")
def geometry_headers(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and SRIDs from the first bytes of geometries, and SRIDs written there, over and off again."""
    c = _place(spark, d, "customer", "c_custkey").withColumn("g", G.point_wkb("x", "y")).withColumn("m", G.set_srid("g", 4326))
    again = G.set_srid("m", F.lit(32601) + F.col("c_nationkey"))
    return c.select("c_custkey", G.geometry_type("m").alias("kind"), G.srid("g").alias("bare"), G.srid("m").alias("marked"), G.srid(G.set_srid("m", 0)).alias("cleared"), G.srid(again).alias("remarked"))


_inside = "CASE WHEN n_nationkey % 4 = 0 THEN {a} WHEN n_nationkey % 4 = 1 THEN {b} WHEN n_nationkey % 4 = 2 THEN {c} ELSE {d} END"


@query(f"""
SELECT n_nationkey AS k, {_inside.format(a='true', b='true', c='false', d='false')} AS contains, n_nationkey % 4 = 0 AS strictly, {_inside.format(a='true', b='true', c='true', d='false')} AS meets,
  {_inside.format(a='0.0', b='0.0', c='0.0', d='CAST(n_nationkey + 5 AS DOUBLE)')} AS distance, {_inside.format(a='true', b='true', c='true', d='n_nationkey + 5 <= 10')} AS near_by
FROM nation
""")
def geometry_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that lie within, touch from within, cross, or lie beside another: contains, within, intersects, distance."""
    k, n = F.col("n_nationkey"), F.lit(10)
    own = G.geomfromtext(_box(F.lit(0), F.lit(0), n, n))
    beside = _box(n + k + 5, F.lit(0), F.lit(3), F.lit(3))
    other = F.when(k % 4 == 0, _box(F.lit(2), F.lit(2), F.lit(3), F.lit(3))).when(k % 4 == 1, _box(F.lit(0), F.lit(2), F.lit(3), F.lit(3))).when(k % 4 == 2, _box(F.lit(8), F.lit(2), F.lit(5), F.lit(3))).otherwise(beside)
    shapes = load(spark, d, "nation").select(k.alias("k"), own.alias("a"), G.geomfromtext(other).alias("b"), G.geomfromtext(F.lit("POINT (0 3)")).alias("edge"))
    strictly = G.st_within("b", "a") & ~G.st_intersects("b", "edge")
    return shapes.select("k", G.st_contains("a", "b").alias("contains"), strictly.alias("strictly"), G.st_intersects("a", "b").alias("meets"), G.st_distance("a", "b").alias("distance"), G.st_dwithin("a", "b", F.lit(10.0)).alias("near_by"))


@query(f"""
WITH c AS (SELECT c_custkey, {_x('c_custkey')} AS x, {_y('c_custkey')} AS y FROM customer)
SELECT c_custkey, round(16 * sin(pi() / 16) * 2.25, 6) AS area, sqrt((x - 10.0) * (x - 10.0) + (y - 20.0) * (y - 20.0)) < 1.4 AS inner_point FROM c
WHERE abs(sqrt((x - 10.0) * (x - 10.0) + (y - 20.0) * (y - 20.0)) - 1.48) > 0.05
""")
def geometry_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Circles around points: their area, and whether they hold a place."""
    c = _place(spark, d, "customer", "c_custkey")
    away = F.sqrt((F.col("x") - 10.0) * (F.col("x") - 10.0) + (F.col("y") - 20.0) * (F.col("y") - 20.0))
    c = c.filter(F.abs(away - 1.48) > 0.05).withColumn("g", G.st_buffer(G.point_wkb("x", "y"), F.lit(1.5)))
    place = G.geomfromtext(F.lit("POINT (10 20)"))
    return c.select("c_custkey", F.round(G.st_area("g"), 6).alias("area"), G.st_contains("g", place).alias("inner_point"))


_haversine = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(48.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(48.0)) * pow(sin(radians(11.0 - x) / 2), 2))))"


@query(f"""
SELECT c_custkey, round({_haversine}, 1) AS metres, {_haversine} <= 5000000.0 AS near_by
FROM (SELECT c_custkey, {_x('c_custkey')} AS x, {_y('c_custkey')} AS y
FROM customer)
""")
def geometry_metres(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distances between geometries, and whether they are within one."""
    c = _place(spark, d, "customer", "c_custkey").withColumn("g", G.point_wkb("x", "y"))
    place = G.geomfromtext(F.lit("POINT (11 48)"))
    return c.select("c_custkey", F.round(G.st_distance_sphere("g", place), 1).alias("metres"), G.st_dwithin_sphere("g", place, F.lit(5_000_000.0)).alias("near_by"))


@query(f"""
SELECT c_custkey, round(x, 6) AS lon, round(y, 6) AS lat, true AS moved, 3857 AS srid
FROM (SELECT c_custkey, {_x('c_custkey')} AS x, {_y('c_custkey')} AS y
FROM customer)
WHERE abs(y) < 80 AND abs(x) < 4
""")
def geometry_systems(spark: SparkSession, d: str) -> DataFrame:
    """Points to UTM zone 31 of their half, from there to Mercator, and back to degrees.

    Moved is whether the zone's coordinates are others than the degrees; near the equator and 4.5 degrees west of the zone's
    middle they are small numbers too, so no least distance is asked for.
    """
    c = _place(spark, d, "customer", "c_custkey").filter("abs(y) < 80 AND abs(x) < 4")
    c = c.withColumn("g", G.set_srid(G.point_wkb("x", "y"), 4326)).withColumn("u", G.st_transform("g", F.when(F.col("y") < 0, 32731).otherwise(32631)))
    m = c.withColumn("m", G.st_transform("u", F.lit(3857))).withColumn("t", G.astext(G.st_transform("m", F.lit(4326))))
    number = lambda k: F.round(F.regexp_extract("t", r"\((\S+) (\S+)\)", k).cast("double"), 6)
    moved = G.st_distance("u", "g") > 0
    return m.select("c_custkey", number(1).alias("lon"), number(2).alias("lat"), moved.alias("moved"), G.srid("m").alias("srid"))


@query("""
SELECT n_nationkey AS k, 'POLYGON ((0 0, ' || n_nationkey + 1 || ' 0, ' || n_nationkey + 1 || ' 2, 0 2, 0 0))' AS repaired, n_nationkey % 2 = 0 AS valid, CAST(2 * (n_nationkey + 1) AS DOUBLE) AS area FROM nation
""")
def geometry_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Rings that are turned, unclosed or have repeated points, repaired; which were valid."""
    w = F.col("n_nationkey") + 1
    good = F.format_string("POLYGON ((0 0, %d 0, %d 2, 0 2, 0 0))", w, w)
    turned = F.format_string("POLYGON ((0 0, 0 2, %d 2, %d 2, %d 0))", w, w, w)
    g = G.geomfromtext(F.when(w % 2 == 1, good).otherwise(turned))
    found = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), g.alias("g")).withColumn("m", G.make_valid("g"))
    ring = F.regexp_replace(G.astext("m"), r"^POLYGON \(\((.*)\)\)$", "$1")
    low = F.when(w % 2 == 1, ring).otherwise(F.concat_ws(", ", F.lit("0 0"), F.format_string("%d 0", w), F.format_string("%d 2", w), F.lit("0 2"), F.lit("0 0")))
    same = F.when(F.size(F.array_except(F.split(low, ", "), F.split(ring, ", "))) == 0, low)
    return found.withColumn("n_nationkey", F.col("k")).select("k", F.concat(F.lit("POLYGON (("), same, F.lit("))")).alias("repaired"), G.is_valid("g").alias("valid"), G.st_area("m").alias("area"))


@query(f"""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'POINT (' || CAST((c_custkey * 7919) % 36000 AS VARCHAR) || ' 7)' ELSE NULL END AS geometry, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'ff00' ELSE '' END AS raw
FROM customer
""")
def readable_cells(spark: SparkSession, d: str) -> DataFrame:
    """Geometry columns as WKT; other binary cells as text, as hexadecimal digits, or empty."""
    k = F.col("c_custkey")
    point = F.when(k % 2 == 0, G.point_wkb(F.pmod(k * 7919, F.lit(36000)).cast("double"), F.lit(7.0)))
    raw = F.when(k % 3 == 0, F.col("c_name").cast("binary")).when(k % 3 == 1, F.unhex(F.lit("ff00"))).otherwise(F.lit("").cast("binary"))
    cells = load(spark, d, "customer").select("c_custkey", "c_name", point.alias("geometry"), raw.alias("raw"))
    return execute.with_text_geometry(cells).withColumn("raw", G.readable("raw"))


@query(f"""
SELECT c_custkey, true AS geojson
FROM (SELECT c_custkey, {_x('c_custkey')} AS x, {_y('c_custkey')} AS y
FROM customer)
WHERE x > -50 AND x < 60 AND y > -20 AND y < 40 AND x <> 60 AND y <> 40
""")
def user_constraint(spark: SparkSession, d: str) -> DataFrame:
    """Places within a geometry that a user gives as GeoJSON, and as WKT."""
    ring = [[-50, -20], [60, -20], [60, 40], [-50, 40], [-50, -20]]
    given = G.geomfromtext(F.lit(str({"type": "Polygon", "coordinates": [ring]}).replace("'", '"')))
    text = G.geomfromtext(F.lit("POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring) + "))"))
    c = _place(spark, d, "customer", "c_custkey").withColumn("g", G.point_wkb("x", "y"))
    return c.filter(G.st_within("g", text)).select("c_custkey", G.st_contains(given, "g").alias("geojson"))


@query(f"""
SELECT s_suppkey, s_name, round(x, 6) AS lon, round(y, 6) AS lat, 4326 AS srid, 'written,skipped,written' AS became
FROM (SELECT *, {_x('s_suppkey')} AS x, {_y('s_suppkey')} AS y
FROM supplier)
WHERE true
""")
def shapefile_import(spark: SparkSession, d: str) -> DataFrame:
    """A shapefile, read, and imported as a table under the policies for one that is there."""
    folder = fresh_path(spark, "shapes")
    path = Path(sqlite.local(folder))
    path.mkdir(parents=True)
    rows = [(r["x"], r["y"], r["s_suppkey"], r["s_name"]) for r in _place(spark, d, "supplier", "s_suppkey").orderBy("s_suppkey").collect()]  # a shapefile is one file
    name = "places_" + folder.rsplit("-", 1)[1]
    shapefile.write_points(rows, ["s_suppkey", "s_name"], str(path / f"{name}.shp"))
    became = [shapefile.import_tables(spark, str(path), if_exists=p)[name] for p in ("skip", "no", "replace")]
    found = shapefile.read(spark, str(path)).withColumn("t", G.astext("geometry"))
    number = lambda k: F.round(F.regexp_extract("t", r"\((\S+) (\S+)\)", k).cast("double"), 6)
    assert spark.table(name).count() == len(rows)
    spark.sql(f"DROP TABLE `{name}`")
    return found.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", number(1).alias("lon"), number(2).alias("lat"), "srid", F.lit(",".join(became)).alias("became"))


@query(f"""
SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, 'written,skipped,written' AS became, 'places:geometry:POINT:4326' AS layer, 'geometry_columns,places' AS tables FROM supplier
""")
def spatialite_layers(spark: SparkSession, d: str) -> DataFrame:
    """Rows written to a SQLite file with their geometry under the policies, its objects and layers, and the rows read."""
    folder = Path(sqlite.local(fresh_path(spark, "sqlite")))
    folder.mkdir(parents=True)
    address = f"jdbc:sqlite:{folder}/places.db"
    s = _place(spark, d, "supplier", "s_suppkey")
    rows = s.select("s_suppkey", "s_name", "s_acctbal", G.set_srid(G.point_wkb("x", "y"), 4326).alias("geometry"))
    became = [sinks.write(rows, address, "places", p) for p in ("fail", "skip", "overwrite")]
    file = f"{folder}/places.db"
    layer = ";".join(":".join(map(str, x)) for x in sqlite.layers(file))
    listed = ",".join(n for n, _ in sqlite.objects(file))
    assert not sqlite.is_empty(file)
    found = sqlite.read(spark, file, "places").filter(G.geometry_type("geometry") == "POINT")
    return found.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"), F.lit(",".join(became)).alias("became"), F.lit(layer).alias("layer"), F.lit(listed).alias("tables"))


@query(f"""
SELECT c_custkey, 'POINT' AS kind, round(x * x + y * y, 4) AS squared
FROM (SELECT c_custkey, {_x('c_custkey')} AS x, {_y('c_custkey')} AS y
FROM customer)
WHERE sqrt(x * x + y * y) <= 30.0
""")
def spatial_sql(spark: SparkSession, d: str) -> DataFrame:
    """The functions under their SQL names, in a guarded statement."""
    own = spark.newSession()
    G.register(own)
    load(own, d, "customer").createOrReplaceTempView("customer")
    sql = """WITH c AS (SELECT c_custkey, ts_point(x, y) AS g, x, y FROM (SELECT c_custkey, pmod(c_custkey * 7919, 36000) / 100.0D - 180.0D AS x, pmod(c_custkey * 104729, 18000) / 100.0D - 90.0D AS y FROM customer))
    SELECT c_custkey, GeometryType(g) AS kind, round(power(ST_Distance(g, ST_GeomFromText('POINT (0 0)')), 2), 4) AS squared FROM c WHERE x BETWEEN -30 AND 30 AND y BETWEEN -30 AND 30 AND ST_DWithin(g, ST_GeomFromText('POINT (0 0)'), 30.0D)"""
    return execute.query(own, sql)
