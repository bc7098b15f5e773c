"""Spatial joins: pairs within a distance, and nearest neighbours, by grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import EARTH, planar_distance, sphere_distance
from ..shared import checkpointed


def _cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))


def within_distance(left: DataFrame, right: DataFrame, lxy: tuple[str, str], rxy: tuple[str, str], distance: float) -> DataFrame:
    """Pairs of rows at most distance apart (planar), with column distance; null coordinates pair with nothing.

    An equi-join on grid cells as wide as the distance: left rows go to their nine neighbour cells, right rows have one,
    so no pair comes twice, and a hot cell is split by adaptive execution. Column names of the two sides must differ.
    """
    spread = _cells(left.filter(F.col(lxy[0]).isNotNull() & F.col(lxy[1]).isNotNull()), *lxy, distance)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = spread.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    spread = spread.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")
    joined = spread.join(_cells(right, *rxy, distance), ["_cx", "_cy"])
    return joined.withColumn("distance", planar_distance(*map(F.col, (*lxy, *rxy)))).filter(F.col("distance") <= distance).drop("_cx", "_cy")


def within_sphere(left: DataFrame, right: DataFrame, lxy: tuple[str, str], rxy: tuple[str, str], metres: float) -> DataFrame:
    """Pairs at most metres apart on the sphere (haversine), with column distance.

    Cells are bands of latitude as high as the distance and, within a band, slices of longitude that are as wide as two
    places within the distance can lie apart there, which is more than the distance towards the poles, and all longitudes
    where the distance reaches over a pole: such bands are one slice. Longitudes wrap at 180 degrees.
    """
    reach = min(metres / EARTH, math.pi / 2)
    step = max(math.degrees(metres / EARTH) * (1 + 1e-9), 1e-9)
    bands = math.floor(90 / step)

    def slices(band):
        """Slices of a band: as many as fit, of the width at its edge nearest to the pole."""
        edge = F.greatest(F.abs(band * step), F.abs((band + 1) * step))
        sine = F.lit(math.sin(reach) * 1.01 + 1e-11) / F.cos(F.radians(F.least(edge, F.lit(90.0))))
        return F.when(sine < 1, F.floor(360 / F.degrees(F.asin(sine)))).otherwise(1).cast("long")

    def place(band, lon):
        n = slices(band)
        return F.pmod(F.floor((lon + 180) / (F.lit(360.0) / n)).cast("long"), n)

    r = right.withColumn("_b", F.floor(F.col(rxy[1]) / step).cast("long"))
    r = r.withColumn("_s", place(F.col("_b"), F.col(rxy[0])))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    lft = left.withColumn("_d", F.explode(around)).withColumn("_b", F.floor(F.col(lxy[1]) / step).cast("long") + F.col("_d")).drop("_d").filter(F.col("_b").between(-bands - 1, bands + 1))
    n = slices(F.col("_b"))
    near = F.array_distinct(F.transform(around, lambda d: F.pmod(place(F.col("_b"), F.col(lxy[0])) + d, n)))
    joined = lft.withColumn("_s", F.explode(near)).join(r, ["_b", "_s"])
    return joined.withColumn("distance", sphere_distance(*map(F.col, (*lxy, *rxy)))).filter(F.col("distance") <= metres).drop("_b", "_s")


def nearest_to(targets: DataFrame, anchor: tuple[float, float], xy: tuple[str, str], n: int = 1, keys: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """The n targets nearest to one point, with column distance; ties by keys. One pass, a top-n and no shuffle of rows.

    With digits, distances are rounded first, so those that are equal then are ties. Targets without a place come last.
    """
    d = planar_distance(F.col(xy[0]), F.col(xy[1]), F.lit(float(anchor[0])), F.lit(float(anchor[1])))
    d = d if digits is None else F.round(d, digits)
    return targets.withColumn("distance", d).orderBy(*[F.col(c).asc_nulls_last() for c in ("distance", *(keys or []))]).limit(max(1, n))


#: Targets that a cell of the first ring holds in the mean, for each one that is wanted; and how much wider rings get.
DENSITY, GROWTH = 2.0, 4.0


def nearest_join(anchors: DataFrame, targets: DataFrame, axy: tuple[str, str], txy: tuple[str, str], akey: str, tkey: str, n: int = 1, cell: float | None = None) -> DataFrame:
    """For each anchor its n nearest targets, with column distance and rank; ties by tkey.

    Anchors look in the cells around them, in rings of growing width, by equi-joins; cell is the first one's width (by the
    targets' density if it is not given). An anchor is done once n targets lie within a ring's width, or once the ring covers
    all places, so each round only the anchors that are far from targets go on, and no pairs are made but those of a ring.
    """
    anchors = anchors.filter(F.col(axy[0]).isNotNull() & F.col(axy[1]).isNotNull())
    targets = targets.filter(F.col(txy[0]).isNotNull() & F.col(txy[1]).isNotNull())
    limits = lambda df, xy: df.agg(*[f(F.col(c).cast("double")) for c in xy for f in (F.min, F.max)], F.count(F.lit(1))).first()
    a, t = limits(anchors, axy), limits(targets, txy)
    widths = [max(a[k + 1], t[k + 1]) - min(a[k], t[k]) for k in (0, 2)] if a[4] and t[4] else [0.0, 0.0]
    across = math.hypot(*widths) + 1e-9
    if cell is None:
        own = [max(t[k + 1] - t[k], across / 1e6) for k in (0, 2)] if t[4] else [1.0, 1.0]
        cell = math.sqrt(own[0] * own[1] * DENSITY * n / max(1, t[4]))
    rank = Window.partitionBy(akey).orderBy("distance", tkey)
    done, left, size = None, anchors, cell
    while True:
        found = within_distance(left, targets, axy, txy, size)
        ranked = checkpointed(found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n))
        if size >= across:
            return ranked if done is None else done.unionByName(ranked)
        full = ranked.filter(F.col("rank") == n).select(F.col(akey).alias("_full"))
        ready = ranked.join(full, ranked[akey] == full["_full"], "left_semi")
        done = ready if done is None else done.unionByName(ready)
        left = checkpointed(left.join(full, left[akey] == full["_full"], "left_anti"))
        if left.isEmpty():
            return done
        size = min(size * GROWTH, across) if size * GROWTH < across / 2 else across
