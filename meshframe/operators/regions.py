"""Regions: named polygons, the mask of points inside, and what a mask spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = Sequence[tuple[float, float]]


def area(ring: Ring) -> float:
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def inside(x: Column, y: Column, rings: Sequence[Ring], largest_only: bool = True) -> Column:
    """Even-odd ray casting against a polygon, or the largest part of a multipolygon; null coordinates are outside.

    The edges are literals (a region's outline is part of the query), so the mask is one expression over the scan.
    """
    held = F.lit(False)
    for ring in [max(rings, key=area)] if largest_only else rings:
        odd = F.lit(False)
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y0 == y1:
                continue
            crosses = ((F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)) & (x < F.lit(float(x0)) + (y - F.lit(float(y0))) * F.lit((x1 - x0) / (y1 - y0)))
            odd = odd != crosses
        held = held | odd
    return F.coalesce(held, F.lit(False))


def inside_table(df: DataFrame, x: str, y: str, edges: DataFrame, out: str = "region") -> DataFrame:
    """``df`` with the names of the regions each point is in, for outlines too long for literals.

    ``edges``: (name, x0, y0, x1, y1). Edges and points meet in bands of y, each edge in those it crosses, and crossings
    are counted for each point and region.
    """
    bounds = edges.agg(F.min(F.least("y0", "y1")), F.max(F.greatest("y0", "y1")), F.avg(F.abs(F.col("y1") - F.col("y0")))).first()
    low, width = bounds[0], max(bounds[2] or 0.0, (bounds[1] - bounds[0]) / 1000, 1e-12)

    def band(c: Column) -> Column:
        return F.floor((c - low) / width)

    cut = edges.where("y0 <> y1").withColumn("__b", F.explode(F.sequence(band(F.least("y0", "y1")), band(F.greatest("y0", "y1")))))
    spots = df.select(x, y).distinct().withColumn("__b", band(F.col(y)))
    crosses = ((F.col("y0") > F.col(y)) != (F.col("y1") > F.col(y))) & (F.col(x) < F.col("x0") + (F.col(y) - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    hits = spots.join(cut, "__b").where(crosses).groupBy(x, y, "name").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    named = hits.groupBy(x, y).agg(F.sort_array(F.collect_list("name")).alias(out))
    return df.join(named, [x, y], "left").select(*df.columns, out)


def masked(df: DataFrame, mask: Column, features: Sequence[str]) -> DataFrame:
    """Rows stay; features outside become null."""
    return df.withColumns({f: F.when(mask, F.col(f)) for f in features})


def select_regions(regions: DataFrame, name: str, wanted: Sequence[str]) -> DataFrame:
    """Rows whose trimmed, lower-cased name is among the wanted ones."""
    return regions.where(F.lower(F.trim(F.col(name))).isin([w.strip().lower() for w in wanted]))


def mask_extent(df: DataFrame, mask: Column, dims: Sequence[str]) -> DataFrame:
    """(min_<dim>, max_<dim>): what the true points span."""
    return df.where(mask).agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def raster(spark, rings: Sequence[Ring], width: int, height: int, largest_only: bool = True) -> DataFrame:
    """(row, col, inside) over the bounding box, from the top left; cells are judged by their centres."""
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    df = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), F.pmod("id", F.lit(width)).cast("int").alias("col"))
    x = F.lit(min(xs)) + (F.col("col") + 0.5) * ((max(xs) - min(xs)) / width)
    y = F.lit(max(ys)) - (F.col("row") + 0.5) * ((max(ys) - min(ys)) / height)
    return df.select("row", "col", inside(x, y, rings, largest_only).alias("inside"))
