"""Box algebra over relations of boxes: union, containment, veto, merge, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.boxes import box, iou, overlap_fraction
from .grouped import by_group

# Entity types that a protected region may veto, and from what overlap on.
VETOED, VETO_FROM = ("PERSON", "LOCATION", "ORGANIZATION", "NRP"), 0.5
# Gaps within a block, in median heights of its label.
BLOCK_VERTICAL, BLOCK_HORIZONTAL = 1.6, 0.5
GEOMETRY = ["left", "top", "width", "height"]


def union_variants(boxes: DataFrame) -> DataFrame:
    """Exact duplicates within a page dropped; that of the first variant, then the first position, stays."""
    order = Window.partitionBy("page_id", "label", *GEOMETRY).orderBy("variant", "pos")
    return boxes.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def drop_contained(regions: DataFrame) -> DataFrame:
    """Regions of a page that no earlier region (by ``seq``) holds whole. What holds is transitive, so any earlier one counts."""
    a, b = regions.alias("a"), regions.alias("b")
    inside = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("b.seq") < F.col("a.seq"))
    inside &= (F.col("b.left") <= F.col("a.left")) & (F.col("b.top") <= F.col("a.top"))
    inside &= (F.col("a.left") + F.col("a.width") <= F.col("b.left") + F.col("b.width")) & (F.col("a.top") + F.col("a.height") <= F.col("b.top") + F.col("b.height"))
    return a.join(b, inside, "left_anti")


def veto(boxes: DataFrame, protected: DataFrame) -> DataFrame:
    """Boxes without names, places and the like that a protected region of the page covers by half."""
    a, b = boxes.alias("a"), protected.alias("b")
    hit = (F.col("a.page_id") == F.col("b.page_id")) & F.col("a.label").isin(*VETOED) & (overlap_fraction(box("a."), box("b.")) >= VETO_FROM)
    return a.join(b, hit, "left_anti")


def union_geometry(*sources: DataFrame) -> DataFrame:
    """Boxes of several detectors; of those with the same place on a page, whatever their kinds, that of the first source stays.

    Sources are (page_id, label, left, top, width, height); of one source's the first label in order stays.
    """
    every = None
    for k, boxes in enumerate(sources):
        one = boxes.select("page_id", "label", *GEOMETRY, F.lit(k).alias("source"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("page_id", *GEOMETRY).agg(F.min(F.struct("source", "label")).alias("first")).select("page_id", "first.label", *GEOMETRY)


def vetoed_counts(boxes: DataFrame, protected: DataFrame) -> DataFrame:
    """(page_id, withdrawn): how many boxes of each page ``veto`` drops; pages that lose none have no row."""
    a, b = boxes.alias("a"), protected.alias("b")
    hit = (F.col("a.page_id") == F.col("b.page_id")) & F.col("a.label").isin(*VETOED) & (overlap_fraction(box("a."), box("b.")) >= VETO_FROM)
    return a.join(b, hit, "left_semi").groupBy("page_id").agg(F.count("*").alias("withdrawn"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The upper of the middle two, from counts of the distinct values, so that no group is gathered; null values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    half = F.floor(F.sum("__n").over(Window.partitionBy(*by)) / 2)
    return counts.select(*by, value, (upto > half).alias("__there")).where("__there").groupBy(*by).agg(F.min(value).alias("upper_median"))


def _merge(rects: list[list[int]], v: float, h: float) -> list[list[int]]:
    """Rectangles (left, top, right, bottom) joined while two are near; growing only nears them, so the result is one."""
    done: list[list[int]] = []
    todo = sorted(rects)
    while todo:
        now = todo.pop()
        met = next((d for d in done if max(0, max(d[1], now[1]) - min(d[3], now[3])) <= v and max(0, max(d[0], now[0]) - min(d[2], now[2])) <= h), None)
        if met is None:
            done.append(now)
        else:
            done.remove(met)
            todo.append([min(met[0], now[0]), min(met[1], now[1]), max(met[2], now[2]), max(met[3], now[3])])
    return done


def merge_blocks(boxes: DataFrame) -> DataFrame:
    """Boxes of one page and label that stand within a line of each other, joined to their rectangle until none is left to join."""

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        heights = sorted(r[3] for r in rows)
        m = heights[len(heights) // 2]
        got = _merge([[x, y, x + w, y + h] for x, y, w, h in rows], m * BLOCK_VERTICAL, m * BLOCK_HORIZONTAL)
        return [(*key, a, b, c - a, d - b) for a, b, c, d in sorted(got)]

    return by_group(boxes.select("page_id", "label", *GEOMETRY), ["page_id", "label"], GEOMETRY, one, f"page_id {boxes.schema['page_id'].dataType.simpleString()}, label string, left int, top int, width int, height int")


def agreement(ours: DataFrame, theirs: DataFrame, least: float = 0.9) -> DataFrame:
    """Per page: boxes matched at ``least``, the larger number of boxes, the worst best match."""
    a, b = ours.alias("a"), theirs.alias("b")
    best = a.join(b, F.col("a.page_id") == F.col("b.page_id"), "left").groupBy(F.col("a.page_id").alias("page_id"), F.col("a.pos").alias("pos")).agg(F.max(iou(box("a."), box("b."))).alias("best"))
    mine = best.groupBy("page_id").agg(F.count_if(F.col("best") >= least).alias("matched"), F.count("*").alias("n"), F.min(F.coalesce("best", F.lit(0.0))).alias("worst"))
    other = theirs.groupBy("page_id").agg(F.count("*").alias("m"))
    return mine.join(other, "page_id", "full_outer").select("page_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("boxes"), F.round(F.coalesce("worst", F.lit(0.0)), 6).alias("worst"))
