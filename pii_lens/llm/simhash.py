"""SimHash near-duplicates by a segment-popcount embedding.

A document's fingerprint has a bit for each majority among the hashes of its shingles. Fingerprints link at a Hamming
distance of 3 or less, and a document's component holds all that it reaches by links.

Each half of a distinct fingerprint is embedded as the bit counts of its 16 segments of 2 bits, a point of a grid. The
Manhattan distance of two points is at most the Hamming distance of the halves. Of two fingerprints that link, one half
differs in one bit at most, so there their points are the same or neighbours: each fingerprint stands in the cell of its
point and looks into that cell and those one step up, in either half. What meets is within the bound, and is then
compared bit by bit. Copies share a fingerprint and enter once, and links become components by stars
that shrink (large-star and small-star), so no group is gathered in one task.

Nulls: a null text has fingerprint zero; a null doc_id is in its component but names none, unless all are null.
Repeated rows give a row each. An empty table gives an empty result. Extra columns are not read. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_rows, prepare, written

SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENTS, LOW_BITS = 16, 0x55555555
#: The column that numbers rows while one of each component is chosen.
ROW = "row_of_near"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], length: int = SHINGLE) -> list[int]:
    """Hashes of all runs of ``length`` words; a shorter text is one shingle, one without words has none."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= length:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-length]]).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, (ends[length - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes of 64 bits; of none, zero."""
    n = len(hashes)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    return majority(np.array(shingle_hashes(words_of(text)), "<u8"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint, as a signed long, of every row."""
    prepare(docs.sparkSession)

    def run(ids, texts):
        return [ids, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()]

    return arrow_rows(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _point(fp: Column, half: int) -> Column:
    """The 16 bit counts of a half, 2 bits each in one number."""
    x = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return x.bitwiseAND(F.lit(LOW_BITS)) + F.shiftright(x, 1).bitwiseAND(F.lit(LOW_BITS))


def _steps_up(point: Column) -> Column:
    """The points one step up in a segment that isn't full."""
    segments = F.filter(F.array(*(F.lit(j) for j in range(SEGMENTS))), lambda j: F.call_function("shiftright", point, 2 * j).bitwiseAND(F.lit(3)) < 2)
    return F.transform(segments, lambda j: point + F.call_function("shiftleft", F.lit(1).cast("long"), 2 * j))


def _cell(half: int):
    """The number of a point's cell in the grid of a half."""
    return lambda point: point * 2 + half


def links(distinct: DataFrame) -> DataFrame:
    """Pairs a, b of the distinct fingerprints ``fp`` that link, each once or twice."""
    points = [_point(F.col("fp"), h) for h in (0, 1)]
    stands = distinct.select(F.col("fp").alias("a"), F.explode(F.array(*(_cell(h)(p) for h, p in enumerate(points)))).alias("cell"))
    looks = distinct.select(F.col("fp").alias("b"), F.explode(F.concat(*(F.transform(F.concat(F.array(p), _steps_up(p)), _cell(h)) for h, p in enumerate(points)))).alias("cell"))
    met = stands.join(looks, (stands["cell"] == looks["cell"]) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    return met.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, of all nodes of the edges (a, b) but for roots themselves."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w"), "least")
        # Large star: neighbours above u hang on the least around u.
        large = both.join(least, F.col("u") == F.col("w")).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = written(large, "stars")
        least = written(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")
        # Small star: u and its neighbours below hang on the least of them.
        small = edges.join(least, F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    found = written(fingerprints(docs), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    rooted = written(components(links(distinct.select("fp"))), "components")
    rooted = distinct.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids").withColumnRenamed("root", "r")
    named = written(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "named")
    return found.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``, written with a number for each row."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def place() -> Column:
    """A row's place in its group: by doc_id, none last, then by a hash of its text, then by its number."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", ROW)


def keep_rows(rows: DataFrame, firsts: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of each component of ``numbered`` rows. ``firsts`` has the first ``place`` of each node, ``rooted`` is as of ``components``."""
    at = rooted.select(F.col("node").alias("of_node"), "root")
    least = firsts.join(at, F.col("node") == F.col("of_node"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = least.select(F.col(f"first.{ROW}").alias("kept_row"))
    # Fewer go than stay, so the texts need not move where those that go can be broadcast.
    gone = written(rows.select(F.col(ROW).alias("gone_row")).join(kept, F.col("gone_row") == F.col("kept_row"), "left_anti"), "gone-rows")
    return rows.join(gone, F.col(ROW) == F.col("gone_row"), "left_anti").drop(ROW)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: the first by doc_id, none last; rows of one id by a hash of their text."""
    prepare(docs.sparkSession)
    rows = numbered(docs)

    def run(numbers, ids, marks, texts):
        return [numbers, ids, marks, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()]

    found = arrow_rows(rows.select(ROW, "doc_id", F.xxhash64("text").alias("mark"), "text"), run, f"{ROW} long, doc_id long, mark long, node long")
    firsts = written(found.groupBy("node").agg(F.min(place()).alias("first")), "firsts")
    return keep_rows(rows, firsts, components(links(firsts.select(F.col("node").alias("fp")))))
