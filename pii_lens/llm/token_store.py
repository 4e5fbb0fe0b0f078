"""Token ids in a content-addressed store.

Rolling hashes over a document's ids cut them into chunks where the content says so, so that equal passages give equal
chunks. The store has three tables under its folder:

* ``chunks/kind=chunk``: digest, ids (packed in 2 or 4 bytes each), each distinct chunk once;
* ``recipes``: a row per document in ascending doc_id order, in files that follow each other: its number of ids, its
  chunks in order and the Merkle root of their digests;
* ``manifest``: a row for each ``BLOCK`` documents of a recipe file: how many they are, their ids, how many ids come
  before them, a checksum of their recipes, and the Merkle root of their documents' roots; and a row for all, with the root
  of the files' roots.

Reading back recomputes the manifest from the recipes and raises if any row of either is missing or other than it was;
computes documents' Merkle roots anew; hashes every chunk again; raises where a document lacks one; and computes each
document's checksum from its chunks' checksums, which combine, so no chunk is moved to the documents that hold it. ``ids`` does move them,
and gives the documents' ids.

Nulls: a null text is empty (its end id alone); a null doc_id comes first. Repeated rows are documents of their own;
equal doc_ids follow each other in the order of the scan. An empty table gives an empty store. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, new_path, prepare
from .encoding import encoder


@dataclass(frozen=True)
class Store:
    tokenizer: str
    end_id: int = 0
    mean_bits: int = 9
    least: int = 64
    most: int = 4096
    window: int = 8


# --- chunks ---------------------------------------------------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def _turns(window: int) -> list[np.uint64]:
    return [np.uint64(pow(int(_MIX), 2 * j + 1, 1 << 64)) for j in range(window)]


def borders(ids: np.ndarray, store: Store) -> list[int]:
    """Where the chunks of one document end. A border depends on the ``window`` ids before it alone."""
    n = len(ids)
    if n <= store.least:
        return [n]
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    h = x.copy()
    for j, turn in enumerate(_turns(store.window)[1:], 1):  # a sum over the last ids, each turned by its distance
        h[j:] += x[: n - j] * turn
    hits = np.flatnonzero((h >> np.uint64(64 - store.mean_bits)) == 0) + 1
    ends, last = [], 0
    for at in hits.tolist():
        while at - last > store.most:
            last += store.most
            ends.append(last)
        if at - last >= store.least:
            ends.append(at)
            last = at
    while n - last > store.most:
        last += store.most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd last node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        paired = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(paired) * 2 :]
    return level[0] if level else hashlib.sha256(b"").digest()


# --- checksums that combine -------------------------------------------------------------------------------------------

_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo CRC-32's, reflected."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), b >> np.uint64(1) ^ _POLY, b >> np.uint64(1))
    return out


@lru_cache(maxsize=64)
def _tables(k: int) -> tuple[np.uint64, np.ndarray]:
    """x^8 to the power 2^k, and its products with each value of each of the four bytes."""
    power = np.uint64(1 << 23) if k == 0 else _times(*(np.array([_tables(k - 1)[0]]),) * 2)[0]
    of = np.arange(256, dtype=np.uint64) << (np.arange(4, dtype=np.uint64) * np.uint64(8))[:, None]
    return power, _times(np.broadcast_to(power, of.shape), of)


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The part that a block's CRC-32 has in that of the whole, if so many bytes follow it; parts combine by xor."""
    crc, n = crc.astype(np.uint64), n_bytes.astype(np.uint64)
    for k in range(int(n.max(initial=0)).bit_length()):
        odd = (n >> np.uint64(k) & np.uint64(1)).astype(bool)
        x, of = crc[odd], _tables(k)[1]
        crc[odd] = of[0][x & np.uint64(255)] ^ of[1][x >> np.uint64(8) & np.uint64(255)] ^ of[2][x >> np.uint64(16) & np.uint64(255)] ^ of[3][x >> np.uint64(24)]
    return crc


# --- writing ----------------------------------------------------------------------------------------------------------

_CUT = "doc long, doc_id long, ord int, n int, after long, digest binary, ids binary"


def _cut(docs: DataFrame, store: Store) -> DataFrame:
    """A row per chunk; ``ids`` is null where the same task has given them before."""
    path, end = store.tokenizer, np.uint32(store.end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        enc = encoder(path)
        wide = enc.tokenizer.get_vocab_size() > 1 << 16
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            numbers, doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for doc, doc_id, found in zip(numbers, doc_ids, enc.many([text or "" for text in texts])):
                ids = np.append(found, end)
                small, last = ids.astype("<u4" if wide else "<u2"), 0
                for k, at in enumerate(borders(ids, store)):
                    raw = small[last:at].tobytes()
                    digest = hashlib.sha256(raw).digest()
                    new = digest not in seen
                    seen.add(digest)
                    for col, x in zip(out, (doc, doc_id, k, at - last, len(ids) - at, digest, raw if new else None)):
                        col.append(x)
                    last = at
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_NAMES)

    return docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text").mapInArrow(run, _CUT)


_NAMES = [x.split()[0] for x in _CUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _keep_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows as references, and the first ids of each digest as a chunk. Equal digests with ids meet in one task."""
    seen: set[bytes] = set()
    for batch in batches:
        t = pa.Table.from_batches([batch])
        mine = []
        for digest, has in zip(t["digest"].to_pylist(), t["ids"].is_valid().to_pylist()):
            mine.append(has and digest not in seen)
            if mine[-1]:
                seen.add(digest)
        chunks = t.filter(pa.array(mine, pa.bool_()))
        refs = t.set_column(_NAMES.index("ids"), "ids", pa.nulls(len(t), pa.binary()))
        for part, kind in ((chunks, "chunk"), (refs, "ref")):
            yield from part.append_column("kind", pa.array([kind] * len(part), pa.string())).combine_chunks().to_batches()


def write(docs: DataFrame, path: str, store: Store) -> None:
    """Writes the store under ``path``, a folder that driver and executors share."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # References spread at random, so that a chunk of very many documents loads no single task.
    key = F.when(F.col("ids").isNull(), F.xxhash64("doc", "ord")).otherwise(F.xxhash64("digest"))
    dealt = _cut(docs, store).repartition(parts, key)
    dealt.mapInArrow(_keep_once, _CUT + ", kind string").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/chunks")

    refs = spark.read.schema(_CUT + ", kind string").parquet(f"{path}/chunks").where("kind = 'ref'")
    recipes = refs.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.sum("n").cast("long").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("ord", "n", "after", "digest"))).alias("chunks"))
    recipes = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "doc").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "doc")
    recipes = recipes.withColumn("root", _root("chunks.digest"))  # here, as what is dealt by range is computed twice, once to draw the ranges
    # The number of a row within its sorted partition, above which its partition's stands.
    recipes.withColumn("place", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks/kind=ref")  # the recipes have it all
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _manifest(spark.read.schema(_RECIPES).parquet(f"{path}/recipes")).coalesce(1).write.parquet(f"{path}/manifest")


def _root(of: str):
    return F.pandas_udf(lambda s: s.map(lambda x: merkle(list(x))), "binary")(F.col(of))


#: Documents under one row of the manifest.
BLOCK = 4096
_RECIPES = "doc long, doc_id long, n_tokens long, chunks array<struct<ord:int,n:int,after:long,digest:binary>>, root binary, place long"
_MANIFEST = "file long, block long, docs long, ids long, check long, before long, root binary"


def _file(place: str = "place"):
    return F.shiftright(place, 33)


def _block(place: str = "place"):
    return F.floor(F.pmod(F.col(place), F.lit(1 << 33)) / BLOCK)


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row per block of documents, and one (of null file) for all. No row holds more than a block's or a file's roots.

    ``check`` is over all that a recipe says; roots are over the chunks alone, for who holds only those.
    """
    blocks = recipes.select(_file().alias("file"), _block().alias("block"), "n_tokens", F.xxhash64("doc", "doc_id", "n_tokens", "chunks", "place").alias("check"), F.struct("place", "root").alias("leaf"))
    blocks = blocks.groupBy("file", "block").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"), F.bit_xor("check").alias("check"), F.array_sort(F.collect_list("leaf")).alias("leaves")).withColumn("root", _root("leaves.root")).drop("leaves")
    files = blocks.groupBy("file").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"), F.bit_xor("check").alias("check"), F.array_sort(F.collect_list(F.struct("block", "root"))).alias("leaves")).withColumn("root", _root("leaves.root")).drop("leaves")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select(F.col("file").alias("of_file"), F.coalesce(F.sum("ids").over(ahead(Window.orderBy("file"))), F.lit(0)).alias("begin"))  # a row per file
    rows = blocks.join(F.broadcast(begins), F.col("file") == F.col("of_file"))
    before = F.col("begin") + F.coalesce(F.sum("ids").over(ahead(Window.partitionBy("file").orderBy("block"))), F.lit(0))
    whole = files.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.coalesce(F.bit_xor("check"), F.lit(0)).alias("check"), F.array_sort(F.collect_list(F.struct("file", "root"))).alias("leaves")).withColumn("root", _root("leaves.root"))
    none = F.lit(None).cast("long")
    return rows.select("file", "block", "docs", "ids", "check", before.alias("before"), "root").unionByName(whole.select(none.alias("file"), none.alias("block"), "docs", "ids", "check", F.lit(0).cast("long").alias("before"), "root"))


# --- reading ----------------------------------------------------------------------------------------------------------


def _checked(digests, raws, counts):
    """Digest, checksum of the ids in 32 bits; an error if the ids are not those of the digest."""
    out = [[], [], []]
    for digest, raw, n in zip(digests, raws, counts):
        got = hashlib.sha256(raw).digest()
        if got != digest:
            raise ValueError(f"chunk {digest.hex()} holds other ids")
        ids = np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u2").astype("<u4")
        for col, x in zip(out, (got, zlib.crc32(ids.tobytes()), len(ids))):
            col.append(x)
    return out


def _verified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Recipes and manifest, once each is what the other says; an error if a row of either is missing or another.

    Documents' roots are computed anew from their chunks' digests."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    told = manifest.select(F.col("file").alias("a"), F.col("block").alias("b"), F.struct("docs", "ids", "check", "before", "root").alias("told"))
    found = _manifest(recipes.withColumn("root", _root("chunks.digest"))).select(F.col("file").alias("c"), F.col("block").alias("d"), F.struct("docs", "ids", "check", "before", "root").alias("found"))
    met = told.join(found, F.col("a").eqNullSafe(F.col("c")) & F.col("b").eqNullSafe(F.col("d")), "full_outer")
    bad = met.where(~F.col("told").eqNullSafe(F.col("found"))).select(F.coalesce("a", "c").alias("file"), F.coalesce("b", "d").alias("block")).limit(1).collect()
    if bad or not manifest.where("file is null").limit(1).collect():
        raise ValueError(f"the store's recipes are not those of its manifest: {bad[0] if bad else 'no row for all'}")
    return recipes, manifest.where("file is not null")


def _steps(recipes: DataFrame) -> DataFrame:
    """A row per chunk of a recipe: doc, ord, n, digest, and how many ids of the document come after it."""
    return recipes.select("doc", F.explode("chunks").alias("x")).select("doc", "x.ord", "x.n", "x.digest", "x.after")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CUT + ", kind string").parquet(f"{path}/chunks").where("kind = 'chunk'").select("digest", "ids", "n")


def _in_place(recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc, doc_id, n_tokens, root and start, the ids of all documents before; placed by the few rows of the manifest."""
    rows = recipes.select("doc", "doc_id", "n_tokens", "root", "place", _file().alias("file"), _block().alias("block"))
    before = manifest.select("file", "block", "before")
    earlier = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, ["file", "block"]).select("doc", "doc_id", "n_tokens", "root", (F.col("before") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("start"))


def _or_raise(whole, value, kind: str):
    lost = F.concat(F.lit("document not whole in the store: "), F.col("doc").cast("string"))
    return F.when(F.coalesce(whole, F.lit(False)), value).otherwise(F.raise_error(lost).cast(kind))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per document, verified: doc_id, start, n_tokens, ids_crc32 and its Merkle root."""
    prepare(spark)
    recipes, manifest = _verified(spark, path)
    chunks = arrow_rows(_chunks(spark, path), _checked, "digest binary, crc long, chunk_n int")
    part = F.pandas_udf(lambda crc, after: pd.Series(shifted(crc.to_numpy(), after.to_numpy() * 4).astype(np.int64)), "long")
    found = _steps(recipes).join(chunks, "digest").where("n = chunk_n").select("doc", "n", part("crc", "after").alias("part"))
    docs = found.groupBy(F.col("doc").alias("its_doc")).agg(F.bit_xor("part").alias("crc"), F.sum("n").alias("got"))
    out = _in_place(recipes, manifest).join(docs, F.col("doc") == F.col("its_doc"), "left")
    return out.select("doc_id", "start", "n_tokens", _or_raise(F.col("got") == F.col("n_tokens"), F.col("crc"), "long").alias("ids_crc32"), F.hex("root").alias("root"))


def ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of every document, rebuilt by its recipe from verified chunks."""
    prepare(spark)
    recipes, manifest = _verified(spark, path)

    def opened(digests, raws, counts):
        _checked(digests, raws, counts)
        return [digests, [np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u2").astype(np.int64).tolist() for raw, n in zip(raws, counts)]]

    chunks = arrow_rows(_chunks(spark, path), opened, "digest binary, ids array<long>")
    docs = _steps(recipes).join(chunks, "digest").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "ids"))).alias("parts"))
    out = _in_place(recipes, manifest).join(docs.withColumnRenamed("doc", "its_doc"), F.col("doc") == F.col("its_doc"), "left").withColumn("ids", F.flatten("parts.ids"))
    return out.select("doc_id", "start", _or_raise(F.size("ids") == F.col("n_tokens"), F.col("ids"), "array<long>").alias("ids"))


def round_trip(docs: DataFrame, store: Store) -> DataFrame:
    path = new_path(docs.sparkSession, "token-store")
    write(docs, path, store)
    return read(docs.sparkSession, path)
