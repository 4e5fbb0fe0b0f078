"""Substring dedup with a compressed FM-index per shard.

A window of ``WINDOW`` words that stands anywhere else is repeated, and all words of repeated windows go. Windows that
are equal hold the same least hash of ``GRAM`` words (their anchor), so equal windows can be routed to one place:

1. A scan cuts each document into stretches of windows that share an anchor. Stretches are counted by content: a
   stretch that stands whole more than once is repeated whole, and its copies count as one from here on.
2. Where an anchor has several different stretches, one document of each gives its words, and its windows are counted
   by hash. Windows that stand once go no further, so what is left around a common anchor are few different pieces.
3. Pieces are dealt to shards by anchor. A shard builds an FM-index of its pieces and streams them through it; backward
   search over the wavelet tree gives matching statistics, and windows where they reach ``WINDOW`` are reported.
4. What is reported of a stretch goes to all its copies and is taken out of the documents.

Every step's result is written in the shared folder. Nulls: a null text has no words; a null doc_id is an id like any
other. Repeated rows repeat each other, so their windows all go. An empty table gives an empty result. Extra columns
are kept as they are by ``cleaned`` and are not read by ``digests``. Texts are read whole.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, dropped, prepare, written
from .fm_index import FMIndex

WINDOW, GRAM = 35, 8
#: Words of one index; a shard with more builds one after another, without parting the pieces of an anchor.
INDEX_WORDS = 400_000


# --- hashes of words and of runs of words, all runs of a document at once ---------------------------------------------


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_BYTES, WORD_POWERS = _Powers(0xB492B66FBE98F273), _Powers(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A polynomial hash of values[start:end] for each pair, from one running sum."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = _SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return run_hashes(b.astype(np.uint64), edge[::2], edge[1::2], _BYTES)


def window_hashes(words: np.ndarray) -> np.ndarray:
    at = np.arange(len(words) - WINDOW + 1)
    return run_hashes(words, at, at + WINDOW, WORD_POWERS)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each run of ``width`` is, the leftmost of equals."""
    at, size = np.arange(len(h)), 1
    while 2 * size <= width:
        right = h[size:] < h[:-size]
        at, h = np.where(right, at[size:], at[:-size]), np.where(right, h[size:], h[:-size])
        size *= 2
    k, n = width - size, len(h) - (width - size)
    return np.where(h[k:] < h[:n], at[k:], at[:n])


def stretches(raw: bytes) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor and content hash of each stretch of a document."""
    words = word_hashes(raw)
    if len(words) < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(len(words) - GRAM + 1)
    grams = run_hashes(words, at, at + GRAM, WORD_POWERS)
    anchor = _least(grams, WINDOW - GRAM + 1)
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    first, last = cut[:-1], cut[1:]
    return first, last - first, grams[anchor[first]].view(np.int64), run_hashes(words, first, last + WINDOW - 1, WORD_POWERS).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows alike in both have the same result."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


_REFS = "doc_id long, text_hash long, first int, windows int, anchor long, stretch long"


def _refs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretches(t.encode()) for t in batch["text"].to_pylist()]
            sizes = [len(f[0]) for f in found]
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(rows), batch["text_hash"].take(rows), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3])],
                names=["doc_id", "text_hash", "first", "windows", "anchor", "stretch"],
            )

    return _keyed(docs).mapInArrow(run, _REFS)


def _content(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words and window hashes of stretches of ``wanted``, each from the document that stands for it; and a table to drop after."""
    table = written(wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "stretch", "n", "first", "windows")).alias("wanted")), "wanted")
    lists = table.select(F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"), "wanted")
    texts = _keyed(docs)
    found = texts.join(lists, texts["doc_id"].eqNullSafe(lists["its_id"]) & (texts["text_hash"] == lists["its_hash"])).select("text", "wanted")

    def run(texts, wanted):
        out = [[] for _ in range(5)]
        for text, asked in zip(texts, wanted):
            raw = text.encode()
            words, hashes = raw.split(), word_hashes(raw)
            windows = window_hashes(hashes).view(np.int64)
            for w in asked:
                a, n = w["first"], w["windows"]
                for col, x in zip(out, (w["anchor"], w["stretch"], w["n"], b" ".join(words[a : a + n + WINDOW - 1]).decode(), windows[a : a + n].tolist())):
                    col.append(x)
        return out

    # Rows alike in id and text give the same content; one of them is enough.
    return arrow_rows(found, run, "anchor long, stretch long, n long, content string, hashes array<long>").dropDuplicates(["anchor", "stretch"]), table


def _pieces(anchors, keys, counts, contents, masks):
    """Runs of windows that are left of each stretch: anchor, stretch, n, offset, words, and a hash of the words."""
    out = [[] for _ in range(6)]
    for anchor, key, n, content, mask in zip(anchors, keys, counts, contents, masks):
        words = content.split(" ")
        at = 0
        while mask >> at:
            if mask >> at & 1:
                end = at
                while mask >> end & 1:
                    end += 1
                text = " ".join(words[at : end + WINDOW - 1])
                digest = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
                for col, x in zip(out, (anchor, key, n, at, text, digest)):
                    col.append(x)
                at = end
            else:
                at += 1
    return out


def report(pieces: list[str], weights: list[int]) -> list[int]:
    """For each piece, a bit for each of its windows that stands twice or more among the pieces."""
    number: dict[str, int] = {}
    texts = [np.fromiter((number.setdefault(w, len(number) + 1) for w in p.split(" ")), np.int64) for p in pieces]
    index = FMIndex(texts, weights, WINDOW)
    text = np.concatenate([x for p in texts for x in (p, [0])])
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in texts])[:-1]])
    ends = np.concatenate([b + np.arange(WINDOW, len(p) + 1) for b, p in zip(begins, texts)])
    hit = index.matching(text, ends) == WINDOW
    out, at = [], 0
    for p in texts:
        n = len(p) - WINDOW + 1
        out.append(sum(1 << int(j) for j in np.flatnonzero(hit[at : at + n])))
        at += n
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their anchors: an index for every INDEX_WORDS of them, whole anchors each."""
    held: list[tuple] = []
    size = 0

    def flush():
        masks = report([h[2] for h in held], [h[3] for h in held]) if held else []
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(masks, pa.int64())], names=["anchor", "piece", "mask"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= INDEX_WORDS and row[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += row[2].count(" ") + 1
    yield flush()


def _release(spark) -> None:
    """Lets Spark delete the shuffle files of what has been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame) -> DataFrame:
    """Stretches with repeated windows: anchor, stretch, and a bit for each window of it."""
    spark = docs.sparkSession
    stands = _refs(docs).groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "first", "windows")).alias("place"))
    counted = written(stands.select("anchor", "stretch", "n", "place.*"), "stretches")
    _release(spark)
    several = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1").select(F.col("anchor").alias("on"), "kinds")
    several = written(several, "anchors")
    found = counted.join(several, F.col("anchor") == F.col("on")).drop("on")
    found = written(found, "candidates")
    dropped(counted, several)
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("windows")) - 1
    alone = found.where("kinds = 1").select("anchor", "stretch", whole.alias("mask"))

    content, lists = _content(docs, found.where("kinds > 1"))
    content = written(content, "content")
    dropped(lists)
    _release(spark)
    windows = content.select("anchor", "stretch", "n", F.posexplode("hashes").alias("at", "hash"))
    common = written(windows.groupBy("hash").agg(F.sum("n").alias("total")).where("total > 1").select(F.col("hash").alias("common")), "windows")
    left = windows.join(common, F.col("hash") == F.col("common")).groupBy("anchor", "stretch").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("left"))
    left = left.withColumnsRenamed({"anchor": "its_anchor", "stretch": "its_stretch"})
    kept = content.join(left, (F.col("anchor") == F.col("its_anchor")) & (F.col("stretch") == F.col("its_stretch"))).select("anchor", "stretch", "n", "content", "left")
    pieces = written(arrow_rows(kept, _pieces, "anchor long, stretch long, n long, at int, words string, piece long"), "pieces")
    dropped(content, common)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = written(pieces.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.first("words").alias("words")), "distinct-pieces")
    shards = once.select("anchor", "piece", "words", "n").repartition(parts, "anchor").sortWithinPartitions("anchor")
    table = written(shards.mapInArrow(_shard, "anchor long, piece long, mask long").where("mask > 0"), "reported")
    reported = table.withColumnsRenamed({"anchor": "its_anchor", "piece": "its_piece"})
    indexed = pieces.join(reported, (F.col("anchor") == F.col("its_anchor")) & (F.col("piece") == F.col("its_piece")))
    indexed = indexed.groupBy("anchor", "stretch").agg(F.bit_or(F.call_function("shiftleft", F.col("mask"), F.col("at"))).alias("mask"))
    out = written(alone.unionByName(indexed), "repeats")
    dropped(found, pieces, once, table)
    _release(spark)
    return out


def _with_masks(docs: DataFrame) -> DataFrame:
    """doc_id, text and the repeated windows: ``found``, a list of first windows and bits."""
    prepare(docs.sparkSession)
    table = repeats(docs)
    marked = table.withColumnsRenamed({"anchor": "its_anchor", "stretch": "its_stretch"})
    refs = _refs(docs)
    lists = refs.join(marked, (F.col("anchor") == F.col("its_anchor")) & (F.col("stretch") == F.col("its_stretch")))
    marks = written(lists.select("doc_id", "text_hash", "first", "mask"), "marks")
    dropped(table)
    _release(docs.sparkSession)
    lists = written(marks.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "mask")).alias("found")), "marked-documents")
    dropped(marks)
    _release(docs.sparkSession)
    return lists.withColumnsRenamed({"doc_id": "its_id", "text_hash": "its_hash"})


def kept_words(text: str | None, found: list | None) -> tuple[list[str], list[str]]:
    """The words of a text, and those in no repeated window."""
    words = [w.decode() for w in (text or "").encode().split()]
    if found is None or not len(found):
        return words, words
    edge = np.zeros(len(words) + 1, np.int64)
    for f in found:
        at = f["first"] + np.flatnonzero(np.array([f["mask"] >> j & 1 for j in range(f["mask"].bit_length())]))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return words, [w for w, k in zip(words, keep.tolist()) if k]


def _joined(docs: DataFrame) -> DataFrame:
    lists, keyed = _with_masks(docs), docs.withColumn("hash_of_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(lists, keyed["doc_id"].eqNullSafe(lists["its_id"]) & (keyed["hash_of_text"] == lists["its_hash"]), "left")


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by spaces."""

    def run(ids, texts, found):
        out = [ids, [], [], []]
        for text, f in zip(texts, found):
            words, kept = kept_words(text, f)
            for col, x in zip(out[1:], (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())):
                col.append(x)
        return out

    return arrow_rows(_joined(docs.select("doc_id", "text")).select("doc_id", "text", "found"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words, joined by spaces, for its text where words went."""
    text = F.pandas_udf(lambda t, f: t.combine(f, lambda a, b: " ".join(kept_words(a, b)[1])), "string")
    out = _joined(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row_kept")))
    out = out.withColumn("text", F.when(F.col("found").isNull(), F.col("text")).otherwise(text("text", "found")))
    return out.select(F.col("row_kept").withField("text", F.col("text")).alias("row_kept")).select("row_kept.*")
