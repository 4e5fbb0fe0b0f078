"""Packing documents into sequences, first fit decreasing over a tournament tree of bin capacities.

A document longer than a sequence is cut into full pieces, which are sequences by themselves, and a rest. The rests
fall into groups at random, and each group is packed by itself, so a task holds one group, whatever the table's size.

Nulls: a null text is empty, and a null doc_id is kept. Every document, repeated rows too, has its end id, so each has
at least one piece. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, prepare, written
from .encoding import encoder


#: Parts of texts that a worker keeps the ids of: fewer than elsewhere, as its executor has what earlier stages took.
CACHE = 200_000


@dataclass(frozen=True)
class Pack:
    tokenizer: str
    length: int = 2048
    end_id: int = 1
    group: int = 4096
    seed: int = 3


class Tournament:
    """Bins by number; each inner node has the larger free capacity of its two. Finds the first bin with room."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """The bin, and what it held before."""
        free, node = self.free, 1
        while node < self.width:
            node *= 2
            if free[node] < size:
                node += 1
        before = free[node]
        free[node] = before - size
        at = node
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return node - self.width, before


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, none over ``capacity``."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], before = tree.place(int(sizes[i]))
        offsets[i] = capacity - before
    return bins, offsets


def pieces(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece, in the order of the scan."""
    path, most, end = pack.tokenizer, pack.length, np.uint32(pack.end_id).tobytes()

    def cut(ids, texts):
        out = [[], [], [], [], []]
        for doc_id, found in zip(ids, encoder(path, CACHE).many([text or "" for text in texts])):
            raw = found.tobytes() + end
            n = len(raw) // 4
            for at in range(0, n, most):
                part = raw[4 * at : 4 * (at + most)]
                for col, x in zip(out, (doc_id, at, len(part) // 4, zlib.crc32(part), n)):
                    col.append(x)
        return out

    return arrow_rows(docs.select("doc_id", "text"), cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def packed(docs: DataFrame, pack: Pack) -> DataFrame:
    """A row per piece, with its sequence and its offset there."""
    prepare(docs.sparkSession)
    found = written(pieces(docs, pack).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-found.count() // pack.group))
    found = found.withColumn("pack_group", F.pmod(F.xxhash64("piece", F.lit(pack.seed)), F.lit(groups)))
    most = pack.length

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), most)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[NAMES]

    return found.groupBy("pack_group").applyInPandas(one, SCHEMA)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
