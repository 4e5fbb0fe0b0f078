"""Language identification: known words first, then backing off to character n-grams.

The model holds, for each language, log frequencies of its commonest words and of its commonest character n-grams of
each order. A known word scores by its frequency in each language. An unseen word is scored by the longest order of
which it has known n-grams, each n-gram that is unknown at that order falling back to the next shorter one. A document's
language has the highest sum over its words; equal sums go to the smaller language by code point.

The model is fitted on a sample of about ``Fit.documents`` labelled documents, drawn by a hash of their doc_id from all
rows of each language: as many of each, or all that there are, so a rare language is learned in a table of any size. It
keeps about ``Fit.words`` words a language and ``Fit.grams`` n-grams a language and order, the commonest; of those that are
equally common at the bound a hash chooses. So what is broadcast grows with the languages, not with the data.

Nulls: a null text, or one without a letter, is ``und`` with score 0; a null lang is not learned from; a null doc_id is
predicted, not held out and not learned from. Where nothing is learned, every document is ``und``. Repeated rows give a
row each. Extra columns are not read.
"""

from __future__ import annotations

import re
import weakref
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_rows, dropped, prepare, written

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Unseen words that a worker keeps scores of, and words of a text over which its certainty is counted.
CACHE, SURE_WORDS = 500_000, 20
#: Parts into which a hash deals items that are equally common where not all have room.
TIES = 1 << 20


@dataclass(frozen=True)
class Fit:
    documents: int = 8000
    least: int = 20  # documents of each language, however many languages there are
    words: int = 20_000
    grams: int = 10_000
    orders: tuple[int, ...] = (5, 4, 3, 2, 1)
    seed: int = 2


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)] if order > 1 else list(word)


@dataclass
class Model:
    """Rows of log frequencies by language: ``table`` for words, ``gram_table`` for n-grams of all orders."""

    langs: list[str]
    words: dict[str, int]
    table: np.ndarray
    grams: list[dict[str, int]]  # by order, longest first, each order one less than the last
    gram_table: np.ndarray
    orders: tuple[int, ...]
    floor: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the word's n-grams. One that is unknown gives way to the two shorter ones in it, and so on down."""
        padded, found = f"<{word}>", []
        first = next(k for k, o in enumerate(self.orders) if o <= len(padded))
        starts = set(range(len(padded) - self.orders[first] + 1))
        for known, order in zip(self.grams[first:], self.orders[first:]):
            shorter: set[int] = set()
            for at in starts:
                if (row := known.get(padded[at : at + order])) is not None:
                    found.append(row)
                else:
                    shorter.add(at)
                    shorter.add(at + 1)
            if not shorter:
                break
            starts = shorter
        return self.gram_table[found].mean(0) if found else self.floor

    @cached_property
    def rows(self) -> Rows:
        return Rows(self)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text and self.langs else []
        if not found or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        counts = Counter(found)
        self.rows.make_room(len(counts))
        at = list(map(self.rows.__getitem__, counts))
        sums = np.fromiter(counts.values(), np.float64, len(counts)) @ self.rows.table[at]
        best = int(np.argmax(sums))
        mean = (sums - sums[best]) / len(found) * min(len(found), SURE_WORDS)
        return self.langs[best], float(1 / np.exp(mean).sum())


class Rows(dict):
    """From a word to its row, in a worker: known words first, then unseen ones, as many as there is room for."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.next = weakref.proxy(model), len(model.words)  # no cycle: all goes with the model
        self.table = np.empty((len(model.table) + CACHE, len(model.langs)))  # rows take memory once they are written
        self.table[: len(model.table)] = model.table

    def make_room(self, n: int) -> None:
        """Room for ``n`` words; unseen ones start anew where there is none."""
        if self.next + n > len(self.table):
            self.clear()
            self.update(self.model.words)
            self.next = len(self.model.words)
            if self.next + n > len(self.table):
                self.table = np.vstack([self.table, np.zeros((n, self.table.shape[1]))])

    def __missing__(self, word: str) -> int:
        self.table[self.next] = self.model.unseen(word)
        self[word] = self.next
        self.next += 1
        return self.next - 1


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def level(sizes: list[int], total: int) -> int:
    """How many to take of each at most, so that there are ``total`` of all at most."""
    sizes = sorted(sizes)
    for i, n in enumerate(sizes):
        if n * (len(sizes) - i) > total:
            return total // (len(sizes) - i)
        total -= n
    return sizes[-1] if sizes else 0


def train(docs: DataFrame, fit: Fit = Fit()) -> Model:
    """A model of the labelled documents that are not held out."""
    prepare(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    most = max(fit.least, level(list(sizes.values()), fit.documents))
    below = docs.sparkSession.createDataFrame([(lang, int(min(1.0, most / n) * (1 << 40))) for lang, n in sizes.items()], "lang string, below long")
    drawn = labelled.select("doc_id", "lang", "text").join(F.broadcast(below), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(fit.seed)), F.lit(1 << 40)) < F.col("below"))
    orders = fit.orders

    def count(langs, texts):
        got: dict = defaultdict(Counter)
        for lang, text in zip(langs, texts):
            words = Counter(words_of(text))
            got[lang, 0].update(words)
            for word, n in words.items():
                for order in orders:
                    if order == 1 or len(word) + 2 >= order:
                        kind = got[lang, order]
                        for gram in grams_of(word, order):
                            kind[gram] += n
        rows = [(lang, order, item, n) for (lang, order), c in got.items() for item, n in c.items()]
        return [list(x) for x in zip(*rows)] if rows else [[], [], [], []]

    counts = arrow_rows(drawn.select("lang", "text"), count, "lang string, kind int, item string, n long")
    counts = written(counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "language-counts")
    # The commonest of each kind: rank by how many of the kind are as common, from a histogram, not by a sort of the kind.
    histogram = counts.groupBy("lang", "kind", "n").agg(F.count("*").alias("items"))
    keep: dict[tuple, tuple[int, int]] = {}  # the least count that has room, and what share of the items of that count
    running: Counter = Counter()
    totals: Counter = Counter()
    for r in histogram.orderBy("lang", "kind", F.desc("n")).toLocalIterator():
        key = (r["lang"], r["kind"])
        room = (fit.grams if r["kind"] else fit.words) - running[key]
        running[key] += r["items"]
        totals[key] += r["items"] * r["n"]
        if room > 0:
            keep[key] = (r["n"], min(TIES, room * TIES // r["items"]))
    if not keep:
        dropped(counts)
        return Model([], {}, np.zeros((0, 0)), [{} for _ in orders], np.zeros((0, 0)), orders, np.zeros(0))
    bounds = docs.sparkSession.createDataFrame([(*key, *kept) for key, kept in keep.items()], "lang string, kind int, least long, share long")
    among = (F.col("n") > F.col("least")) | (F.col("n") == F.col("least")) & (F.pmod(F.xxhash64("item"), F.lit(TIES)) < F.col("share"))
    chosen = counts.join(F.broadcast(bounds), ["lang", "kind"]).where(among).drop("least", "share").toPandas()
    dropped(counts)
    langs = sorted({a for a, _ in keep})
    at = {lang: i for i, lang in enumerate(langs)}
    tables: list[tuple[dict[str, int], np.ndarray]] = []
    for kind in (0, *orders):
        part = chosen[chosen["kind"] == kind]
        number: dict[str, int] = {}
        rows = [number.setdefault(item, len(number)) for item in part["item"]]
        raw = np.zeros((len(number), len(langs)))
        raw[rows, [at[lang] for lang in part["lang"]]] = part["n"]
        size = np.array([totals[lang, kind] + 0.5 * max(1, len(number)) for lang in langs])
        tables.append((number, np.log((raw + 0.5) / size)))
    grams, start = [], 0
    for number, _ in tables[1:]:
        grams.append({item: row + start for item, row in number.items()})
        start += len(number)
    return Model(langs, *tables[0], grams, np.vstack([t for _, t in tables[1:]]), orders, np.full(len(langs), -12.0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, held, texts):
        m = shared.value
        got = [m.predict(t) for t in texts]
        return [ids, held, [a for a, _ in got], [b for _, b in got]]

    return arrow_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is ``und`` or whose score is under ``least``, all columns as they were."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def certain(texts):
        return texts.map(lambda t: (got := shared.value.predict(t))[0] != UNKNOWN and got[1] >= least)

    return docs.where(F.pandas_udf(certain, "boolean")("text"))
