"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks within their source. Each source's target is so many whole passes over its blocks and a
part of one more. The quotas of blocks are split exactly among the output shards by a binary tree: at a node, what the
left half of the shards gets is one multivariate-hypergeometric draw from the node's quotas. Every shard then takes the
next blocks of each source's permutation, so blocks of one pass are disjoint between shards, and shuffles its
documents locally. All draws come from one seed, so reruns agree.

Nulls: a null text has size 0; the null source is a source of its own and comes last. Repeated rows count and are
taken each for itself. An empty table gives an empty result. Only the named columns are read; others stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import WORD, prepare, written

#: Most blocks that all sources have together: the bound of what the driver plans with and broadcasts.
MAX_BLOCKS = 1 << 16


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    most_repeats: int = 3
    block_words: int = 1 << 15
    shards: int = 16  # at least; a shard has about shard_words
    shard_words: int = 1 << 21
    seed: int = 8


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of sizes by weight; none above ``most`` times its size, the excess reshared by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        shares = {i: total * weights[i] / w for i in open_}
        full = [i for i in open_ if shares[i] > most * sizes[i]]
        if not full:
            for i, x in shares.items():
                out[i] = x
            break
        for i in full:
            out[i] = float(most * sizes[i])
            total -= out[i]
            open_.remove(i)
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[source] blocks dealt among shards: [shard, source], with equal row sums (within one) and exact column sums."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    n = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, n, method="marginals") if n else np.zeros_like(quotas)
    return np.vstack([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def shard_count(words: int, mix: Mix) -> int:
    """Shards of about as many words each, whatever the size of the mix; a shard takes 16 blocks at least of the most there are."""
    return max(mix.shards, min(words // mix.shard_words, MAX_BLOCKS // 16))


def size_of(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of("text").alias("size"))


def assign(rows: DataFrame, mix: Mix = Mix(), onto: DataFrame | None = None) -> DataFrame:
    """``onto``, or else ``rows``, with source_size, target, taken and draws.

    ``rows`` has doc_id, source and size of every document; it is written, as it is read twice. ``onto`` has the same
    three columns and others that the result keeps.

    ``draws`` has a struct (pass, shard, words) for each time that the document is drawn; ``words`` is its size but for
    the one document of a source at which the target is reached, which is cut.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_BLOCKS // 4 + 1).collect()
    if len(totals) > MAX_BLOCKS // 4:
        raise ValueError(f"more than {MAX_BLOCKS // 4} sources")
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in totals]
    goal = targets(sizes, [mix.weights[i % len(mix.weights)] for i in range(len(sizes))], mix.most_repeats)
    words = max(mix.block_words, sum(sizes) * 2 // MAX_BLOCKS + 1)
    n_blocks = [max(1, -(-x // words)) for x in sizes]
    passes = [min(int(g // s), mix.most_repeats) if s else 0 for g, s in zip(goal, sizes)]
    rest = [round(g) - p * s for g, p, s in zip(goal, passes, sizes)]
    sources = spark.createDataFrame(
        [(r["source"], i, n_blocks[i], sizes[i], goal[i]) for i, r in enumerate(totals)], "source string, sid int, n_blocks int, source_size long, target double"
    )
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(mix.seed)), F.col("n_blocks")).cast("int")

    def place(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(sources), df["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("block", block)

    weight = {(r["sid"], r["block"]): int(r["w"]) for r in place(rows).groupBy("sid", "block").agg(F.sum("size").alias("w")).collect()}

    rng = np.random.default_rng(mix.seed)
    drawn: list[list[tuple[int, int]]] = []  # of each source, its (pass, block) in order
    cut: dict[tuple[int, int, int], int] = {}  # words that the last block gives
    for i in range(len(sizes)):
        order = [(p, int(b)) for p in range(passes[i]) for b in rng.permutation(n_blocks[i])]
        have = 0
        for b in map(int, rng.permutation(n_blocks[i])):
            if have >= rest[i]:
                break
            if (w := weight.get((i, b), 0)) > rest[i] - have:
                cut[i, passes[i], b] = rest[i] - have
            order.append((passes[i], b))
            have += w
        drawn.append(order)
    shards = shard_count(sum(sizes), mix)
    quotas = split_tree(np.array([len(x) for x in drawn], dtype=np.int64), shards, rng) if drawn else np.zeros((shards, 0), int)
    plan = []
    for i, order in enumerate(drawn):
        shard_of = np.repeat(np.arange(shards), quotas[:, i])
        by_block: dict[int, list] = {}
        for (p, b), shard in zip(order, shard_of):
            by_block.setdefault(b, []).append((p, int(shard), cut.get((i, p, b), -1)))
        plan += [(i, b, max((c for *_, c in x), default=-1), x) for b, x in by_block.items()]
    plan = spark.createDataFrame(plan, "sid int, block int, cut long, draws array<struct<pass:int,shard:int,limit:long>>")
    found = place(rows if onto is None else onto).join(F.broadcast(plan), ["sid", "block"], "left")
    # Only the one cut block of a source needs its documents in order; a block has about block_words words.
    ahead = Window.partitionBy("sid", "block").orderBy(F.xxhash64("doc_id", F.lit(mix.seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    is_cut = F.coalesce(F.col("cut"), F.lit(-1)) >= 0
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.coalesce(F.sum("size").over(ahead), F.lit(0))))
    found = found.where(~is_cut).withColumn("part", F.col("size")).unionByName(found.where(is_cut).withColumn("part", part))
    draws = F.transform(
        F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int,limit:long>>")),
        lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["limit"] >= 0, F.col("part")).otherwise(F.col("size")).alias("words")),
    )
    found = found.withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return found.withColumn("taken", taken).drop("sid", "block", "n_blocks", "cut", "part")


def mixed_sizes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row per document: doc_id, size, source_size, target and taken words, and the shards that drew it."""
    prepare(docs.sparkSession)
    rows = written(sized(docs), "mix-sizes")
    return assign(rows, mix).select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time that it is drawn, in shards shuffled locally.

    A cut document's text ends with the last word that fits. Documents without a word are in no mix.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = written(sized(docs), "mix-sizes")
    whole = docs.select("doc_id", "source", size_of("text").alias("size"), F.struct(*docs.columns).alias("row_of_mix"))
    out = assign(rows, mix, whole).select("size", "doc_id", "row_of_mix", F.explode("draws").alias("draw"))
    # A cut document keeps its words and what stands between them.
    cut = F.array_join(F.slice(F.regexp_extract_all("row_of_mix.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("draw.words").cast("int")), "")
    text = F.when(F.col("draw.words") >= F.col("size"), F.col("row_of_mix.text")).otherwise(cut)
    out = out.withColumn("row_of_mix", F.col("row_of_mix").withField("text", text)).repartition(shard_count(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], mix), F.col("draw.shard"))
    out = out.sortWithinPartitions(F.col("draw.shard"), F.xxhash64("doc_id", "row_of_mix.text", "draw.pass", F.lit(mix.seed)))
    return out.select("row_of_mix.*")
