"""Tracking: history, merge on write, corpus match, and what may not be tuned on."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


class HeldOutCorpusError(RuntimeError):
    """A corpus that is held out was about to choose a parameter."""


class CorpusMismatchError(RuntimeError):
    """A run was about to be scored against another corpus's truth."""


def deltas(history: DataFrame) -> DataFrame:
    """Each run against the one before: changed by how much, unchanged under .05, or not comparable if the corpus changed size."""
    order = Window.partitionBy("corpus").orderBy("day")
    prev, images = F.lag("recall_floor_pct").over(order), F.lag("image_count").over(order)
    d = F.round(F.col("recall_floor_pct") - prev, 4)
    word = F.when(images.isNull(), "first").when(images != F.col("image_count"), "resized").when(F.abs(d) < 0.05, "unchanged").when(d > 0, "up").otherwise("down")
    return history.select("corpus", "day", word.alias("change"), F.when(word.isin("unchanged", "up", "down"), d).alias("points"))


def newest(history: DataFrame, n: int = 12) -> DataFrame:
    order = Window.partitionBy("corpus").orderBy(F.desc("day"))
    return history.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def sparkline(history: DataFrame) -> DataFrame:
    """Each series between its least and most, at least one point apart; series of one run have no line."""
    whole = Window.partitionBy("corpus")
    low, high = F.min("recall_floor_pct").over(whole), F.max("recall_floor_pct").over(whole)
    y = F.round((F.col("recall_floor_pct") - low) / F.greatest(high - low, F.lit(1.0)), 6)
    return history.withColumn("runs", F.count("*").over(whole)).select("corpus", "day", y.alias("y"), "runs").where("runs >= 2").drop("runs")


def commits(history: DataFrame) -> DataFrame:
    """Distinct commits that scored a corpus, runs in all, and how often its most used one did."""
    runs = history.groupBy("corpus", "sha").agg(F.count("*").alias("n"))
    known = F.col("sha").isNotNull() & (F.col("sha") != "")
    return runs.groupBy("corpus").agg(F.count_if(known).alias("commits"), F.sum("n").alias("runs"), F.max(F.when(known, F.col("n"))).alias("most_of_one"))


def scored_so_far(history: DataFrame) -> DataFrame:
    """At each run, how often its commit has scored the corpus until then."""
    order = Window.partitionBy("corpus", "sha").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return history.select("corpus", "day", "sha", F.count("*").over(order).alias("times"))


def merge_on_write(fresh: DataFrame, stored: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """Fresh pages win whole; stored ones stay while their image is there."""
    kept = stored.join(images, key, "left_semi").join(fresh.select(*key).distinct(), key, "left_anti")
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(kept.withColumn("origin", F.lit("kept")))


def corpus_matches(files: DataFrame, keys: DataFrame) -> DataFrame:
    """For each corpus, how many of a run's files its truth has, and whether that is half; best first by count, then name."""
    n = files.select("file").distinct()
    total = n.agg(F.count("*").alias("files"))
    found = keys.select("corpus", "file").distinct().join(n, "file", "left_semi").groupBy("corpus").agg(F.count("*").alias("shared"))
    found = keys.select("corpus").distinct().join(found, "corpus", "left").select("corpus", F.coalesce("shared", F.lit(0)).alias("shared"))
    return found.join(F.broadcast(total)).select("corpus", "shared", "files", (F.col("shared") * 2 >= F.col("files")).alias("matches"))  # one row


def check_matches(files: DataFrame, keys: DataFrame, corpus: str) -> None:
    """Refuses a run whose files are not the corpus's by half; a run without files passes."""
    rows = {r["corpus"]: r for r in corpus_matches(files, keys).collect()}  # a row per corpus
    mine = rows.get(corpus)
    if not mine or mine["files"] == 0 or mine["matches"]:
        return
    best = min(rows.values(), key=lambda r: (-r["shared"], r["corpus"]))
    hint = f" They look like {best['corpus']!r}." if best["shared"] and best["corpus"] != corpus else " No corpus here describes them."
    raise CorpusMismatchError(f"{mine['shared']} of {mine['files']} files are in {corpus!r}.{hint}")


def resolve(target: str, roots: dict[str, str]) -> str | None:
    """The corpus that a name or a path at or under its folder means."""
    if target in roots:
        return target
    path = target.rstrip("/")
    return next((n for n, root in sorted(roots.items()) if path == root.rstrip("/") or path.startswith(root.rstrip("/") + "/")), None)


def refuse_tuning(target: str, roots: dict[str, str], held_out: Iterable[str], purpose: str) -> None:
    """Raises before any job if ``purpose`` would choose a parameter on a held-out corpus; other and unknown targets pass."""
    name = resolve(target, roots)
    if name in set(held_out):
        raise HeldOutCorpusError(f"{purpose} would tune on {name!r}, which is held out")


def _outcome(spark: SparkSession, name: str, run: Callable[[], DataFrame]) -> list[tuple]:
    """A configuration's (name, recall_floor_pct, seconds, error): the job runs here, so that a failing one is told apart."""
    began = time.monotonic()
    try:
        rows = run().select("recall_floor_pct").limit(2).collect()  # a score is one row
        error = None if len(rows) == 1 else f"{len(rows)} rows of scores instead of one"
        floor = rows[0][0] if len(rows) == 1 else None
    except Exception as e:  # a failure of any kind is this configuration's row
        error, floor = f"{type(e).__name__}: {e}".splitlines()[0][:500], None
    return [(name, None if floor is None else float(floor), round(time.monotonic() - began, 3), error)]


_OUTCOME = "config string, recall_floor_pct double, seconds double, error string"


def sweep(spark: SparkSession, configs: dict[str, dict], score: Callable[[dict], DataFrame], target: str, roots: dict[str, str], held_out: Iterable[str]) -> DataFrame:
    """(config, recall_floor_pct, seconds, error) of each configuration, by recall, failed ones last; none gives no row.

    Held-out corpora are refused before any job. A configuration that fails is a row with its error; the others go on.
    """
    refuse_tuning(target, roots, held_out, "a sweep")
    rows = [r for name, config in configs.items() for r in _outcome(spark, name, lambda c=config: score(c))]
    return spark.createDataFrame(rows, _OUTCOME).orderBy(F.desc_nulls_last("recall_floor_pct"), "config")


def suite(spark: SparkSession, corpora: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The same of each corpus's run, in the order given; a corpus that fails doesn't stop the rest."""
    return spark.createDataFrame([r for name, run in corpora.items() for r in _outcome(spark, name, run)], _OUTCOME)


def first_of(df: DataFrame, key: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows by key, or all: a prefix that reruns agree on."""
    return df if n is None else df.orderBy(*key).limit(n)


def prerequisites(spark: SparkSession, inputs: Iterable[str] = (), providers: Iterable[tuple[str, str]] = ()) -> None:
    """Raises with all that is missing before any job: inputs that aren't there, providers that nothing registered."""
    from . import providers as registry

    jvm, missing = spark._jvm, []
    for path in inputs:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            missing.append(f"no input {path}")
    missing += [f"no {kind} provider {name!r}" for kind, name in providers if name not in registry.PROVIDERS.get(kind, {})]
    if missing:
        raise RuntimeError("; ".join(missing))
