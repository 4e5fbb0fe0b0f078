"""Measuring: verdicts and recall bands, span benchmarks, run comparison, visual and element tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_present, tokens

NO_RECOGNIZER, DEFAULT_TIER = "(no recognizer)", "core"
VERDICTS = ("redacted", "leaked", "unverifiable")


def verdicts(items: DataFrame, before: DataFrame, after: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The verdict on each item (page_id, text): an override, else leaked where it is still readable, redacted where it
    was, unverifiable otherwise. Pages that are not both before and after are left out. Overrides are by page and text; one
    that is neither leaked nor redacted decides nothing. A null or wordless text is unverifiable."""
    pages = before.select("page_id", tokens(F.col("text")).alias("had")).join(after.select("page_id", tokens(F.col("text")).alias("has")), "page_id")
    found = items.join(pages, "page_id").withColumn("needle", tokens(F.col("text")))
    told = F.lit(None).cast("string")
    if overrides is not None:
        # Two overrides of one text on a page: leaked counts.
        sure = overrides.where(F.col("verdict").isin("leaked", "redacted")).groupBy("page_id", "text").agg(F.min("verdict").alias("told"))
        found = found.join(sure, ["page_id", "text"], "left")
        told = F.col("told")
    seen = F.when(is_present(F.col("needle"), F.col("has")), "leaked").when(is_present(F.col("needle"), F.col("had")), "redacted").otherwise("unverifiable")
    return found.withColumn("verdict", F.coalesce(told, seen)).drop("had", "has", "needle", "told")


def counts() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]


def band(redacted: Column, leaked: Column, unverifiable: Column) -> tuple[Column, Column]:
    """Recall in percent if the unverifiable count as leaked, and if they count as redacted; 0 of nothing."""
    total = redacted + leaked + unverifiable
    pct = lambda n: F.coalesce(F.round(F.try_divide(n * 100.0, total), 4), F.lit(0.0))
    return pct(redacted), pct(redacted + unverifiable)


def by_sets(found: DataFrame) -> DataFrame:
    """Counts in total and by type, tier and page in one pass: (dimension, value, redacted, leaked, unverifiable, total)."""
    rows = found.select(F.coalesce("expected_type", F.lit(NO_RECOGNIZER)).alias("kind"), F.coalesce("tier", F.lit(DEFAULT_TIER)).alias("tier"), F.col("page_id").cast("string").alias("page"), "verdict")
    sets = rows.groupingSets([[], ["kind"], ["tier"], ["page"]], "kind", "tier", "page").agg(F.grouping_id().alias("gid"), *counts())
    dimension = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "type").when(F.col("gid") == 5, "tier").otherwise("page")
    return sets.select(dimension.alias("dimension"), F.coalesce("kind", "tier", "page", F.lit("")).alias("value"), *VERDICTS, sum(F.col(v) for v in VERDICTS).alias("total"))


# --- spans against labelled spans -------------------------------------------------------------------------------------


def overlapping(a: str = "d", b: str = "t") -> Column:
    """Half-open spans of one document that share a character. The document is an equi-join key, so no plan is a product."""
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.span_start") < F.col(f"{b}.span_end")) & (F.col(f"{b}.span_start") < F.col(f"{a}.span_end"))


def hits(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Each labelled span (doc_id, span_start, span_end, label, accepted) with flags: flagged at all, and hit by an
    accepted type. No accepted type means that any will do."""
    d, t = found.alias("d"), truth.withColumn("truth_id", F.monotonically_increasing_id()).alias("t")
    fits = (F.size("t.accepted") == 0) | F.array_contains(F.col("t.accepted"), F.col("d.entity_type"))
    pairs = t.join(d, overlapping(), "left").groupBy("t.truth_id", "t.doc_id", "t.span_start", "t.span_end", "t.label")
    return pairs.agg(F.bool_or(F.col("d.entity_type").isNotNull()).alias("flagged"), F.coalesce(F.bool_or(fits & F.col("d.entity_type").isNotNull()), F.lit(False)).alias("hit")).drop("truth_id")


def spurious(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Detections that touch no labelled span."""
    return found.alias("d").join(truth.alias("t"), overlapping(), "left_anti")


def recall(flagged: DataFrame, by: list[str]) -> DataFrame:
    out = flagged.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"), F.count_if("flagged").alias("flagged"))
    return out.withColumn("recall", F.round(F.col("hits") * 1.0 / F.col("total"), 6))


# --- runs, elements, visual regions -----------------------------------------------------------------------------------


def compare(baseline: DataFrame, candidate: DataFrame, seconds: tuple[float, float] | None = None) -> DataFrame:
    """One row about two runs' verdicts (image, value, verdict): what the candidate caught and lost of the baseline's values.

    Only values that both have count. ``images`` are those in both runs. ``seconds`` of either run give what a catch costs.
    """
    b, c = (df.groupBy("image", "value").agg(F.min("verdict").alias(name)) for df, name in ((baseline, "b"), (candidate, "c")))
    both = b.join(c, ["image", "value"])
    shared = b.select("image").intersect(c.select("image")).agg(F.count("*").alias("images"))
    out = both.agg(
        F.count("*").alias("scored"), F.count_if(F.col("b") == "leaked").alias("base_leaks"), F.count_if(F.col("c") == "leaked").alias("cand_leaks"),
        F.count_if((F.col("b") == "leaked") & (F.col("c") == "redacted")).alias("caught"), F.count_if((F.col("b") == "redacted") & (F.col("c") == "leaked")).alias("regressed"),
    )
    out = out.join(F.broadcast(shared))  # a row each
    extra = F.lit(None).cast("double") if seconds is None else F.lit(float(seconds[1] - seconds[0]))
    return out.select("*", F.when((F.col("caught") > 0) & (extra > 0), F.round(extra / F.col("caught"), 4)).alias("seconds_per_catch"))


def coverage_warning(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two runs has."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, key, "full_outer").where("in_a is null or in_b is null").select(key, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


#: Characters of the end of a text by which texts that hold it are found.
GRAM = 8


def unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` (id, page, text) such that no text of ``b`` on the page holds theirs or is held by it, letters and digits in lower case alone.

    A text that holds another has the end of that other among its parts of that length, so only those meet.
    """
    plain = lambda df, *keep: df.select(*keep, "page", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("s")).where("s != ''")
    end = lambda df: df.select("*", F.expr(f"right(s, {GRAM})").alias("key"))
    size, places = F.length("s"), F.sequence(F.lit(1), F.length("s"))
    whole = F.transform(places, lambda i: F.substring(F.col("s"), i, F.lit(GRAM)))
    # Short texts are ends of whatever length they have.
    short = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.transform(places, lambda i: F.substring(F.col("s"), i, n))))
    parts = lambda df: df.select("*", F.explode(F.array_distinct(F.concat(whole, short))).alias("key")).where(F.length("key") <= size)
    mine, theirs = plain(a, "id"), plain(b).distinct()
    met = lambda x, y, cond: x.alias("x").join(y.alias("y"), (F.col("x.page") == F.col("y.page")) & (F.col("x.key") == F.col("y.key")) & cond).select("id")
    held = met(end(mine), parts(theirs), F.contains("y.s", "x.s"))
    holds = met(parts(mine), end(theirs), F.contains("x.s", "y.s"))
    return a.join(held.unionByName(holds).distinct(), "id", "left_anti").select("id")


def element_tally(elements: DataFrame) -> DataFrame:
    """Of elements readable before: leaked if readable after, else covered, also where there is no reading after."""
    state = F.when(F.col("state_after") == "readable", "leaked").otherwise("covered")
    return elements.where("state_before = 'readable'").withColumn("state", state).groupBy("element").pivot("state", ["covered", "leaked"]).agg(F.count(F.lit(1))).na.fill(0, ["covered", "leaked"])


def element_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image, element, state_before, state_after) of what was read before; null where nothing was read after."""
    x, y = before.select("image", "element", F.col("state").alias("state_before")), after.select("image", "element", F.col("state").alias("state_after"))
    return x.join(y, ["image", "element"], "left")


def visual_counts(proposed: DataFrame, current: DataFrame, detected: DataFrame) -> DataFrame:
    """(corpus, image, kind, proposed, current, detected) from three tables (corpus, image, kind, n); what one lacks is 0."""
    key, out = ["corpus", "image", "kind"], None
    for df, name in ((proposed, "proposed"), (current, "current"), (detected, "detected")):
        one = df.groupBy(*key).agg(F.sum("n").alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    return out.select(*key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("proposed", "current", "detected")))


def failures(items: DataFrame, verdicts: DataFrame, scored: DataFrame, images: DataFrame) -> DataFrame:
    """A row per page with leaked items: image, shot, total and its leaks (field, text, expected_type, tier).

    ``items`` is the truth (image, field, text, expected_type, tier), ``verdicts`` (image, text, verdict); ``scored`` and
    ``images`` have the names of files in either folder, and the annotated page is shown rather than the plain one.
    """
    bad = verdicts.where("verdict = 'leaked'").select("image", "text").distinct().withColumn("bad", F.lit(True))
    leak = F.struct("field", "text", "expected_type", F.coalesce("tier", F.lit(DEFAULT_TIER)).alias("tier"))
    pages = items.join(bad, ["image", "text"], "left").groupBy("image").agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.when(F.col("bad"), leak))).alias("leaks")).where(F.size("leaks") > 0)
    file = lambda df, folder: df.select("image").distinct().select("image", F.concat(F.lit(folder + "/"), F.col("image")).alias(folder))
    return pages.join(file(scored, "scored"), "image", "left").join(file(images, "images"), "image", "left").select("image", F.coalesce("scored", "images").alias("shot"), "total", "leaks")


def mean_confidence(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, entity_count, avg_confidence) of every page; null where it has no detection (page_id, score)."""
    got = found.groupBy("page_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("avg_confidence"))
    return pages.select("page_id").join(got, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("entity_count"), "avg_confidence")


#: Share of a region from which on it counts as covered whole.
FULLY = 0.99


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Per field, and for all (null): regions measured, mean coverage, how many are covered whole. What couldn't be measured doesn't count."""
    known = coverage.where(F.col("coverage").isNotNull() & ~F.isnan("coverage"))
    return known.rollup("field").agg(F.count("*").alias("regions"), F.round(F.avg("coverage"), 6).alias("mean"), F.count_if(F.col("coverage") >= FULLY).alias("whole"))


def panel_totals(verdicts: DataFrame, elements: DataFrame) -> DataFrame:
    """(corpus, unit, redacted, leaked, unverifiable, pct) of each corpus: from its items' verdicts (corpus, verdict), or
    where it has none from its elements (corpus, state_before, state_after)."""
    items = verdicts.groupBy("corpus").agg(*counts()).withColumn("unit", F.lit("items"))
    read = elements.where("state_before = 'readable'").withColumn("verdict", F.when(F.col("state_after") == "readable", "leaked").otherwise("redacted"))
    other = read.groupBy("corpus").agg(*counts()).withColumn("unit", F.lit("elements")).join(items.select("corpus"), "corpus", "left_anti")
    return items.unionByName(other).select("corpus", "unit", *VERDICTS, F.coalesce(F.round(F.try_divide(F.col("redacted") * 100.0, sum(F.col(v) for v in VERDICTS)), 4), F.lit(0.0)).alias("pct"))


def by_leakage(counted: DataFrame, key: str) -> DataFrame:
    """Rows of counts, those with the most leaked or unverifiable first, equals by key."""
    return counted.orderBy(F.desc(F.col("leaked") + F.col("unverifiable")), key)


def truth_of_fields(fields: DataFrame, meanings: DataFrame, skipped: DataFrame) -> DataFrame:
    """(page_id, field, text, expected_type, tier) of form fields (page_id, label, value) whose label has a meaning
    (label, expected_type, tier) and is not skipped; blank labels and values are none. Meanings are a few dozen."""
    known = fields.where((F.trim("label") != "") & (F.trim("value") != "")).join(skipped, "label", "left_anti")
    return known.join(meanings, "label").select("page_id", F.col("label").alias("field"), F.trim("value").alias("text"), "expected_type", "tier")


def inventory(items: DataFrame) -> DataFrame:
    """Items by tier, and for all (null): how many, and how many have no recognizer."""
    return items.rollup("tier").agg(F.count("*").alias("items"), F.count_if(F.col("expected_type").isNull()).alias("unsupported"))


def label_lines(lines: DataFrame, spans: DataFrame, told: Column) -> DataFrame:
    """Lines (doc_id, label, value_start, value) with ``carries``, whether a labelled span begins in the value, and ``told``."""
    line = lines.withColumn("line_id", F.monotonically_increasing_id()).alias("l")
    begins = (F.col("l.doc_id") == F.col("s.doc_id")) & (F.col("s.span_start") >= F.col("l.value_start")) & (F.col("s.span_start") < F.col("l.value_start") + F.length("l.value"))
    met = line.join(spans.select("doc_id", "span_start").alias("s"), begins, "left").groupBy("l.line_id", "l.doc_id", "l.label").agg(F.count("s.span_start").alias("n"))
    return met.select("doc_id", "label", (F.col("n") > 0).alias("carries"), told.alias("told"))


def visual_scores(visual: DataFrame) -> DataFrame:
    """True and false positives and misses of detected against proposed counts, by kind; null where nothing divides."""
    d, t = F.col("detected"), F.col("proposed")
    out = visual.groupBy("kind").agg(F.sum(F.least(d, t)).alias("tp"), F.sum(F.greatest(F.lit(0), d - t)).alias("fp"), F.sum(F.greatest(F.lit(0), t - d)).alias("fn"))
    return out.select("*", F.round(F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fn")), 6).alias("recall"))


def visual_survival(visual: DataFrame) -> DataFrame:
    a, s = F.col("proposed"), F.col("surviving")
    return visual.groupBy("kind").agg(F.sum(a).alias("annotated"), F.sum(s).alias("surviving"), F.sum(F.greatest(F.lit(0), s - a)).alias("unexpected"))
