"""Detection and redaction of a text column, row by row: no row meets another, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import gstin_ok, luhn_ok, running, shadow, spans, verhoeff_ok
from ..plans import catalog
from ..plans.catalog import Recognizer

#: Characters before a span that are looked at first for its context; where its words don't end in them, all are.
PEEK = 400
#: Runs of spans whose text is cut out of the whole at once.
RUNS = 64


def valid(r: Recognizer, value: Column) -> Column:
    if r.check == "luhn":
        return luhn_ok(value, r.length)
    if r.check == "verhoeff":
        return verhoeff_ok(value, r.length)
    if r.check == "octets":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    if r.check == "gstin":
        return gstin_ok(value)
    return F.lit(True)


def context_found(text: Column, start: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words or phrases is among the last tokens before the span, however long those are.

    The text before is turned around, so that a match from its beginning meets the last tokens first and goes no further.
    """
    if not words:
        return F.lit(False)
    n = catalog.CONTEXT_WORDS
    back = lambda size: F.reverse(F.lower(F.substring(text, start - size + 1, size)))
    near = F.regexp_extract(back(F.least(start, F.lit(PEEK))), rf"^(?:[^a-z0-9]*+[a-z0-9]++){{{n}}}(?=[^a-z0-9])", 0)
    whole = F.regexp_extract(back(start), rf"^(?:[^a-z0-9]*+[a-z0-9]++){{0,{n}}}", 0)
    last = F.regexp_replace(F.reverse(F.when(near != "", near).otherwise(whole)), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), last, F.lit(" ")).rlike(" (?:" + "|".join(words) + ") ")


def _scored(r: Recognizer, base: float, boost: bool):
    """From a match to its type, place and score."""

    def one(hit):
        score = F.lit(base)
        if boost:
            score = F.round(F.least(F.lit(1.0), score + F.when(context_found(F.col("__shade"), hit["start"], r.context), F.lit(catalog.CONTEXT_BOOST)).otherwise(F.lit(0.0))), 4)
        return F.struct(F.lit(r.entity).alias("entity_type"), hit["start"].alias("span_start"), hit["end"].alias("span_end"), score.alias("score"))

    return one


def with_spans(df: DataFrame, recognizers: tuple[Recognizer, ...] = catalog.RECOGNIZERS, text: str = "text", boost: bool = True, into: str = "found") -> DataFrame:
    """``df`` with an array of (entity_type, span_start, span_end, score) of each match that its check passes, in that order.

    Matches of a recognizer's pattern are leftmost and don't overlap; different patterns may. Of equal (type, start, end)
    the best score stays. A null text and one without a match have an empty array. Rows are taken one by one, so repeated
    rows, null keys and extra columns change nothing.
    """
    kinds = [(r, pattern, score) for r in recognizers for pattern, score in r.patterns]
    checked = lambda r, hits: F.filter(hits, lambda h: F.coalesce(valid(r, h["value"]), F.lit(False))) if r.check else hits
    old = df.columns
    shaded, hits = spans(df.select("*", shadow(F.col(text)).alias("__shade")), "__shade", [p for _, p, _ in kinds])
    found = [F.transform(checked(r, array), _scored(r, base, boost)) for (r, _, base), array in zip(kinds, hits)]
    every = shaded.select(*(F.col(f"`{c}`") for c in old), F.sort_array(F.concat(*found)).alias("__every"))
    same = lambda a, b: (a["entity_type"] == b["entity_type"]) & (a["span_start"] == b["span_start"]) & (a["span_end"] == b["span_end"])
    # In their order the last of equals has the best score.
    best = F.filter("__every", lambda x, i: ~F.coalesce(same(x, F.get("__every", i + 1)), F.lit(False)))
    return every.select(*(F.col(f"`{c}`") for c in old), best.alias(into))


def detect(df: DataFrame, recognizers: tuple[Recognizer, ...] = catalog.RECOGNIZERS, key: str = "doc_id", text: str = "text", boost: bool = True, least: float | None = None) -> DataFrame:
    """(key, entity_type, span_start, span_end, score), a row for each span that ``with_spans`` finds."""
    found = with_spans(df.select(key, F.col(text).alias("__text")), recognizers, "__text", boost, "__found")
    # Not ``explode``: the optimizer would put a filter below it that finds all spans a second time.
    out = found.select(key, F.explode_outer("__found").alias("__hit")).where(F.col("__hit.span_start").isNotNull()).select(key, "__hit.*")
    return out if least is None else out.where(F.col("score") >= least)


def allowed(spans_df: DataFrame, wanted: list[str] | None = None, dates: bool = False, least: float = catalog.THRESHOLD) -> DataFrame:
    """Spans of the allowed entities that reach the threshold."""
    return spans_df.where(F.col("entity_type").isin(catalog.entities(wanted, dates)) & (F.col("score") >= least))


def covered(df: DataFrame, cuts: str, text: str = "text", mark: str = "[#]", into: str = "redacted") -> DataFrame:
    """``df`` with the text, each run of overlapping spans of the array ``cuts`` replaced by a mark; a null text stays null.

    ``cuts`` has span_start and span_end in any order; null and empty arrays leave the text as it is.
    """
    old = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*old, F.sort_array(F.transform(cuts, lambda c: F.struct(c["span_start"].alias("a"), c["span_end"].alias("b")))).alias("__cuts"))
    step = step.select("*", running(F.transform("__cuts", lambda c: c["b"]), lambda a, b: F.greatest(a, b)).alias("__reach"))
    # A run begins where no span before reaches.
    heads = F.filter(F.sequence(F.lit(0), F.size("__cuts") - 1), lambda i: (i == 0) | (F.get("__cuts", i)["a"] >= F.get("__reach", i - 1)))
    some = F.coalesce(F.size("__cuts") > 0, F.lit(False))
    step = step.select("*", F.when(some, heads).alias("__heads"))
    n = F.size("__heads")
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("__reach", F.when(k < n, F.get("__heads", k)).otherwise(F.size("__reach")) - 1))
    end = lambda k: F.when(k < n, F.get("__cuts", F.get("__heads", k))["a"]).otherwise(F.length(text))

    def block(b):
        """The kept pieces of some runs, cut out of their part of the text."""
        first, last = b * RUNS, F.least(b * RUNS + RUNS - 1, n)
        part = F.struct(begin(first).alias("at"), F.substring(F.col(text), begin(first) + 1, end(last) - begin(first)).alias("text"))
        return F.get(F.transform(F.array(part), lambda p: F.array_join(F.transform(F.sequence(first, last), lambda k: F.substring(p["text"], begin(k) - p["at"] + 1, end(k) - begin(k))), mark)), F.lit(0))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / RUNS).cast("int")), block)
    return step.select(*old, F.when(some & F.col(text).isNotNull(), F.array_join(blocks, mark)).otherwise(F.col(text)).alias(into))


def redact(df: DataFrame, recognizers: tuple[Recognizer, ...] = catalog.RECOGNIZERS, key: str = "doc_id", text: str = "text", mark: str = "[#]") -> DataFrame:
    """(key, redacted): detection and redaction in one pass over the rows; texts without spans are as they were."""
    found = with_spans(df.select(key, F.col(text).alias("__text")), recognizers, "__text", into="__found")
    return covered(found, "__found", "__text", mark).select(key, "redacted")


def redact_by(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[#]") -> DataFrame:
    """(key, redacted) with spans (key, span_start, span_end) from elsewhere, which must come to their texts by a join. Keys are unique."""
    lists = found.groupBy(key).agg(F.collect_list(F.struct("span_start", "span_end")).alias("__found"))
    return covered(df.select(key, F.col(text).alias("__text")).join(lists, key, "left"), "__found", "__text", mark).select(key, "redacted")
