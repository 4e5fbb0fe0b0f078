"""Checks of documentation as a relation of lines: history told in prose, anchors that lead nowhere, scripts not named."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import anchor

# Phrases that tell of a past state.
PAST = (
    r"\bused to\b", r"\bno longer\b", r"\bpreviously\b", r"\bformerly\b", r"\boriginally\b", r"\bat first\b", r"\bfirst attempt\b", r"\bturned out\b",
    r"\bwas (tested|built|removed|deleted|rejected|added|chosen|written)\b", r"\bwere (tested|built|removed|deleted|rejected|added|measured|chosen)\b",
    r"\b(has|have) been (corrected|removed|deleted|rejected|revised)\b", r"\bacross (two|three|four|several) revisions\b",
    r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+20\d{2}\b", r"\bin 20\d{2}\b",
)


def lines(files: DataFrame) -> DataFrame:
    """(file, line, body) of texts (file, text) without code fences."""
    bare = F.regexp_replace("text", r"(?s)```.*?```", "")
    return files.select("file", F.posexplode(F.split(bare, "\n")).alias("at", "body")).select("file", (F.col("at") + 1).alias("line"), "body")


def tense(files: DataFrame) -> DataFrame:
    """Lines, other than quotes, and the phrase of history in each."""
    found = lines(files).where(~F.startswith(F.ltrim("body"), F.lit(">")))
    hits = F.filter(F.array(*(F.regexp_extract("body", f"(?i)({p})", 1) for p in PAST)), lambda x: x != "")
    return found.select("file", "line", F.explode(hits).alias("phrase"))


def broken_anchors(files: DataFrame) -> DataFrame:
    """Links to a heading of the same file that it doesn't have."""
    heads = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))).alias("h")).select("file", anchor(F.col("h")).alias("anchor"))
    links = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]+\]\(#([^)]+)\)"), F.lit(1))).alias("anchor"))
    return links.join(heads, ["file", "anchor"], "left_anti")


def undocumented(scripts: DataFrame, files: DataFrame) -> DataFrame:
    """Scripts (script) that no text names as a word of its own: an equi-join on the words of the texts."""
    named = files.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\w./-]*\w"), F.lit(0))).alias("script")).distinct()
    return scripts.join(named, "script", "left_anti")
