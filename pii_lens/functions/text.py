"""Text as Column expressions: shadows, label words, tokens, spans, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans import lexicon

NON_ASCII_LETTER, NON_ASCII = r"[^\x00-\x7F\P{L}]", r"[^\x00-\x7F]"


def shadow(text: Column) -> Column:
    """The text with non-ASCII letters as ``a`` and other non-ASCII characters as spaces: word borders mean the same everywhere, offsets stay."""
    return F.regexp_replace(F.regexp_replace(text, NON_ASCII_LETTER, "a"), NON_ASCII, " ")


#: Stands around matches in a shadow, which holds no such character.
MARK = "§"
#: Entries that a running sum appends one by one before they are put away as a block.
BLOCK = 256


def marked(text: Column, pattern: str) -> Column:
    """A shadow with every match between marks: the one pass of a pattern over a text."""
    return F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")


def cut(marked_text: Column) -> Column:
    """Gaps and matches by turns, beginning and ending with a gap; null where nothing matches."""
    return F.when(F.contains(marked_text, F.lit(MARK)), F.split(marked_text, MARK))


def running(values: Column, combine=lambda a, b: a + b) -> Column:
    """Running sums (or maxima and the like) of an array of ints. They are put away by blocks, so the cost is in proportion to the length."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<array<int>>").alias("blocks"), none.alias("last"))

    def step(acc, x):
        at = F.when(acc["at"].isNull(), x).otherwise(combine(acc["at"], x))
        full = F.size(acc["last"]) >= BLOCK
        blocks = F.when(full, F.concat(acc["blocks"], F.array(acc["last"]))).otherwise(acc["blocks"])
        return F.struct(at.alias("at"), blocks.alias("blocks"), F.when(full, F.array(at)).otherwise(F.concat(acc["last"], F.array(at))).alias("last"))

    return F.aggregate(values, start, step, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["last"]))))


def spans(df: DataFrame, column: str, patterns: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns that it needs, and for each pattern an array of (start, end, value) of its matches in a shadow.

    Matches of a pattern are leftmost and don't overlap; ends are exclusive. Each pattern passes over the text once. The
    steps are projections of their own, as what is used twice would be evaluated twice within one.
    """
    n = range(len(patterns))
    df = df.select("*", *(marked(F.col(column), p).alias(f"__marked{k}") for k, p in zip(n, patterns)))
    df = df.select("*", *(cut(F.col(f"__marked{k}")).alias(f"__cut{k}") for k in n)).drop(*(f"__marked{k}" for k in n))
    df = df.select("*", *(F.when(F.col(f"__cut{k}").isNotNull(), running(F.transform(f"__cut{k}", F.length))).alias(f"__ends{k}") for k in n))

    def one(k: int) -> Column:
        parts, ends = F.col(f"__cut{k}"), F.col(f"__ends{k}")
        at = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        hits = F.transform(at, lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.get(parts, i).alias("value")))
        return F.when(parts.isNotNull(), hits).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))

    return df, [one(k) for k in n]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(value: Column, length: int | None = None) -> Column:
    d = digits(value)
    ok = F.call_function("luhn_check", d)
    return ok if length is None else ok & (F.length(d) == length)


def gstin_ok(value: Column) -> Column:
    """The last of 15 characters checks the others: weights 1 and 2 by turns in base 36, the digits of each product summed."""
    code = lambda i: F.call_function("instr", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(value, i, F.lit(1))) - 1
    products = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: code(i) * (2 - i % 2))
    total = F.aggregate(products, F.lit(0), lambda a, x: a + F.floor(x / 36).cast("int") + x % 36)
    return F.when(F.length(value) == 15, (36 - total % 36) % 36 == code(F.lit(15))).otherwise(False)


def verhoeff_ok(value: Column, length: int | None = None) -> Column:
    """Verhoeff's check: permute each digit by its place from the right, multiply up in the dihedral group."""
    d = digits(value)
    table = F.array(*(F.lit(x) for row in lexicon.VERHOEFF_PRODUCT for x in row))
    turn = F.array(*(F.lit(x) for row in lexicon.VERHOEFF_TURN for x in row))
    turned = F.transform(F.filter(F.split(F.reverse(d), ""), lambda x: x != ""), lambda x, i: F.get(turn, i % 8 * 10 + x.cast("int")))
    ok = F.aggregate(turned, F.lit(0), lambda c, x: F.get(table, c * 10 + x)) == 0
    return F.when(F.length(d) == length, ok).otherwise(False) if length else F.when(F.length(d) > 0, ok).otherwise(False)


# --- labels -----------------------------------------------------------------------------------------------------------


def label_norm(text: Column) -> Column:
    """A label in lower case without punctuation; single characters join a short alphabetic word before them (``A/C`` is ``ac``).

    Compatibility forms (full-width letters and the like) are for ``operators.words.fold_forms``, which comes before.
    """
    bare = F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, lexicon.LABEL_PUNCTUATION, " "), r"\s+", " ")))
    words = F.filter(F.split(bare, " "), lambda w: w != "")
    empty = F.array().cast("array<string>")

    def step(acc, w):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.length(w) == 1) & last.isNotNull() & (F.length(last) <= 2) & last.rlike(r"^\p{L}+$")
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, w)))).otherwise(F.concat(acc, F.array(w)))

    return F.array_join(F.aggregate(words, empty, step), " ")


def _in(words: Column, terms) -> Column:
    return F.arrays_overlap(words, F.array(*(F.lit(t) for t in sorted(terms))))


def label_words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def label_terms(norm: Column) -> Column:
    """A label's distinct words without filler."""
    return F.array_except(F.array_distinct(label_words(norm)), F.array(*(F.lit(t) for t in sorted(lexicon.FILLER))))


def is_label_phrase(norm: Column) -> Column:
    words = label_words(norm)
    known = F.array(*(F.lit(t) for t in sorted(lexicon.VOCABULARY)))
    return (F.size(words) > 0) & (F.size(F.array_except(words, known)) == 0)


def is_pii_label(norm: Column) -> Column:
    """A strong term decides; a weak one does where no institution is named."""
    terms = label_terms(norm)
    return _in(terms, lexicon.STRONG) | (_in(terms, lexicon.WEAK) & ~_in(terms, lexicon.INSTITUTION))


# --- legibility -------------------------------------------------------------------------------------------------------


def score_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(score_norm(text), " "), lambda t: t != "")


def share_present(needle: Column, haystack: Column) -> Column:
    """Share of the needle's tokens that the haystack has; null for an empty needle."""
    return F.try_divide(F.size(F.filter(needle, lambda t: F.array_contains(haystack, t))), F.size(needle))


def is_present(needle: Column, haystack: Column, least: float = 0.6) -> Column:
    return F.coalesce(share_present(needle, haystack) >= least, F.lit(False))


def similar(a: Column, b: Column) -> Column:
    """One, reduced to letters and digits, holds the other; empty ones never."""
    x, y = (F.regexp_replace(F.lower(v), "[^a-z0-9]", "") for v in (a, b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def is_signature_cue(token: Column) -> Column:
    """Whether a word stands beside signatures, punctuation around it aside."""
    return F.lower(F.regexp_replace(F.trim(token), r"^[.:,;]+|[.:,;]+$", "")).isin(*lexicon.SIGNATURE_CUES)


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix == "webp", "image/webp").when(suffix == "gif", "image/gif").otherwise("image/png")


def anchor(heading: Column) -> Column:
    """What links to a heading: lower case, hyphens for spaces, no other punctuation."""
    return F.replace(F.regexp_replace(F.trim(F.lower(heading)), r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("-"))


def config_value(value: Column) -> Column:
    return F.when(value == "true", "on").when(value.isNull() | (value == "false"), "off").otherwise(value)


# Fixed value: what a line of a label and its value looks like.
LINE = r"^\s*([^:\n]{2,40}?)\s*:\s*(\S.*)$"


def labelled_lines(df: DataFrame) -> DataFrame:
    """doc_id, label, value_start, value of each ``Label: value`` line whose label has a letter; starts are in the whole text."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    got = lines.select("doc_id", "line", "at", F.regexp_extract("line", LINE, 1).alias("label"), F.regexp_extract("line", LINE, 2).alias("value")).where(F.col("label").rlike(r"\p{L}"))
    # The value is the rest of the line from its first character on.
    return got.select("doc_id", "label", (F.col("at") + F.length("line") - F.length("value")).cast("int").alias("value_start"), "value")
