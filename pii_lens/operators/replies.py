"""A model's reply about a page, as text, to regions of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.boxes import clamp
from ..plans import lexicon

REPLY = "items ARRAY<STRUCT<text: STRING, kind: STRING, box: ARRAY<DOUBLE>>>"

# The shapes of a model's replies, by what it was asked for.
SCHEMAS = {
    "items": REPLY,
    "verdicts": "verdicts ARRAY<STRUCT<value: STRING, verdict: STRING, note: STRING>>",
    "visual": "face BIGINT, qr_code BIGINT, barcode BIGINT, note STRING",
    "audit": "face BIGINT, qr_code BIGINT, barcode BIGINT, note STRING",
    "elements": "elements ARRAY<STRUCT<element: STRING, state: STRING>>",
}


def body_of(content: Column) -> Column:
    """The outermost object of a reply without fences and the prose around it; empty if there is none."""
    return F.regexp_extract(F.trim(F.regexp_replace(content, r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", "")), r"(?s)\{.*\}", 0)


def parse_verdicts(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """(image, value, verdict) of replies (image, content) for values that were asked about (image, value), and of known
    verdicts only; of several about one value the last counts. A reply without an object has no verdict."""
    told = replies.select("image", F.posexplode(F.from_json(body_of(F.col("content")), SCHEMAS["verdicts"])["verdicts"]).alias("at", "v"))
    told = told.where(F.col("v.verdict").isin("leaked", "redacted")).groupBy("image", F.col("v.value").alias("value")).agg(F.max_by("v.verdict", "at").alias("verdict"))
    return told.join(asked.select("image", "value").distinct(), ["image", "value"], "left_semi")


def parse_visual(replies: DataFrame) -> DataFrame:
    """(image, kind, n, error) of replies (image, content) with counts; what a reply leaves out is 0. One without an object is a row with an error."""
    parsed = replies.select("image", F.from_json(body_of(F.col("content")), SCHEMAS["visual"]).alias("r"), (body_of(F.col("content")) == "").alias("bad"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"r.{k}"), F.lit(0)).alias("n")) for k in ("face", "qr_code", "barcode")))
    lost = F.col("bad") | F.col("r").isNull()
    good = parsed.where(~lost).select("image", F.explode(kinds).alias("k")).select("image", "k.kind", "k.n", F.lit(None).cast("string").alias("error"))
    return good.unionByName(parsed.where(lost).select("image", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("n"), F.lit("no JSON in reply").alias("error")))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(page_id, label, left, top, width, height, error) from (page_id, content, page_w, page_h).

    Fences and prose around the object are cut off. Coordinates are fractions if none is over 2, thousandths if one is
    over the longer side, else pixels. Corners are ordered, boxes clamped, empty ones dropped, unknown kinds kept as
    ``vlm_other``. A reply without an object is one row with an error.
    """
    body = body_of(F.col("content"))
    parsed = replies.select("page_id", "page_w", "page_h", F.from_json(body, REPLY).alias("reply"), (body == "").alias("bad"))
    lost = parsed.where(F.col("bad") | F.col("reply").isNull()).select("page_id", *(F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("left", "int"), ("top", "int"), ("width", "int"), ("height", "int"))), F.lit("no JSON in reply").alias("error"))
    items = F.coalesce("reply.items", F.array().cast("array<struct<text:string,kind:string,box:array<double>>>"))
    most = F.coalesce(F.array_max(F.flatten(F.transform(items, lambda i: F.coalesce(i["box"], F.array().cast("array<double>"))))), F.lit(0.0))
    sized = parsed.where(~F.col("bad") & F.col("reply").isNotNull()).select("page_id", "page_w", "page_h", most.alias("most"), F.explode(items).alias("item"))
    whole = sized.where((F.size("item.box") == 4) & F.forall("item.box", lambda x: x.isNotNull()))
    scale = F.when(F.col("most") <= 2, 1.0).when(F.col("most") > F.greatest("page_w", "page_h"), 1000.0)
    x = [F.when(scale.isNull(), F.get("item.box", k)).otherwise(F.get("item.box", k) / scale * F.col("page_w" if k % 2 == 0 else "page_h")) for k in range(4)]
    x0, y0, x1, y1 = F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3])
    left, top, width, height = clamp(x0.cast("int"), y0.cast("int"), (x1 - x0).cast("int"), (y1 - y0).cast("int"), F.col("page_w"), F.col("page_h"))
    names = F.create_map(*(F.lit(v) for kv in lexicon.REPLY_KINDS.items() for v in kv))
    label = F.coalesce(names[F.lower(F.coalesce("item.kind", F.lit("other")))], F.lit("vlm_other"))
    boxes = whole.select("page_id", label.alias("label"), left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"), F.lit(None).cast("string").alias("error"))
    return boxes.where("width > 0 and height > 0").unionByName(lost)
