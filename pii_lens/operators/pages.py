"""From a page's words to the boxes that are covered: text spans and labelled values, protected regions, blocks.

Words are (page_id, variant, pos, text, left, top, width, height): a variant is one copy of the page that was
recognized, enlarged by the page's factor. Pages without words give no box. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.boxes import padded, rescale
from ..plans import catalog
from . import boxes as box_op, words as word_op
from .detect import allowed, detect

GEOMETRY = ["left", "top", "width", "height"]


def ordered(words: DataFrame) -> DataFrame:
    """Words that aren't blank in reading order, by page and variant: page_id becomes (page_id, variant)."""
    keyed = words.select(F.struct("page_id", "variant").alias("page_id"), "pos", "text", *GEOMETRY)
    kept = word_op.page_words(keyed)
    nth = word_op.reading_order(kept).withColumnRenamed("nth", "place")
    return kept.join(nth, ["page_id", "pos"]).select("page_id", F.col("place").alias("pos"), "text", *GEOMETRY)


def text_boxes(read: DataFrame, recognizers: tuple[catalog.Recognizer, ...], least: float = catalog.THRESHOLD, dates: bool = False, names: DataFrame | None = None) -> DataFrame:
    """(page_id, label, score and a box) of every span of ``ordered`` words; one box of those alike in all variants.

    ``names`` are spans (page_id, entity_type, span_start, span_end, score) that a model found in ``page_texts``.
    """
    found = allowed(detect(word_op.page_texts(read), recognizers, key="page_id"), dates=dates, least=least)
    if names is not None:
        found = found.unionByName(names.select("page_id", "entity_type", "span_start", "span_end", "score").where(F.col("score") >= least))
    boxes = word_op.spans_to_boxes(read, found, ["entity_type", "score"])
    boxes = boxes.select("page_id.page_id", "page_id.variant", F.col("entity_type").alias("label"), "score", F.struct("span_start", "span_end").alias("pos"), *GEOMETRY)
    return box_op.union_variants(boxes).select("page_id", "label", "score", *GEOMETRY)


def label_boxes(read: DataFrame) -> DataFrame:
    """(page_id, label and a box) of the values beside personal labels, those alike in all variants once."""
    found = word_op.label_values(read)
    return found.select("page_id.page_id", F.lit("labelled_value").alias("label"), *GEOMETRY).distinct()


def in_page_pixels(boxes: DataFrame, factors: DataFrame | None) -> DataFrame:
    """Boxes of enlarged pages, in the pages' own pixels; ``factors`` has (page_id, factor), and a page that it lacks was not enlarged."""
    if factors is None:
        return boxes
    by = F.coalesce("factor", F.lit(1))
    sized = boxes.join(factors.select("page_id", "factor"), "page_id", "left")
    return sized.select(*(rescale(F.col(c), by).alias(c) if c in GEOMETRY else F.col(c) for c in boxes.columns))


def regions(words: DataFrame, *how, **more) -> DataFrame:
    """``regions_of`` words as they were recognized."""
    return regions_of(ordered(words), *how, **more)


def regions_of(read: DataFrame, recognizers: tuple[catalog.Recognizer, ...] = catalog.RECOGNIZERS, least: float = catalog.THRESHOLD, dates: bool = False, factors: DataFrame | None = None, protected: DataFrame | None = None, visual: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(page_id, label and a box) of all that is to be covered on each page. ``read`` is as of ``ordered``; it is read
    three times, so for many pages it should be a written table.

    Spans become boxes of their words, and protected regions (page_id and a box) withdraw names and places among them;
    boxes of a block are merged; then come labelled values and ``visual`` regions, of which those in the same place as
    one before are left out.
    """
    boxes = in_page_pixels(text_boxes(read, recognizers, least, dates, names), factors).select("page_id", "label", *GEOMETRY)
    if protected is not None:
        boxes = box_op.veto(boxes, protected)
    sources = [box_op.merge_blocks(boxes), in_page_pixels(label_boxes(read), factors)] + ([] if visual is None else [visual])
    return box_op.union_geometry(*sources)


def to_cover(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Corners (name, x0, y0, x1, y1), with each kind's margin, for ``pixels.render``; ``pages`` has (name, width, height) and found's page_id is a name."""
    size = pages.select(F.col("name"), F.col("width").alias("page_w"), F.col("height").alias("page_h"))
    both = found.join(size, found["page_id"] == size["name"])
    corners = padded(F.col("label"), *(F.col(c) for c in GEOMETRY), F.col("page_w"), F.col("page_h"))
    return both.select("name", *(c.alias(n) for c, n in zip(corners, ("x0", "y0", "x1", "y1"))))
