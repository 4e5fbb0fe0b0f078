"""Boxes (left, top, width, height) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Margin of a region by its kind, and of the others.
PAD = {"face": 0.30, "signature": 0.15, "qr_code": 0.08, "barcode": 0.08}
PAD_OTHER, PAD_LEAST = 0.05, 2
# Text height aimed at, most factor, longest side.
TARGET_HEIGHT, MOST_FACTOR, LONGEST_SIDE = 24, 3, 2400
# A signature's window beside its cue, in heights of the cue.
SIGN_X, SIGN_UP, SIGN_DOWN = 14.0, 12.5, 2.0


def rescale(value: Column, factor: Column | int) -> Column:
    """Floor division, also below zero."""
    return F.floor(value / factor).cast("int")


def clamp(left: Column, top: Column, width: Column, height: Column, page_w: Column, page_h: Column) -> tuple[Column, ...]:
    x, y = F.greatest(F.lit(0), F.least(left, page_w)), F.greatest(F.lit(0), F.least(top, page_h))
    return x, y, F.greatest(F.lit(0), F.least(width, page_w - x)), F.greatest(F.lit(0), F.least(height, page_h - y))


def padded(kind: Column, left: Column, top: Column, width: Column, height: Column, page_w: Column, page_h: Column) -> tuple[Column, ...]:
    """Corners of a region with its kind's margin, two pixels at least, within the page."""
    ratio = F.coalesce(F.create_map(*(F.lit(x) for kv in PAD.items() for x in kv))[kind], F.lit(PAD_OTHER))
    x, y = (F.greatest(F.lit(PAD_LEAST), (size * ratio).cast("int")) for size in (width, height))
    return F.greatest(F.lit(0), left - x), F.greatest(F.lit(0), top - y), F.least(page_w, left + width + x), F.least(page_h, top + height + y)


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes share."""
    w = F.least(a["l"] + a["w"], b["l"] + b["w"]) - F.greatest(a["l"], b["l"])
    h = F.least(a["t"] + a["h"], b["t"] + b["h"]) - F.greatest(a["t"], b["t"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def overlap_fraction(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of the first box that the second covers; none of an empty box."""
    return F.coalesce(F.try_divide(overlap(a, b), a["w"] * a["h"]), F.lit(0.0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    both = overlap(a, b)
    return F.coalesce(F.try_divide(both, a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def to_pixels(value: Column, size: Column) -> Column:
    """From thousandths of a side to pixels, within it."""
    return F.greatest(F.lit(0), F.least(size, F.floor(value * size / 1000).cast("int")))


def signature_window(left: Column, top: Column, width: Column, height: Column) -> tuple[Column, ...]:
    x, up, down = ((height * r).cast("int") for r in (SIGN_X, SIGN_UP, SIGN_DOWN))
    return left - x, top - up, left + width + x, top + height + down


def clipping(left: Column, top: Column, width: Column, height: Column, page_w: Column, page_h: Column) -> tuple[Column, ...]:
    """By how much a signature's window runs over the page's left, top, right and bottom edge."""
    x0, y0, x1, y1 = signature_window(left, top, width, height)
    return F.greatest(F.lit(0), -x0), F.greatest(F.lit(0), -y0), F.greatest(F.lit(0), x1 - page_w), F.greatest(F.lit(0), y1 - page_h)


def padded_page(page_w: Column, page_h: Column, aspect: float) -> tuple[Column, ...]:
    """Width and height of the least page of an aspect that holds a page, and where that stands in its middle."""
    narrow = page_w / page_h < aspect
    w = F.when(narrow, F.bround(page_h * aspect).cast("int")).otherwise(page_w)
    h = F.when(narrow, page_h).otherwise(F.bround(page_w / aspect).cast("int"))
    return w, h, F.floor((w - page_w) / 2).cast("int"), F.floor((h - page_h) / 2).cast("int")


def upscale_factor(text_height: Column, width: Column, height: Column) -> Column:
    """The factor that brings text to its height, less while the long side would be too long; 1 for no text."""
    aim = F.greatest(F.lit(1), F.least(F.lit(MOST_FACTOR), F.bround(F.lit(float(TARGET_HEIGHT)) / text_height).cast("int")))
    fits = F.greatest(F.lit(1), F.floor(F.lit(LONGEST_SIDE) / F.greatest(width, height)).cast("int"))
    return F.when(text_height <= 0, 1).otherwise(F.least(aim, fits))


def box(prefix: str = "") -> dict[str, Column]:
    return {k[0]: F.col(prefix + k) for k in ("left", "top", "width", "height")}
