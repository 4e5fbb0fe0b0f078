"""Pixel operators over rows of image bytes (height x width x channels), in numpy by Arrow batch."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.boxes import SIGN_DOWN, SIGN_UP, SIGN_X, upscale_factor
from ..functions.text import is_signature_cue
from .boxes import drop_contained

# Change of a covered pixel; glyphs' heights, page share, width; fewest glyphs; ink that counts as handwriting.
COVERED, GLYPH_LEAST, GLYPH_SHARE, GLYPH_WIDTH, GLYPHS = 30, 4, 0.1, 6, 20
INK_LEAST, INK_PARTS, INK_LARGEST = 50, 80, 0.30


STYLES = ("solid", "pixelate", "blur")


def array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def grey(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image[:, :, 0]
    b, g, r = (image[:, :, k].astype(np.uint32) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def otsu(values: np.ndarray) -> int:
    """The level that parts dark from light with the most variance between them."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def parts(ink: np.ndarray) -> np.ndarray:
    """(top, bottom, left, right, pixels) of each 8-connected part, from runs of ink joined to touching runs above."""
    padded = np.pad(ink.astype(np.int8), ((0, 0), (1, 1)))
    rows, starts = np.nonzero(np.diff(padded, axis=1) == 1)
    _, ends = np.nonzero(np.diff(padded, axis=1) == -1)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(ink.shape[0] + 1))
    for y in range(1, ink.shape[0]):
        a, b = first[y - 1], first[y]
        i, j = a, b
        while i < b and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                parent[root(j)] = root(i)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    if not len(rows):
        return np.zeros((0, 5), int)
    roots, at = np.unique([root(i) for i in range(len(rows))], return_inverse=True)
    out = np.zeros((len(roots), 5), int)
    out[:, 0], out[:, 2] = ink.shape[0], ink.shape[1]
    np.minimum.at(out[:, 0], at, rows)
    np.maximum.at(out[:, 1], at, rows + 1)
    np.minimum.at(out[:, 2], at, starts)
    np.maximum.at(out[:, 3], at, ends)
    np.add.at(out[:, 4], at, ends - starts)
    return out


def text_height(image: np.ndarray) -> int:
    """Median height of the parts shaped like glyphs, 0 if there are few."""
    g = grey(image)
    p = parts(g <= otsu(g))
    h, w = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
    h = h[(h >= GLYPH_LEAST) & (h <= g.shape[0] * GLYPH_SHARE) & (w <= h * GLYPH_WIDTH)]
    return int(np.median(h)) if len(h) >= GLYPHS else 0


def looks_handwritten(ink: np.ndarray) -> bool:
    """Enough ink, in few parts, much of it in the largest."""
    p = parts(ink)
    total = int(ink.sum())
    return total >= INK_LEAST and len(p) <= INK_PARTS and p[:, 4].max() / total >= INK_LARGEST


def covered(before: np.ndarray, after: np.ndarray, box: tuple[int, int, int, int]) -> float | None:
    """Share of a box's pixels that changed; null if shapes differ or the box is empty on the page."""
    if before.shape != after.shape:
        return None
    h, w = before.shape[:2]
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(w, box[2]), min(h, box[3])
    if x1 <= x0 or y1 <= y0:
        return None
    change = np.abs(before[y0:y1, x0:x1].astype(int) - after[y0:y1, x0:x1]).sum(2)
    return float((change > COVERED).mean())


def redacted(image: np.ndarray, boxes: list[tuple[int, int, int, int]], style: str = "solid") -> np.ndarray:
    """The image with its boxes (left, top, right, bottom) covered: solid, pixelated 3 by 3, or blurred by box means."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}")
    out = image.copy()
    for x0, y0, x1, y1 in boxes:
        part = out[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
        if not part.size:
            continue
        if style == "solid":
            part[:] = 0
        elif style == "pixelate":
            for ys in np.array_split(np.arange(part.shape[0]), 3):
                for xs in np.array_split(np.arange(part.shape[1]), 3):
                    if len(ys) and len(xs):
                        part[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1] = part[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1].mean((0, 1))
        else:
            r = max(4, int(0.6 * min(part.shape[:2])))
            for axis in (0, 1):
                pad = [(r, r) if a == axis else (0, 0) for a in range(3)]
                s = np.cumsum(np.pad(part.astype(float), pad, mode="edge"), axis=axis)
                s = np.concatenate([np.zeros_like(np.take(s, [0], axis)), s], axis=axis)
                n = part.shape[axis]
                part[:] = (np.take(s, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(s, np.arange(n), axis)) / (2 * r + 1)
    return out


def png(image: np.ndarray) -> bytes:
    """A PNG of the pixels alone: nothing of where they came from is written."""
    h, w, c = image.shape
    rows = image[:, :, ::-1] if c == 3 else image
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rows).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


# --- signatures -------------------------------------------------------------------------------------------------------

# Reach of a stroke when ink is thickened; a signature's least size in heights of its cue, its most fill.
REACH_X, REACH_Y, SIGN_WIDTH, SIGN_HEIGHT, SIGN_FILL = 5, 3, 3.4, 1.25, 0.85


def thickened(ink: np.ndarray) -> np.ndarray:
    """Ink wherever there is some within reach, from sums over a moving box."""
    sums = np.pad(ink.astype(np.int64), ((REACH_Y + 1, REACH_Y), (REACH_X + 1, REACH_X))).cumsum(0).cumsum(1)
    h, w = ink.shape
    y, x = 2 * REACH_Y + 1, 2 * REACH_X + 1
    return sums[y:, x:][:h, :w] - sums[:-y, x:][:h, :w] - sums[y:, :-x][:h, :w] + sums[:-y, :-x][:h, :w] > 0


def signature(image: np.ndarray, cue: tuple[int, int, int, int]) -> tuple[int, int, int, int] | None:
    """The box (left, top, width, height) of handwriting near a cue word's box; null if there is none.

    Its window, clipped to the page, is thresholded and thickened; of the parts that are large and loose enough the one
    with the most ink for its looseness is looked at, and must look written.
    """
    left, top, width, height = cue
    page = grey(image)
    x0, x1 = max(0, left - int(height * SIGN_X)), min(page.shape[1], left + width + int(height * SIGN_X))
    y0, y1 = max(0, top - int(height * SIGN_UP)), min(page.shape[0], top + height + int(height * SIGN_DOWN))
    window = page[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else page[:0]
    if not window.size:
        return None
    p = parts(thickened(window <= otsu(window)))
    h, w, area = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2], p[:, 4]
    fill = area / np.maximum(h * w, 1)
    fits = np.flatnonzero((w >= height * SIGN_WIDTH) & (h >= height * SIGN_HEIGHT) & (fill <= SIGN_FILL))
    if not len(fits):
        return None
    t, b, l, r, _ = p[fits[np.argmax((area * (1 - fill))[fits])]]
    inside = window[t:b, l:r]
    return (x0 + int(l), y0 + int(t), int(r - l), int(b - t)) if looks_handwritten(inside <= otsu(inside)) else None


# --- variants ---------------------------------------------------------------------------------------------------------

# Tiles of a side, and by how much a level may exceed the mean of a tile's histogram.
TILES, CLIP = 8, 3.0


def equalised(page: np.ndarray) -> np.ndarray:
    """Contrast evened tile by tile: histograms clipped, their excess spread, levels blended between the tiles' centres."""
    h, w = page.shape
    th, tw = -(-h // TILES), -(-w // TILES)
    padded = np.pad(page, ((0, th * TILES - h), (0, tw * TILES - w)), mode="reflect" if h > 1 and w > 1 and th * TILES - h < h and tw * TILES - w < w else "edge")
    tiles = padded.reshape(TILES, th, TILES, tw).swapaxes(1, 2).reshape(TILES * TILES, -1)
    n = np.stack([np.bincount(t, minlength=256) for t in tiles]).astype(float)
    most = max(1.0, CLIP * tiles.shape[1] / 256)
    n = np.minimum(n, most) + np.maximum(n - most, 0).sum(1, keepdims=True) / 256
    maps = (n.cumsum(1) * 255 / tiles.shape[1]).reshape(TILES, TILES, 256)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, TILES - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, TILES - 1)
    ya, xa = y.astype(int), x.astype(int)
    yb, xb = np.minimum(ya + 1, TILES - 1), np.minimum(xa + 1, TILES - 1)
    fy, fx = (y - ya)[:, None], (x - xa)[None, :]
    at = lambda r, c: maps[r[:, None], c[None, :], page]
    blended = (1 - fy) * ((1 - fx) * at(ya, xa) + fx * at(ya, xb)) + fy * ((1 - fx) * at(yb, xa) + fx * at(yb, xb))
    return np.clip(np.rint(blended), 0, 255).astype(np.uint8)


def enlarged(image: np.ndarray, factor: int) -> np.ndarray:
    """The image ``factor`` times as large, by Lanczos windows of three pixels."""
    if factor <= 1:
        return image
    out = image.astype(float)
    for axis in (0, 1):
        n = image.shape[axis]
        at = (np.arange(n * factor) + 0.5) / factor - 0.5
        taps = np.floor(at).astype(int)[:, None] + np.arange(-2, 4)
        weight = np.sinc(at[:, None] - taps) * np.sinc((at[:, None] - taps) / 3)
        weight = np.where((taps >= 0) & (taps < n), weight, 0)
        weight /= weight.sum(1, keepdims=True)
        rows = np.moveaxis(out, axis, 0)[np.clip(taps, 0, n - 1)]
        out = np.moveaxis((rows * weight.reshape(*weight.shape, *[1] * (rows.ndim - 2))).sum(1), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def variants(image: np.ndarray, factor: int = 1, union: bool = True) -> list[np.ndarray]:
    """Copies of a page for recognition, whose results are united: as it is, in grey, and in black and white."""
    image = enlarged(image, factor)
    if not union:
        return [image]
    g = grey(image)
    even = equalised(g)
    return [image, g[:, :, None], np.where(even > otsu(even), 255, 0).astype(np.uint8)[:, :, None]]


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image turned and mirrored as its EXIF orientation, 1 to 8, asks for; other numbers leave it."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    return np.ascontiguousarray(image)


# --- metadata ---------------------------------------------------------------------------------------------------------


def _tags(tiff: bytes) -> tuple[dict[int, int], dict[int, int]]:
    """Tags of the first two directories of a TIFF block, with the number that each holds or points at; damage ends them."""
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return {}, {}
    number = lambda at, n: int.from_bytes(tiff[at : at + n], order)
    found, at = [], number(4, 4)
    for _ in range(2):
        here: dict[int, int] = {}
        n = number(at, 2) if 8 <= at <= len(tiff) - 2 else 0
        for i in range(n):
            entry = at + 2 + 12 * i
            if entry + 12 > len(tiff):
                break
            here[number(entry, 2)] = number(entry + 8, 2 if number(entry + 2, 2) == 3 else 4)
        found.append(here)
        at = number(at + 2 + 12 * n, 4) if n else 0
    return found[0], found[1]


def metadata(raw: bytes) -> dict:
    """What a JPEG or PNG carries besides pixels: EXIF tags, position, thumbnail, orientation, and names of other blocks."""
    exif, keys = b"", []
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(raw):
            n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
            body = raw[at + 8 : at + 8 + n]
            if kind == b"eXIf":
                exif = body
            elif kind in (b"tEXt", b"iTXt", b"zTXt"):
                keys.append(body.split(b"\0")[0].decode("latin-1"))
            at += n + 12
    elif raw[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
            n = int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + n]
            if raw[at + 1] == 0xE1 and body.startswith(b"Exif\0\0"):
                exif = body[6:]
            elif raw[at + 1] == 0xFE:
                keys.append("comment")
            elif 0xE1 <= raw[at + 1] <= 0xEF:
                keys.append(f"app{raw[at + 1] - 0xE0}")
            at += 2 + max(n, 2)
    first, second = _tags(exif)
    return {"exif_tags": len(first), "has_gps": 0x8825 in first, "has_thumbnail": 0x0201 in second, "orientation": first.get(0x0112, 1), "info_keys": sorted(keys)}


def described(files: DataFrame) -> DataFrame:
    """Metadata of image files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([{"path": p, **metadata(bytes(c) if c is not None else b"")} for p, c in zip(rows["path"], rows["content"])], columns=["path", "exif_tags", "has_gps", "has_thumbnail", "orientation", "info_keys"])

    return files.select("path", "content").mapInPandas(run, "path string, exif_tags int, has_gps boolean, has_thumbnail boolean, orientation int, info_keys array<string>")


# --- over tables of images --------------------------------------------------------------------------------------------


IMAGE = ["height", "width", "nChannels", "data"]


def _attempt(fn):
    """``fn()`` and no error, or none and the error: a bad page is a row of its own and stops no other."""
    try:
        return fn(), None
    except Exception as e:  # whatever is wrong with the page
        return None, f"{type(e).__name__}: {e}"[:300]


def _image(r) -> np.ndarray:
    return upright(array(r.data, r.height, r.width, r.nChannels), getattr(r, "orientation", None) or 1)


def coverage(before: DataFrame, after: DataFrame, boxes: DataFrame) -> DataFrame:
    """(name, field, coverage) of boxes (name, field, x0, y0, x1, y1) between two runs of images (see sources.files.images).

    Null where the images' shapes differ, the box is off the page, or a page's bytes are not those of its shape.
    """
    a, b = before.select("name", *IMAGE), after.select("name", *(after[c].alias(f"after_{c}") for c in IMAGE))

    def one(r):
        return covered(array(r.data, r.height, r.width, r.nChannels), array(r.after_data, r.after_height, r.after_width, r.after_nChannels), (r.x0, r.y0, r.x1, r.y1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"name": rows["name"], "field": rows["field"], "coverage": [_attempt(lambda r=r: one(r))[0] for r in rows.itertuples()]})

    return a.join(b, "name").join(boxes, "name").mapInPandas(run, "name string, field string, coverage double")


def _rendered(images: DataFrame, boxes: DataFrame, draw) -> DataFrame:
    lists = boxes.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(*[c for c in boxes.columns if c != "name"]))).alias("boxes"))
    keep = [c for c in ("orientation",) if c in images.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                found = list(r.boxes) if r.boxes is not None else []
                got, error = _attempt(lambda r=r, found=found: png(draw(_image(r), found)))
                out.append((r.name, got, len(found), "failed" if error else "processed" if found else "no_pii_found", error))
            yield pd.DataFrame(out, columns=["name", "png", "regions", "status", "error"])

    return images.select("name", *IMAGE, *keep).join(lists, "name", "left").mapInPandas(run, "name string, png binary, regions int, status string, error string")


def render(images: DataFrame, boxes: DataFrame, style: str = "solid") -> DataFrame:
    """(name, png, regions, status, error) of every image: its boxes (name, x0, y0, x1, y1) covered, the same without any.

    Pixels are all that is written; a column ``orientation`` is applied first. A page that can't be read is a row with
    its error. An unknown style raises at once.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}")
    return _rendered(images, boxes.select("name", "x0", "y0", "x1", "y1"), lambda image, found: redacted(image, [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in found], style))


def outlined(image: np.ndarray, boxes: list, width: int = 3) -> np.ndarray:
    """The image with a frame around each box: red for what leaked, orange for what can't be told (BGR)."""
    out = image.copy() if image.shape[2] == 3 else np.repeat(image[:, :, :1], 3, axis=2)
    for b in boxes:
        colour = (0, 0, 220) if b["verdict"] == "leaked" else (0, 140, 255)
        x0, y0, x1, y1 = (max(0, v) for v in (b["x0"] - width, b["y0"] - width, b["x1"] + width, b["y1"] + width))
        for part in (out[y0 : y0 + width, x0:x1], out[max(0, y1 - width) : y1, x0:x1], out[y0:y1, x0 : x0 + width], out[y0:y1, max(0, x1 - width) : x1]):
            part[:] = colour
    return out


def annotate(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """As ``render``, with frames around boxes (name, x0, y0, x1, y1, verdict) instead."""
    return _rendered(images, boxes.select("name", "x0", "y0", "x1", "y1", "verdict"), outlined)


def write_images(rendered: DataFrame, path: str) -> DataFrame:
    """Writes the PNGs under ``path``, a folder that all machines share, each under its page's name, and gives what became of each page.

    A file is written beside its place and moved there, so a task that runs again leaves no half file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(path, exist_ok=True)
        for rows in batches:
            for name, data in zip(rows["name"], rows["png"]):
                if data is not None:
                    part = os.path.join(path, f".{uuid.uuid4().hex}")
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, os.path.join(path, os.path.basename(name)))
            yield rows[["name", "regions", "status", "error"]]

    return rendered.select("name", "png", "regions", "status", "error").mapInPandas(run, "name string, regions int, status string, error string")


def measured(images: DataFrame) -> DataFrame:
    """(name, text_height, factor, error): the height of a page's text and by how much it is enlarged for recognition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [_attempt(lambda r=r: text_height(_image(r))) for r in rows.itertuples()]
            yield pd.DataFrame({"name": rows["name"], "width": rows["width"], "height": rows["height"], "text_height": pd.array([h for h, _ in got], "Int32"), "error": [e for _, e in got]})

    out = images.mapInPandas(run, "name string, width int, height int, text_height int, error string")
    return out.select("name", "text_height", upscale_factor(F.col("text_height"), F.col("width"), F.col("height")).alias("factor"), "error")


def variant_rows(images: DataFrame, factors: DataFrame, union: bool = True) -> DataFrame:
    """(name, variant, height, width, nChannels, data, error): a row per copy of a page for recognition; ``factors`` is as of ``measured``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                got, error = _attempt(lambda r=r: variants(_image(r), int(r.factor), union))
                out += [(r.name, k, *v.shape, v.tobytes(), None) for k, v in enumerate(got or [])] or [(r.name, None, None, None, None, None, error)]
            yield pd.DataFrame(out, columns=["name", "variant", *IMAGE, "error"]).astype({"variant": "Int32", "height": "Int32", "width": "Int32", "nChannels": "Int32"})

    return images.join(factors.select("name", F.coalesce("factor", F.lit(1)).alias("factor")), "name").mapInPandas(run, "name string, variant int, height int, width int, nChannels int, data binary, error string")


def signatures(images: DataFrame, words: DataFrame) -> DataFrame:
    """(name, left, top, width, height) of signatures near cue words (name, text and a box) of the pages; a page that can't be read has none."""
    cues = words.where(is_signature_cue(F.col("text"))).groupBy("name").agg(F.collect_list(F.struct("left", "top", "width", "height")).alias("cues"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                found = [_attempt(lambda r=r, c=c: signature(_image(r), (c["left"], c["top"], c["width"], c["height"])))[0] for c in r.cues]
                out += [(r.name, k, *box) for k, box in enumerate(found) if box]
            yield pd.DataFrame(out, columns=["name", "seq", "left", "top", "width", "height"]).astype({"seq": "int64"})

    found = images.select("name", *IMAGE).join(cues, "name").mapInPandas(run, "name string, seq long, left int, top int, width int, height int")
    return drop_contained(found.withColumnRenamed("name", "page_id")).drop("seq").withColumnRenamed("page_id", "name")
