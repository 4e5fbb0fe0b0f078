"""Interfaces of what needs a model or a native library: recognition of print, names, faces, codes, and page models.

A provider turns pages into one of the relations that the other operators take. None is bundled; the gazetteer finds
names that are listed, which is enough to run and test everything downstream.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from ..functions.text import shadow, spans


class WordProvider(Protocol):
    def words(self, images: DataFrame) -> DataFrame:
        """(page_id, variant, pos, text, left, top, width, height, conf)."""


class NameProvider(Protocol):
    def spans(self, documents: DataFrame) -> DataFrame:
        """(doc_id, entity_type, span_start, span_end, score)."""


class RegionProvider(Protocol):
    def regions(self, images: DataFrame) -> DataFrame:
        """(page_id, kind, left, top, width, height, decoded_payload)."""


class ReplyProvider(Protocol):
    def replies(self, images: DataFrame) -> DataFrame:
        """(page_id, content, page_w, page_h), for operators.replies."""


PROVIDERS: dict[str, dict[str, object]] = {"words": {}, "names": {}, "regions": {}, "replies": {}}


def provider(kind: str, name: str):
    if name not in PROVIDERS[kind]:
        raise ValueError(f"no {kind} provider {name!r}; there are {sorted(PROVIDERS[kind])}")
    return PROVIDERS[kind][name]


class Gazetteer:
    """Names of one word from a table (name, entity_type), by an equi-join on words."""

    def __init__(self, names: DataFrame, score: float = 0.85):
        self.names, self.score = names, score

    def spans(self, documents: DataFrame) -> DataFrame:
        """(doc_id, entity_type, span_start, span_end, score); a null text has none, names are compared in lower case."""
        shaded, (words,) = spans(documents.select("doc_id", shadow(F.col("text")).alias("shade")), "shade", [r"\w+"])
        each = shaded.select("doc_id", F.explode_outer(words).alias("w")).where("w.start is not null").select("doc_id", "w.*")
        names = self.names.select(F.lower("name").alias("name"), "entity_type").distinct()
        found = each.join(names, F.lower("value") == F.col("name"))
        return found.select("doc_id", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.lit(self.score).alias("score"))
