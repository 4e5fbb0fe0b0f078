"""Sources and sinks: page images, annotated corpora, tolerant JSON lines, histories, summaries."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Suffixes of page images.
IMAGES = ("png", "jpg", "jpeg", "tiff", "bmp")

ANNOTATION = "MAP<STRING, STRUCT<source: STRING, labelled_by: STRING, notes: STRING, visual: MAP<STRING, INT>, pii: ARRAY<STRUCT<field: STRING, expected_type: STRING, tier: STRING, text: STRING, box: ARRAY<INT>>>>>"
HISTORY = "at TIMESTAMP, run STRING, corpus STRING, recall_floor_pct DOUBLE, recall_ceiling_pct DOUBLE, totals STRUCT<redacted: BIGINT, leaked: BIGINT, unverifiable: BIGINT>, image_count INT, config MAP<STRING, STRING>, git STRUCT<sha: STRING, dirty: BOOLEAN, subject: STRING>, held_out BOOLEAN"


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and bytes of the page images of a folder, by path; an error if there is none."""
    glob = "*.{" + ",".join(IMAGES + tuple(x.upper() for x in IMAGES)) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if files.select("path").limit(1).isEmpty():  # before the sort, which would read all of them
        raise FileNotFoundError(f"no page image in {path}")
    return files.orderBy("path")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded page images: name, width, height, channels and rows of BGR bytes."""
    out = spark.read.format("image").option("dropInvalid", True).load(path)
    return out.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image.width", "image.height", "image.nChannels", "image.data")


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("body"))


def load(spark: SparkSession, root: str, name: str) -> tuple[dict, DataFrame]:
    """The corpus of that name under ``root``; an error that names those that are there, if it isn't."""
    known = catalog(spark, root)
    if name not in known:
        raise FileNotFoundError(f"no corpus {name!r}; there are {', '.join(known) or 'none'}")
    return corpus(spark, f"{root.rstrip('/')}/{name}/annotations.json")


def corpus(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A corpus's meta entry and its pages: filename, source, visual and pii. Raises if there is no such file."""
    raw = spark.read.text(path, wholetext=True)
    meta = raw.select(F.get_json_object("value", "$._meta").alias("m")).first()["m"]
    pages = _whole(spark, path, ANNOTATION).select(F.explode("body").alias("filename", "entry")).where(~F.startswith("filename", F.lit("_")))
    return json.loads(meta) if meta else {}, pages.select("filename", "entry.source", "entry.visual", "entry.pii")


def items(pages: DataFrame) -> DataFrame:
    """A row per annotated value; a missing tier is core, a null type stays null."""
    one = pages.select("filename", F.explode("pii").alias("item")).select("filename", "item.*")
    return one.withColumn("tier", F.coalesce("tier", F.lit("core")))


def existing(pages: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """Pages whose image is there."""
    return pages.join(files.select(key).distinct(), key, "left_semi")


def catalog(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root`` that have annotations, sorted: a corpus is a folder, so they are few."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "annotations.json").option("recursiveFileLookup", True).load(root).select("path")
    return sorted(PurePosixPath(r["path"]).parent.name for r in found.collect())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def tolerant_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that parse; blank and malformed ones are passed over."""
    body = T.StructType.fromDDL(schema + ", _corrupt STRING")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", body, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    return parsed.where("row._corrupt is null").select("row.*").drop("_corrupt")


def history(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scored runs of a corpus."""
    return tolerant_json_lines(spark, path, HISTORY).where((F.col("corpus") == name) & F.col("recall_floor_pct").isNotNull())


def append_history(runs: DataFrame, path: str) -> None:
    """Adds runs as JSON lines; whether a corpus is held out goes with each."""
    runs.write.mode("append").json(path)


def fields_to_corpus(rows: DataFrame, boxes: dict[str, tuple[str | None, str]], name: str = "filename") -> DataFrame:
    """Pages of a corpus (filename, pii) from a table with a struct (xmin, ymin, xmax, ymax) per field.

    ``boxes`` has each personal field's entity and tier; other fields and null boxes are left out.
    """
    item = lambda f, kind, tier: F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(kind).cast("string").alias("expected_type"), F.lit(tier).alias("tier"), F.lit(None).cast("string").alias("text"), F.array(*(F.col(f"{f}.{c}").cast("int") for c in ("xmin", "ymin", "xmax", "ymax"))).alias("box")))
    found = F.array(*(item(f, kind, tier) for f, (kind, tier) in boxes.items()))
    return rows.select(F.col(name).alias("filename"), F.filter(found, lambda x: x.isNotNull()).alias("pii"))


def detections(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(filename, kind, n) of the regions that a run's summary reports, from the first of the paths that there is; none gives no row."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            body = _whole(spark, path, "results ARRAY<STRUCT<filename: STRING, visual_regions: MAP<STRING, BIGINT>>>")
            return body.select(F.explode("body.results").alias("r")).select("r.filename", F.explode("r.visual_regions").alias("kind", "n"))
    return spark.createDataFrame([], "filename string, kind string, n long")


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(config, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _sum_of_maps(results: DataFrame, column: str) -> list:
    """Totals of a column of counts by kind, most first; kinds are few."""
    totals = results.select(F.explode(column).alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))
    return [(r["kind"], r["n"]) for r in totals.orderBy(F.desc("n"), "kind").collect()]


def write_score(spark: SparkSession, config: dict, sets: DataFrame, path: str) -> None:
    """One JSON object of a run's score from its counts (dimension, value, redacted, leaked, unverifiable, total), as of
    ``measure.by_sets``: totals, recall, and counts by type, tier and image. Images are written row by row as they come."""
    head: dict = {"config": config, "totals": {}, "by_type": {}, "by_tier": {}, "by_image": {}}
    names = {"type": "by_type", "tier": "by_tier", "page": "by_image"}
    for r in sets.orderBy("dimension", "value").toLocalIterator():
        counts = {v: r[v] for v in ("redacted", "leaked", "unverifiable")}
        if r["dimension"] == "total":
            n = r["total"]
            head["totals"] = counts
            head["recall_floor_pct"] = round(r["redacted"] * 100 / n, 1) if n else 0.0
            head["recall_ceiling_pct"] = round((r["redacted"] + r["unverifiable"]) * 100 / n, 1) if n else 0.0
            head["confirmed_visible"] = r["leaked"]
        else:
            head[names[r["dimension"]]][r["value"]] = counts
    write_config(spark, head, path)


def write_summary(results: DataFrame, path: str, config: dict | None = None) -> None:
    """One JSON object about a run of results (status, duration_seconds, entities and visual_regions as maps of counts):
    counts by status, seconds, and totals of entities and regions by kind, most first."""
    kinds = {c: _sum_of_maps(results, c) if c in results.columns else [] for c in ("entities", "visual_regions")}
    total = results.agg(
        F.count("*").alias("images"), F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "no_pii_found").alias("no_pii_found"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.sum("duration_seconds"), 2).alias("duration_seconds"),
    )
    r = total.first().asDict()
    seconds = r.pop("duration_seconds")
    body = {"config": config or {}, "duration_seconds": seconds or 0.0, "totals": {**r, **{c: sum(n for _, n in k) for c, k in kinds.items()}}, "entities_by_type": dict(kinds["entities"]), "visual_regions_by_type": dict(kinds["visual_regions"])}
    write_config(results.sparkSession, body, path)


def write_corpus(meta: dict, pages: DataFrame, path: str) -> None:
    """A corpus as one text file, meta first, characters as they are. A corpus is annotated by hand, so it is small."""
    body = {"_meta": meta} if meta else {}
    for row in pages.orderBy("filename").toLocalIterator():
        r = row.asDict(recursive=True)
        name = r.pop("filename")
        body[name] = {k: v for k, v in r.items() if v is not None}
    spark = pages.sparkSession
    spark.createDataFrame([(json.dumps(body, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def status(entities, error):
    """What became of a page: failed with an error, else whether it had anything."""
    return F.when(error.isNotNull(), "failed").when(entities > 0, "processed").otherwise("no_pii_found")
