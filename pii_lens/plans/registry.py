"""Queries by name, each an operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import boxes as box_fn, text as text_fn
from ..operators import boxes as box_op, detect as det, lint, measure, pages as page_op, pixels, replies, track, words as word_op
from ..operators.providers import Gazetteer
from ..operators.replies import parse_replies
from ..sources import adapters, files
from . import catalog, lexicon, oracle as sql
from .catalog import named

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(check: str | None = None, name: str | None = None):
    def take(fn):
        QUERIES[name or fn.__name__] = fn
        if check:
            ORACLE[name or fn.__name__] = sql.counts_as_bigint(check)
        return fn

    return take


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.table(spark, sf, "documents")


GENERAL = named("email", "ip", "card", "phone")

# --- detection --------------------------------------------------------------------------------------------------------


@query(sql.detect(sql.DOCS, GENERAL))
def detect_general(spark, sf):
    return det.detect(docs(spark, sf), GENERAL)


@query(f"SELECT entity_type, lang, count(*) AS spans, count(DISTINCT f.doc_id) AS documents, round(avg(score), 6) AS mean_score FROM ({sql.detect(sql.DOCS, GENERAL)}) AS f JOIN documents d ON f.doc_id = d.doc_id WHERE score >= 0.4 GROUP BY entity_type, lang")
def detect_entity_by_lang(spark, sf):
    found = det.detect(docs(spark, sf).withColumn("key", F.struct("doc_id", "lang")), GENERAL, key="key", least=catalog.THRESHOLD)
    return found.groupBy("entity_type", F.col("key.lang").alias("lang")).agg(F.count("*").alias("spans"), F.countDistinct("key.doc_id").alias("documents"), F.round(F.avg("score"), 6).alias("mean_score")).orderBy(F.desc("spans"), "entity_type", "lang")


def _detector(recognizer: str):
    @query(sql.detect(sql.SYNTH, named(recognizer)), f"detect_{recognizer}")
    def run(spark, sf):
        return det.detect(adapters.made(spark, sf, adapters.SYNTH_IDS), named(recognizer))


for _name in ("ifsc", "driving_licence", "abha_strict", "abha_fallback", "vid_verhoeff", "masked_id", "abha_address", "upi", "vehicle", "aadhaar_tolerant", "aadhaar_strict", "pan", "voter", "passport", "gstin", "date", "us_passport"):
    _detector(_name)


@query(f"SELECT * FROM ({sql.detect(sql.SYNTH, catalog.RECOGNIZERS)}) AS f WHERE entity_type <> 'DATE_TIME' AND score >= 0.4")
def threshold_allowlist(spark, sf):
    return det.allowed(det.detect(adapters.made(spark, sf, adapters.SYNTH_IDS)))


@query(f"SELECT DISTINCT a.doc_id, a.entity_type, a.span_start, a.span_end, a.score AS base, b.score AS boosted FROM ({sql.detect(sql.SYNTH, named('abha_fallback', 'upi'), False)}) AS a JOIN ({sql.detect(sql.SYNTH, named('abha_fallback', 'upi'))}) AS b USING (doc_id, entity_type, span_start, span_end) WHERE b.score > a.score")
def context_boost(spark, sf):
    """Spans that words before them lift, with both scores; the two detections meet within the row."""
    ids, rs = adapters.made(spark, sf, adapters.SYNTH_IDS), named("abha_fallback", "upi")
    both = det.with_spans(det.with_spans(ids, rs, boost=False, into="plain"), rs, into="boosted")
    pairs = both.select("doc_id", F.explode_outer(F.arrays_zip("plain", "boosted")).alias("p")).where("p.boosted.score > p.plain.score")
    return pairs.select("doc_id", "p.plain.entity_type", "p.plain.span_start", "p.plain.span_end", F.col("p.plain.score").alias("base"), F.col("p.boosted.score").alias("boosted")).distinct()


@query(f"SELECT * FROM ({sql.detect(sql.SYNTH, catalog.registry(True))}) AS f WHERE entity_type = 'IN_AADHAAR'")
def registry_strict(spark, sf):
    return det.detect(adapters.made(spark, sf, adapters.SYNTH_IDS), catalog.registry(True)).where("entity_type = 'IN_AADHAAR'")


@query(f"SELECT f.doc_id, n.entity_type, f.span_start, f.span_end, f.score FROM ({sql.detect(sql.FORMS, sql.WORD, False, 'value')}) AS f JOIN (SELECT DISTINCT lower(c_mktsegment) AS name, 'ORGANIZATION' AS entity_type FROM customer) AS n ON lower(f.value) = n.name")
def names_gazetteer(spark, sf):
    names = adapters.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("ORGANIZATION").alias("entity_type"))
    return Gazetteer(names).spans(adapters.made(spark, sf, adapters.FORMS))


_SYNTH_DIGITS = f"SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM ({sql.SYNTH}) AS s WHERE length(regexp_replace(text, '[^0-9]', '', 'g')) > 0"


@query(f"SELECT * FROM ({_SYNTH_DIGITS}) AS d WHERE {sql.luhn('digits')}")
def luhn_filter(spark, sf):
    ids = adapters.made(spark, sf, adapters.SYNTH_IDS).select("doc_id", text_fn.digits(F.col("text")).alias("digits")).where("digits <> ''")
    return ids.where(text_fn.luhn_ok(F.col("digits")))


@query(f"SELECT * FROM ({_SYNTH_DIGITS}) AS d WHERE {sql.verhoeff('digits')}")
def verhoeff_filter(spark, sf):
    ids = adapters.made(spark, sf, adapters.SYNTH_IDS).select("doc_id", text_fn.digits(F.col("text")).alias("digits")).where("digits <> ''")
    return ids.where(text_fn.verhoeff_ok(F.col("digits")))


_FOUND = sql.detect(sql.DOCS, GENERAL)


def _redact_sql(recognizers) -> str:
    """Runs of overlapping spans of a document, and the pieces of text between them."""
    return f"""WITH f AS ({sql.detect(sql.DOCS, recognizers)}), n AS (
    SELECT doc_id, span_start, span_end, max(span_end) OVER (PARTITION BY doc_id ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f
), g AS (SELECT *, sum(CASE WHEN before IS NULL OR span_start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY span_start, span_end) AS run FROM n
), r AS (SELECT doc_id, run, min(span_start) AS a, max(span_end) AS b FROM g GROUP BY doc_id, run
), p AS (SELECT r.doc_id, run, b, substr(text, CAST(coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY run), 0) + 1 AS BIGINT), CAST(a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY run), 0) AS BIGINT)) || '[#]' AS part FROM r JOIN documents d ON d.doc_id = r.doc_id
), t AS (SELECT doc_id, string_agg(part, '' ORDER BY run) AS head, max(b) AS b FROM p GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN text ELSE head || substr(text, CAST(b + 1 AS BIGINT)) END AS redacted FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""


@query(_redact_sql(GENERAL))
def text_redact(spark, sf):
    return det.redact(docs(spark, sf), GENERAL)


# --- labels and lines -------------------------------------------------------------------------------------------------

_LINES = f"""SELECT doc_id, label, CAST(offset_ + strpos(line, label || ':') + length(label) + length(regexp_extract(substr(line, strpos(line, label || ':') + length(label) + 1), '^\\s*')) AS INTEGER) AS value_start, value FROM (
    SELECT doc_id, line, regexp_extract(line, '^\\s*([^:\\n]{{2,40}}?)\\s*:\\s*(\\S.*)$', 1) AS label, regexp_extract(line, '^\\s*([^:\\n]{{2,40}}?)\\s*:\\s*(\\S.*)$', 2) AS value,
        coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ({sql.FORMS}) AS f) AS l) AS x
    WHERE regexp_matches(label, '\\p{{L}}')"""


@query(_LINES)
def labelled_lines(spark, sf):
    return text_fn.labelled_lines(adapters.made(spark, sf, adapters.FORMS)).select("doc_id", "label", "value_start", "value")


@query(f"SELECT DISTINCT label, {sql.label_norm('label')} AS norm FROM ({_LINES}) AS l")
def normalise_label(spark, sf):
    return labelled_lines(spark, sf).select("label").distinct().select("label", text_fn.label_norm(F.col("label")).alias("norm"))


@query(f"SELECT norm, {sql.label_phrase('norm')} AS phrase, {sql.pii_label('norm')} AS personal, count(*) AS lines FROM (SELECT {sql.label_norm('label')} AS norm FROM ({_LINES}) AS l) AS n GROUP BY norm")
def label_decision(spark, sf):
    norm = labelled_lines(spark, sf).select(text_fn.label_norm(F.col("label")).alias("norm"))
    return norm.groupBy("norm").agg(F.count("*").alias("lines")).select("norm", text_fn.is_label_phrase(F.col("norm")).alias("phrase"), text_fn.is_pii_label(F.col("norm")).alias("personal"), "lines")


#: Where a form's personal values stand, whatever its labels say.
_VALUES = (catalog.Recognizer("VALUE", "form_value", ((r"Customer#\d+|\b\d{3,}\b", 1.0),)),)
_CARRIES = f"""SELECT l.doc_id, label, coalesce(bool_or(s.span_start IS NOT NULL), false) AS carries, {sql.pii_label(sql.label_norm('label'))} AS told
    FROM (SELECT *, row_number() OVER () AS n FROM ({_LINES}) AS x) AS l LEFT JOIN ({sql.detect(sql.FORMS, _VALUES, False)}) AS s
    ON s.doc_id = l.doc_id AND s.span_start >= l.value_start AND s.span_start < l.value_start + length(value) GROUP BY n, l.doc_id, label"""


@query(_CARRIES)
def label_lines(spark, sf):
    forms = adapters.made(spark, sf, adapters.FORMS)
    return measure.label_lines(text_fn.labelled_lines(forms), det.detect(forms, _VALUES, boost=False), text_fn.is_pii_label(text_fn.label_norm(F.col("l.label"))))


@query(f"""SELECT count_if(carries) AS personal, count_if(carries AND told) AS hits, count_if(told) AS told, round(count_if(carries AND told) * 1.0 / count_if(carries), 6) AS recall, round(count_if(carries AND told) * 1.0 / count_if(told), 6) AS precision
    FROM (SELECT * FROM ({_CARRIES}) AS l) AS x""")
def lexicon_precision_recall(spark, sf):
    both, ratio = F.count_if(F.col("carries") & F.col("told")), lambda a, b: F.round(F.try_divide(a * 1.0, b), 6)
    return label_lines(spark, sf).agg(F.count_if("carries").alias("personal"), both.alias("hits"), F.count_if("told").alias("told"), ratio(both, F.count_if("carries")).alias("recall"), ratio(both, F.count_if("told")).alias("precision"))


@query(f"SELECT label, count(*) AS lines FROM ({_LINES}) AS l WHERE NOT {sql.pii_label(sql.label_norm('label'))} GROUP BY label ORDER BY lines DESC, label LIMIT 10")
def blind_spots_topn(spark, sf):
    left = labelled_lines(spark, sf).where(~text_fn.is_pii_label(text_fn.label_norm(F.col("label"))))
    return left.groupBy("label").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "label").limit(10)


# --- spans against spans ----------------------------------------------------------------------------------------------

#: Labelled spans: the parts of an id's sentence that hold a digit; every third takes any type.
_SPAN_TRUTH = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ID' ELSE 'DECOY' END AS label, CAST(strpos(text, w) - 1 AS INTEGER) AS span_start, CAST(strpos(text, w) - 1 + length(w) AS INTEGER) AS span_end,
    CASE WHEN doc_id % 3 = 0 THEN [] ELSE ['IN_IFSC', 'IN_DRIVING_LICENCE', 'IN_ABHA', 'IN_AADHAAR'] END AS accepted
    FROM (SELECT doc_id, text, regexp_extract(text, '\\S*\\d\\S*') AS w FROM ({sql.SYNTH}) AS s) AS t WHERE w <> ''"""
_ALL = sql.detect(sql.SYNTH)
_OVER = "d.doc_id = t.doc_id AND d.span_start < t.span_end AND t.span_start < d.span_end"
_HITS = f"""SELECT t.doc_id, t.span_start, t.span_end, t.label, bool_or(d.entity_type IS NOT NULL) AS flagged, coalesce(bool_or(d.entity_type IS NOT NULL AND (len(t.accepted) = 0 OR list_contains(t.accepted, d.entity_type))), false) AS hit
    FROM (SELECT *, row_number() OVER () AS nth FROM ({_SPAN_TRUTH}) AS n) AS t LEFT JOIN (SELECT * FROM ({_ALL}) AS a WHERE entity_type <> 'DATE_TIME' AND score >= 0.4) AS d ON {_OVER} GROUP BY t.nth, t.doc_id, t.span_start, t.span_end, t.label"""


def _span_truth(spark, sf):
    ids = adapters.made(spark, sf, adapters.SYNTH_IDS).withColumn("w", F.regexp_extract("text", r"\S*\d\S*", 0)).where("w <> ''")
    start = F.expr("locate(w, text) - 1")
    accepted = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("IN_IFSC", "IN_DRIVING_LICENCE", "IN_ABHA", "IN_AADHAAR"))))
    return ids.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "ID").otherwise("DECOY").alias("label"), start.alias("span_start"), (start + F.length("w")).alias("span_end"), accepted.alias("accepted"))


def _hits(spark, sf):
    return measure.hits(_span_truth(spark, sf), threshold_allowlist(spark, sf))


@query(f"SELECT label, count(*) AS total, count_if(hit) AS hits, count_if(flagged) AS flagged, round(count_if(hit) * 1.0 / count(*), 6) AS recall FROM ({_HITS}) AS h GROUP BY label")
def span_recall_by_label(spark, sf):
    return measure.recall(_hits(spark, sf), ["label"])


@query(f"SELECT count(*) AS decoys, count_if(hit) AS mimicked, count_if(flagged) AS flagged, round(count_if(hit) * 1.0 / count(*), 6) AS mimicked_rate, round(count_if(flagged) * 1.0 / count(*), 6) AS flagged_rate FROM ({_HITS}) AS h WHERE label = 'DECOY'")
def decoy_rates(spark, sf):
    d = _hits(spark, sf).where("label = 'DECOY'").agg(F.count("*").alias("decoys"), F.count_if("hit").alias("mimicked"), F.count_if("flagged").alias("flagged"))
    return d.select("*", F.round(F.try_divide(F.col("mimicked") * 1.0, F.col("decoys")), 6).alias("mimicked_rate"), F.round(F.try_divide(F.col("flagged") * 1.0, F.col("decoys")), 6).alias("flagged_rate"))


@query(f"SELECT d.* FROM (SELECT * FROM ({_ALL}) AS a WHERE entity_type <> 'DATE_TIME' AND score >= 0.4) AS d WHERE NOT EXISTS (SELECT 1 FROM ({_SPAN_TRUTH}) AS t WHERE {_OVER})")
def spurious_detections(spark, sf):
    return measure.spurious(threshold_allowlist(spark, sf), _span_truth(spark, sf))


@query(f"SELECT lang, count(*) AS documents, count_if(f.doc_id IS NOT NULL) AS flagged, round(count_if(f.doc_id IS NOT NULL) * 1.0 / count(*), 6) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM ({_FOUND}) AS x WHERE score >= 0.4) AS f ON f.doc_id = d.doc_id GROUP BY lang")
def hard_negative_rate(spark, sf):
    hit = F.exists("found", lambda x: x["score"] >= catalog.THRESHOLD)
    told = det.with_spans(docs(spark, sf).select("lang", "text"), GENERAL).select("lang", hit.alias("hit"))
    return told.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("hit")).alias("flagged"), F.round(F.count_if(F.col("hit")) * 1.0 / F.count("*"), 6).alias("rate"))


# --- legibility -------------------------------------------------------------------------------------------------------


#: What the run that is judged covers: numbers of cards and telephones stay.
COVERED = named("email", "ip")


def _items(spark, sf):
    """What stands on a page: every value detected in its whole text, and the name of its source, which often doesn't."""
    d = docs(spark, sf).select("doc_id", "text", "source")
    found = F.transform("found", lambda x: F.struct(x["entity_type"].alias("expected_type"), F.substring(F.col("text"), x["span_start"] + 1, x["span_end"] - x["span_start"]).alias("text")))
    named_too = F.concat(found, F.array(F.struct(F.lit(None).cast("string").alias("expected_type"), F.col("source").alias("text"))))
    each = det.with_spans(d, GENERAL).select(F.col("doc_id").alias("page_id"), F.explode(named_too).alias("item")).where("item.text is not null")
    tier = F.when(F.col("quality") == 1, "core").when(F.col("quality") == 0, "sensitive")
    labels = adapters.table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), tier.alias("tier"), "toxic")
    return each.join(labels, "page_id", "left").select("page_id", "item.expected_type", "tier", "item.text", "toxic")


def _verdicts(spark, sf, told=False):
    d, items = docs(spark, sf), _items(spark, sf)
    before = d.select(F.col("doc_id").alias("page_id"), "text")
    after = det.redact(d, COVERED).select(F.col("doc_id").alias("page_id"), F.col("redacted").alias("text"))
    overrides = items.where("toxic is not null").select("page_id", "text", F.when(F.col("toxic") == 1, "leaked").otherwise("unsure").alias("verdict")) if told else None
    return measure.verdicts(items.drop("toxic"), before, after, overrides)


_ITEMS = f"""SELECT x.page_id, expected_type, CASE WHEN l.quality = 1 THEN 'core' WHEN l.quality = 0 THEN 'sensitive' END AS tier, x.text, l.toxic FROM (
    SELECT d.doc_id AS page_id, entity_type AS expected_type, substr(text, CAST(span_start + 1 AS BIGINT), CAST(span_end - span_start AS BIGINT)) AS text FROM ({_FOUND}) AS f JOIN documents d ON d.doc_id = f.doc_id
    UNION ALL SELECT doc_id, NULL, source FROM documents WHERE source IS NOT NULL) AS x LEFT JOIN labels l ON l.doc_id = x.page_id"""


_SHARE = lambda n, h: f"len(list_filter({n}, lambda t: list_contains({h}, t))) * 1.0 / len({n})"


def _verdict_sql(override: bool) -> str:
    told = "WHEN EXISTS (SELECT 1 FROM labels o WHERE o.doc_id = x.page_id AND o.toxic = 1) THEN 'leaked'" if override else ""
    return f"""SELECT page_id, expected_type, tier, text, CASE {told} WHEN len(n) > 0 AND {_SHARE('n', 'a')} >= 0.6 THEN 'leaked' WHEN len(n) > 0 AND {_SHARE('n', 'b')} >= 0.6 THEN 'redacted' ELSE 'unverifiable' END AS verdict FROM (
        SELECT i.page_id, i.expected_type, i.tier, i.text, {sql.tokens('i.text')} AS n, {sql.tokens('d.text')} AS b, {sql.tokens('r.redacted')} AS a FROM ({_ITEMS}) AS i JOIN documents d ON d.doc_id = i.page_id JOIN ({_redact_sql(COVERED)}) AS r ON r.doc_id = i.page_id) AS x"""


@query(f"SELECT page_id, len({sql.tokens('i.text')}) AS n, CAST(round({_SHARE(sql.tokens('i.text'), sql.tokens('d.text'))}, 6) AS DOUBLE) AS share FROM ({_ITEMS}) AS i JOIN documents d ON d.doc_id = i.page_id + 1 WHERE len({sql.tokens('i.text')}) > 0")
def token_presence(spark, sf):
    pages = docs(spark, sf).select((F.col("doc_id") - 1).alias("page_id"), text_fn.tokens(F.col("text")).alias("has"))
    items = _items(spark, sf).select("page_id", text_fn.tokens(F.col("text")).alias("needle")).join(pages, "page_id").where(F.size("needle") > 0)
    return items.select("page_id", F.size("needle").cast("long").alias("n"), F.round(text_fn.share_present(F.col("needle"), F.col("has")), 6).alias("share"))


@query(_verdict_sql(False))
def verdict_counts(spark, sf):
    return _verdicts(spark, sf).select("page_id", "expected_type", "tier", "text", "verdict")


@query(_verdict_sql(True))
def vision_override(spark, sf):
    return _verdicts(spark, sf, True).select("page_id", "expected_type", "tier", "text", "verdict")


_C = "count_if(verdict = 'redacted') AS redacted, count_if(verdict = 'leaked') AS leaked, count_if(verdict = 'unverifiable') AS unverifiable, count(*) AS total"


@query(f"""WITH v AS (SELECT coalesce(expected_type, '(no recognizer)') AS kind, coalesce(tier, 'core') AS tier, CAST(page_id AS VARCHAR) AS page, verdict FROM ({_verdict_sql(False)}) AS x)
    SELECT 'total' AS dimension, '' AS value, {_C} FROM v UNION ALL SELECT 'type', kind, {_C} FROM v GROUP BY kind UNION ALL SELECT 'tier', tier, {_C} FROM v GROUP BY tier UNION ALL SELECT 'page', page, {_C} FROM v GROUP BY page""")
def verdict_grouping_sets(spark, sf):
    return measure.by_sets(_verdicts(spark, sf))


@query(f"SELECT redacted, leaked, unverifiable, round(redacted * 100.0 / total, 4) AS floor_pct, round((redacted + unverifiable) * 100.0 / total, 4) AS ceiling_pct FROM (SELECT {_C} FROM ({_verdict_sql(False)}) AS v) AS c")
def recall_band(spark, sf):
    c = _verdicts(spark, sf).agg(*measure.counts())
    floor, ceiling = measure.band(*(F.col(v) for v in measure.VERDICTS))
    return c.select("*", floor.alias("floor_pct"), ceiling.alias("ceiling_pct"))


_NAMES = """WITH a AS (SELECT 'c' || CAST(c_custkey AS STRING) AS id, c_nationkey AS page, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS s FROM customer),
    b AS (SELECT 's' || CAST(s_suppkey AS STRING) AS id, s_nationkey AS page, lower(regexp_replace(replace(s_name, 'Supplier', 'Customer'), '[^A-Za-z0-9]', '', 'g')) AS s FROM supplier)"""
_ALIKE = "a.page = b.page AND a.s <> '' AND b.s <> '' AND (contains(a.s, b.s) OR contains(b.s, a.s))"


@query(f"{_NAMES} SELECT id, 'a' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_ALIKE}) UNION ALL SELECT id, 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_ALIKE})")
def similar_audit_antijoin(spark, sf):
    """What either side has on a page and the other has nothing like."""
    a = adapters.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("page"), F.col("c_name").alias("text"))
    b = adapters.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("page"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("text"))
    return measure.unlike(a, b).withColumn("side", F.lit("a")).unionByName(measure.unlike(b, a).withColumn("side", F.lit("b"))).select("id", "side")


# --- runs, history, merging -------------------------------------------------------------------------------------------


@query(f"""WITH a AS ({adapters.RUN_A}), b AS ({adapters.RUN_B}), j AS (SELECT a.image, a.verdict AS v, b.verdict AS w FROM a JOIN b ON a.image = b.image AND a.value = b.value)
    SELECT count(*) AS scored, count_if(v = 'leaked') AS base_leaks, count_if(w = 'leaked') AS cand_leaks, count_if(v = 'leaked' AND w = 'redacted') AS caught, count_if(v = 'redacted' AND w = 'leaked') AS regressed,
    (SELECT count(*) FROM (SELECT image FROM a INTERSECT SELECT image FROM b)) AS images, CASE WHEN count_if(v = 'leaked' AND w = 'redacted') > 0 THEN round(90.0 / count_if(v = 'leaked' AND w = 'redacted'), 4) END AS seconds_per_catch FROM j""")
def run_compare(spark, sf):
    return measure.compare(adapters.made(spark, sf, adapters.RUN_A), adapters.made(spark, sf, adapters.RUN_B), (30.0, 120.0))


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM (SELECT DISTINCT doc_id AS k FROM documents) AS a FULL JOIN (SELECT c_custkey AS k FROM customer) AS b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def coverage_warning(spark, sf):
    return measure.coverage_warning(docs(spark, sf).select(F.col("doc_id").alias("k")), adapters.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("""SELECT s_suppkey AS page, 'fresh' AS origin, s_name AS verdict FROM supplier
    UNION ALL SELECT o_custkey, 'kept', o_orderpriority FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) AND o_custkey IN (SELECT doc_id FROM documents)""")
def merge_on_write(spark, sf):
    fresh = adapters.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_name").alias("verdict"))
    stored = adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("verdict"))
    return track.merge_on_write(fresh, stored, docs(spark, sf).select(F.col("doc_id").alias("page")), ["page"])


@query("""WITH f AS (SELECT DISTINCT o_custkey AS file FROM orders), k AS (SELECT c_mktsegment AS corpus, c_custkey AS file FROM customer)
    SELECT corpus, count(f.file) AS shared, (SELECT count(*) FROM f) AS files, count(f.file) * 2 >= (SELECT count(*) FROM f) AS matches FROM k LEFT JOIN f ON f.file = k.file GROUP BY corpus""")
def corpus_match(spark, sf):
    files = adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("file"))
    return track.corpus_matches(files, adapters.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("corpus"), F.col("c_custkey").alias("file")))


_H = f"({adapters.HISTORY}) AS h"


def _history(spark, sf):
    return adapters.made(spark, sf, adapters.HISTORY)


@query(f"""SELECT corpus, day, CASE WHEN pi IS NULL THEN 'first' WHEN pi <> image_count THEN 'resized' WHEN abs(d) < 0.05 THEN 'unchanged' WHEN d > 0 THEN 'up' ELSE 'down' END AS change, CASE WHEN pi = image_count THEN d END AS points
    FROM (SELECT *, lag(image_count) OVER w AS pi, round(recall_floor_pct - lag(recall_floor_pct) OVER w, 4) AS d FROM {_H} WINDOW w AS (PARTITION BY corpus ORDER BY day)) AS x""")
def history_delta(spark, sf):
    return track.deltas(_history(spark, sf))


@query(f"SELECT corpus, day, recall_floor_pct, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY corpus ORDER BY day DESC) AS INTEGER) AS nth FROM {_H}) AS x WHERE nth <= 12")
def history_last12(spark, sf):
    return track.newest(_history(spark, sf)).select("corpus", "day", "recall_floor_pct", "nth")


@query(f"SELECT corpus, day, round((recall_floor_pct - min(recall_floor_pct) OVER w) / greatest(max(recall_floor_pct) OVER w - min(recall_floor_pct) OVER w, 1.0), 6) AS y FROM {_H} WINDOW w AS (PARTITION BY corpus) QUALIFY count(*) OVER w >= 2")
def sparkline_scaling(spark, sf):
    return track.sparkline(_history(spark, sf))


@query(f"SELECT corpus, count(*) AS commits, CAST(sum(n) AS BIGINT) AS runs, max(n) AS most_of_one FROM (SELECT corpus, sha, count(*) AS n FROM {_H} GROUP BY corpus, sha) AS x GROUP BY corpus")
def distinct_commits(spark, sf):
    return track.commits(_history(spark, sf))


@query(f"SELECT corpus, day, sha, count(*) OVER (PARTITION BY corpus, sha ORDER BY day) AS times FROM {_H}")
def commit_scored_count(spark, sf):
    return track.scored_so_far(_history(spark, sf))


@query("SELECT o_orderstatus AS status, count(*) AS images, round(sum(o_totalprice), 2) AS seconds FROM orders GROUP BY o_orderstatus")
def status_summary(spark, sf):
    return adapters.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("images"), F.round(F.sum("o_totalprice"), 2).alias("seconds"))


@query(f"SELECT label AS entity, count(*) AS entities FROM ({sql.BOXES}) AS b GROUP BY label")
def entity_map_totals(spark, sf):
    """Totals of a map of counts per page."""
    pages = adapters.made(spark, sf, adapters.BOXES).groupBy("page_id", "label").agg(F.count("*").alias("n"))
    pages = pages.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("entities"))
    return pages.select(F.explode("entities").alias("entity", "n")).groupBy("entity").agg(F.sum("n").alias("entities")).orderBy(F.desc("entities"))


@query("SELECT CASE WHEN l.quality = 1 THEN 'core' WHEN l.quality = 0 THEN 'sensitive' ELSE '(all)' END AS tier, n AS items FROM (SELECT quality, count(*) AS n FROM labels GROUP BY ROLLUP (quality)) AS l")
def truth_inventory(spark, sf):
    tier = F.when(F.col("quality") == 1, "core").when(F.col("quality") == 0, "sensitive").otherwise("(all)")
    return adapters.table(spark, sf, "labels").rollup("quality").agg(F.count("*").alias("items")).select(tier.alias("tier"), "items")


# --- boxes ------------------------------------------------------------------------------------------------------------


def _boxes(spark, sf):
    return adapters.made(spark, sf, adapters.BOXES)


def _regions(spark, sf):
    return adapters.made(spark, sf, adapters.REGIONS)


@query(f'SELECT page_id, pos, CAST(floor(("left" - 150) / 3.0) AS INTEGER) AS "left", CAST(floor(top / 3.0) AS INTEGER) AS top, CAST(floor(width / 3.0) AS INTEGER) AS width, CAST(floor(height / 3.0) AS INTEGER) AS height FROM ({sql.BOXES}) AS b')
def box_rescale(spark, sf):
    return _boxes(spark, sf).select("page_id", "pos", box_fn.rescale(F.col("left") - 150, 3).alias("left"), *(box_fn.rescale(F.col(c), 3).alias(c) for c in ("top", "width", "height")))


_PAD = "CASE label WHEN 'face' THEN 0.30 WHEN 'signature' THEN 0.15 WHEN 'qr_code' THEN 0.08 WHEN 'barcode' THEN 0.08 ELSE 0.05 END"


@query(f"""SELECT page_id, pos, CAST(greatest(0, "left" - px) AS INTEGER) AS x0, CAST(greatest(0, top - py) AS INTEGER) AS y0, CAST(least(200, "left" + width + px) AS INTEGER) AS x1, CAST(least(150, top + height + py) AS INTEGER) AS y1,
    CAST(least(width, 200 - least("left", 200)) AS INTEGER) AS clamped_width, CAST(least(height, 150 - least(top, 150)) AS INTEGER) AS clamped_height FROM (
    SELECT *, greatest(2, CAST(trunc(width * {_PAD}) AS INTEGER)) AS px, greatest(2, CAST(trunc(height * {_PAD}) AS INTEGER)) AS py FROM ({sql.BOXES}) AS b) AS p""")
def box_clamp_pad(spark, sf):
    b, size = [F.col(c) for c in ("left", "top", "width", "height")], (F.lit(200), F.lit(150))
    x0, y0, x1, y1 = box_fn.padded(F.col("label"), *b, *size)
    _, _, w, h = box_fn.clamp(*b, *size)
    return _boxes(spark, sf).select("page_id", "pos", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), w.alias("clamped_width"), h.alias("clamped_height"))


@query(f"""SELECT page_id, label, x AS "left", y AS top, min(variant * 100 + pos) AS first_seen FROM (SELECT page_id, label, CAST("left" - "left" % 100 AS INTEGER) AS x, CAST(top - top % 100 AS INTEGER) AS y, variant, pos FROM ({sql.BOXES}) AS b) AS g GROUP BY page_id, label, x, y""")
def variant_union_dedup(spark, sf):
    coarse = _boxes(spark, sf).select("page_id", "label", (F.col("left") - F.col("left") % 100).alias("left"), (F.col("top") - F.col("top") % 100).alias("top"), F.lit(100).alias("width"), F.lit(100).alias("height"), "variant", "pos")
    return box_op.union_variants(coarse).select("page_id", "label", "left", "top", (F.col("variant") * 100 + F.col("pos")).alias("first_seen"))


_CONT = 'b.page_id = a.page_id AND b.pos < a.pos AND b."left" <= a."left" AND b.top <= a.top AND a."left" + a.width <= b."left" + b.width AND a.top + a.height <= b.top + b.height'
_COARSE = f'SELECT page_id, pos, label, CAST("left" - "left" % 100 AS INTEGER) AS "left", CAST(top - top % 100 AS INTEGER) AS top, width, height FROM ({sql.BOXES}) AS x'


def _coarse(spark, sf):
    return _boxes(spark, sf).select("page_id", "pos", "label", (F.col("left") - F.col("left") % 100).alias("left"), (F.col("top") - F.col("top") % 100).alias("top"), "width", "height")


@query(f"SELECT page_id, pos FROM ({_COARSE}) AS a WHERE NOT EXISTS (SELECT 1 FROM ({_COARSE}) AS b WHERE {_CONT})")
def containment_dedup(spark, sf):
    return box_op.drop_contained(_coarse(spark, sf).withColumn("seq", F.col("pos"))).select("page_id", "pos")


@query(f"SELECT page_id, pos, label FROM ({sql.BOXES}) AS a WHERE NOT EXISTS (SELECT 1 FROM ({adapters.REGIONS}) AS b WHERE a.page_id = b.page_id AND a.label IN ('PERSON', 'LOCATION', 'ORGANIZATION', 'NRP') AND {sql.overlap('a', 'b')} * 1.0 / (a.width * a.height) >= 0.5)")
def clinical_veto(spark, sf):
    return box_op.veto(_boxes(spark, sf), _regions(spark, sf)).select("page_id", "pos", "label")


@query(f"SELECT a.page_id, pos, round({sql.overlap('a', 'b')} * 1.0 / (a.width * a.height), 6) AS fraction FROM ({sql.BOXES}) AS a JOIN ({adapters.REGIONS}) AS b ON a.page_id = b.page_id")
def overlap_fraction(spark, sf):
    a, b = _boxes(spark, sf).alias("a"), _regions(spark, sf).alias("b")
    return a.join(b, F.col("a.page_id") == F.col("b.page_id")).select("a.page_id", "pos", F.round(box_fn.overlap_fraction(box_fn.box("a."), box_fn.box("b.")), 6).alias("fraction"))


_SHIFT = f'SELECT page_id, pos, "left" + pos % 3 AS "left", top, width, height FROM ({sql.BOXES}) AS s'


@query(f"""SELECT page_id, count_if(best >= 0.9) AS matched, greatest(count(*), max(m)) AS boxes, round(min(best), 6) AS worst FROM (
    SELECT a.page_id, a.pos, max({sql.overlap('a', 'b')} * 1.0 / (a.width * a.height + b.width * b.height - {sql.overlap('a', 'b')})) AS best, (SELECT count(*) FROM lineitem WHERE l_orderkey = a.page_id) AS m FROM ({sql.BOXES}) AS a JOIN ({_SHIFT}) AS b ON a.page_id = b.page_id GROUP BY a.page_id, a.pos) AS x GROUP BY page_id""")
def iou_agreement(spark, sf):
    ours = _boxes(spark, sf)
    return box_op.agreement(ours, ours.withColumn("left", F.col("left") + F.col("pos") % 3))


def _merge_sql(source: str, rounds: int) -> str:
    """Boxes take the rectangle around all that are near them, in rounds, as many as a group may need."""
    gap = lambda s, e: f"greatest(0, greatest(a.{s}, b.{s}) - least(a.{e}, b.{e}))"
    steps = [f"""s0 AS (SELECT DISTINCT x.page_id, x.label, "left" AS x0, top AS y0, "left" + width AS x1, top + height AS y1, m FROM ({source}) AS x
        JOIN (SELECT page_id, label, list_sort(list(height))[len(list(height)) // 2 + 1] AS m FROM ({source}) AS y GROUP BY page_id, label) AS y ON x.page_id = y.page_id AND x.label = y.label)"""]
    for k in range(1, rounds + 1):
        steps.append(f"""s{k} AS (SELECT DISTINCT page_id, label, x0, y0, x1, y1, m FROM (SELECT a.page_id, a.label, min(b.x0) AS x0, min(b.y0) AS y0, max(b.x1) AS x1, max(b.y1) AS y1, a.m FROM s{k - 1} a JOIN s{k - 1} b
            ON a.page_id = b.page_id AND a.label = b.label AND {gap('y0', 'y1')} <= 1.6 * a.m AND {gap('x0', 'x1')} <= 0.5 * a.m GROUP BY a.page_id, a.label, a.x0, a.y0, a.x1, a.y1, a.m) AS g)""")
    return f"""WITH {', '.join(steps)} SELECT page_id, label, CAST(x0 AS INTEGER) AS "left", CAST(y0 AS INTEGER) AS top, CAST(x1 - x0 AS INTEGER) AS width, CAST(y1 - y0 AS INTEGER) AS height FROM s{rounds}"""


@query(_merge_sql(sql.BOXES, 8))
def block_merge(spark, sf):
    return box_op.merge_blocks(_boxes(spark, sf))


@query(f"""SELECT page_id, label, "left", top, width, height FROM (SELECT *, row_number() OVER (PARTITION BY page_id, "left", top, width, height ORDER BY source, label) AS n FROM (
    SELECT page_id, label, "left", top, width, height, 0 AS source FROM ({_COARSE}) AS a UNION ALL SELECT page_id, 'region', CAST("left" - "left" % 100 AS INTEGER), CAST(top - top % 100 AS INTEGER), width, height, 1 FROM ({adapters.REGIONS}) AS b) AS u) AS x WHERE n = 1""")
def geometry_union(spark, sf):
    coarse = _regions(spark, sf).select("page_id", F.lit("region").alias("label"), (F.col("left") - F.col("left") % 100).alias("left"), (F.col("top") - F.col("top") % 100).alias("top"), "width", "height")
    return box_op.union_geometry(_coarse(spark, sf), coarse)


@query(f"SELECT page_id, count(*) AS withdrawn FROM ({sql.BOXES}) AS a WHERE EXISTS (SELECT 1 FROM ({adapters.REGIONS}) AS b WHERE a.page_id = b.page_id AND a.label IN ('PERSON', 'LOCATION', 'ORGANIZATION', 'NRP') AND {sql.overlap('a', 'b')} * 1.0 / (a.width * a.height) >= 0.5) GROUP BY page_id")
def veto_withdrawn(spark, sf):
    return box_op.vetoed_counts(_boxes(spark, sf), _regions(spark, sf))


@query(f'SELECT page_id, pos, "left" + 7 AS "left", top - 3 AS top, width, height FROM ({sql.BOXES}) AS b')
def words_shifted(spark, sf):
    return word_op.shifted(_boxes(spark, sf), 7, -3).select("page_id", "pos", *word_op.GEOMETRY)


@query(f'SELECT page_id, pos, {", ".join(f"""CAST(round_even("{c}" * 1.5, 0) AS INTEGER) AS "{c}" """ for c in ("left", "top", "width", "height"))} FROM ({sql.BOXES}) AS b')
def words_scaled(spark, sf):
    return word_op.scaled(_boxes(spark, sf), 1.5).select("page_id", "pos", *word_op.GEOMETRY)


_SIGN = "trunc(height * 14.0)", "trunc(height * 12.5)", "trunc(height * 2.0)"


@query(f"""SELECT page_id, CAST(max(greatest(0, {_SIGN[0]} - "left")) AS INTEGER) AS left_over, CAST(max(greatest(0, {_SIGN[1]} - top)) AS INTEGER) AS top_over, CAST(max(greatest(0, "left" + width + {_SIGN[0]} - page_w)) AS INTEGER) AS right_over,
    CAST(max(greatest(0, top + height + {_SIGN[2]} - page_h)) AS INTEGER) AS bottom_over FROM ({adapters.CUES}) AS c WHERE regexp_replace(lower(trim(text)), '^[.:,;]+|[.:,;]+$', '', 'g') IN ({', '.join(map(sql.quoted, lexicon.SIGNATURE_CUES))}) GROUP BY page_id""")
def window_clipping(spark, sf):
    cues = adapters.made(spark, sf, adapters.CUES).where(text_fn.is_signature_cue(F.col("text")))
    over = box_fn.clipping(*(F.col(c) for c in ("left", "top", "width", "height", "page_w", "page_h")))
    return cues.groupBy("page_id").agg(*(F.max(c).alias(f"{n}_over") for c, n in zip(over, ("left", "top", "right", "bottom"))))


@query("""SELECT page_id, CAST(CASE WHEN narrow THEN round_even(h * 1.5, 0) ELSE w END AS INTEGER) AS page_w, CAST(CASE WHEN narrow THEN h ELSE round_even(w / 1.5, 0) END AS INTEGER) AS page_h,
    CAST(CASE WHEN narrow THEN floor((round_even(h * 1.5, 0) - w) / 2) ELSE 0 END AS INTEGER) AS dx, CAST(CASE WHEN narrow THEN 0 ELSE floor((round_even(w / 1.5, 0) - h) / 2) END AS INTEGER) AS dy
    FROM (SELECT page_id, w, h, w * 1.0 / h < 1.5 AS narrow FROM (SELECT p_partkey AS page_id, CAST(p_partkey % 700 + 200 AS INTEGER) AS w, CAST(p_size * 11 + 100 AS INTEGER) AS h FROM part) AS p) AS q""")
def page_padding(spark, sf):
    w, h = (F.col("p_partkey") % 700 + 200).cast("int"), (F.col("p_size") * 11 + 100).cast("int")
    got = box_fn.padded_page(w, h, 1.5)
    return adapters.table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), *(c.alias(n) for c, n in zip(got, ("page_w", "page_h", "dx", "dy"))))


@query(f'SELECT page_id, pos, CAST(greatest(0, least(640, floor("left" * 640 / 1000))) AS INTEGER) AS x, CAST(greatest(0, least(480, floor((top * 7 - 90) * 480 / 1000))) AS INTEGER) AS y FROM ({sql.BOXES}) AS b')
def pixel_coordinates(spark, sf):
    return _boxes(spark, sf).select("page_id", "pos", box_fn.to_pixels(F.col("left"), F.lit(640)).alias("x"), box_fn.to_pixels(F.col("top") * 7 - 90, F.lit(480)).alias("y"))


@query(f"SELECT label, list_sort(list(height))[len(list(height)) // 2 + 1] AS upper_median FROM ({sql.BOXES}) AS b GROUP BY label")
def upper_median(spark, sf):
    return box_op.upper_median(_boxes(spark, sf), ["label"], "height")


@query(f"SELECT label, CAST(trunc(median(height)) AS INTEGER) AS text_height FROM ({sql.BOXES}) AS b GROUP BY label")
def true_median(spark, sf):
    return _boxes(spark, sf).groupBy("label").agg(F.median("height").cast("int").alias("text_height"))


@query(f"""SELECT page_id, pos, CAST("left" - trunc(height * 14.0) AS INTEGER) AS x0, CAST(top - trunc(height * 12.5) AS INTEGER) AS y0, CAST("left" + width + trunc(height * 14.0) AS INTEGER) AS x1, CAST(top + height + trunc(height * 2.0) AS INTEGER) AS y1 FROM ({sql.BOXES}) AS b""")
def signature_window(spark, sf):
    got = box_fn.signature_window(*(F.col(c) for c in ("left", "top", "width", "height")))
    return _boxes(spark, sf).select("page_id", "pos", *(c.alias(n) for c, n in zip(got, ("x0", "y0", "x1", "y1"))))


@query("""SELECT p_partkey AS page_id, CASE WHEN h <= 0 THEN 1 ELSE least(greatest(1, least(3, CAST(round_even(24.0 / h, 0) AS INTEGER))), greatest(1, CAST(floor(2400 / w) AS INTEGER))) END AS factor
    FROM (SELECT p_partkey, CAST(p_size % 23 AS INTEGER) AS h, CAST(p_partkey % 2400 + 100 AS INTEGER) AS w FROM part) AS p""")
def upscale_rule(spark, sf):
    part = adapters.table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_size") % 23).cast("int").alias("h"), (F.col("p_partkey") % 2400 + 100).cast("int").alias("w"))
    return part.select("page_id", box_fn.upscale_factor(F.col("h"), F.col("w"), F.col("w")).alias("factor"))


# --- words on pages ---------------------------------------------------------------------------------------------------


def _words(spark, sf):
    return adapters.words(adapters.made(spark, sf, adapters.FORMS))


@query(f"SELECT page_id, pos, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({sql.WORDS}) AS w")
def word_offsets(spark, sf):
    return word_op.word_offsets(_words(spark, sf)).select("page_id", "pos", "text", "offset")


#: Words come to rows one after another, each step of the recursion one word of every page.
_ROWS = f"""WITH RECURSIVE w AS (SELECT page_id, pos, "left", top, height, top + height / 2.0 AS c, CAST(row_number() OVER (PARTITION BY page_id ORDER BY top, "left", pos) AS INTEGER) AS n FROM ({adapters.TILTED}) AS x WHERE trim(text) <> ''),
    s AS (SELECT page_id, 0 AS n, CAST([] AS STRUCT(n INTEGER, c DOUBLE, h DOUBLE)[]) AS held, CAST([] AS INTEGER[]) AS placed FROM (SELECT DISTINCT page_id FROM w) AS p
        UNION ALL SELECT page_id, n, CASE WHEN hit IS NULL THEN list_append(held, {{'n': 1, 'c': CAST(c AS DOUBLE), 'h': CAST(height AS DOUBLE)}}) ELSE list_transform(held, lambda r, k: CASE WHEN k = hit THEN {{'n': CAST(r.n + 1 AS INTEGER), 'c': CAST(r.c + c AS DOUBLE), 'h': CAST(r.h + height AS DOUBLE)}} ELSE r END) END, list_append(placed, CAST(coalesce(hit, len(held) + 1) AS INTEGER))
        FROM (SELECT s.page_id, w.n, held, placed, w.c, w.height, CAST(list_sort(list_filter(list_transform(held, lambda r, k: [CAST(abs(w.c - r.c / r.n) AS DOUBLE), CAST(k AS DOUBLE), CAST(greatest(r.h / r.n, w.height, 1) * 0.6 AS DOUBLE)]), lambda g: g[1] <= g[3]))[1][2] AS INTEGER) AS hit FROM s JOIN w ON w.page_id = s.page_id AND w.n = s.n + 1) AS t)
    SELECT w.page_id, w.pos, CAST(row_number() OVER (PARTITION BY w.page_id ORDER BY held[placed[w.n]].c / held[placed[w.n]].n, placed[w.n], w."left", w.n) - 1 AS INTEGER) AS nth
    FROM w JOIN (SELECT page_id, max_by(held, n) AS held, max_by(placed, n) AS placed FROM s GROUP BY page_id) AS f ON f.page_id = w.page_id"""


@query(_ROWS)
def reading_order(spark, sf):
    return word_op.reading_order(adapters.made(spark, sf, adapters.TILTED))


_CANDIDATES = f"""WITH w AS (SELECT *, lead(text) OVER o AS t1, lead(text, 2) OVER o AS t2, lead(text, 3) OVER o AS t3, lead(top) OVER o = top AS r1, lead(top, 2) OVER o = top AS r2, lead(top, 3) OVER o = top AS r3 FROM ({sql.WORDS}) AS x WINDOW o AS (PARTITION BY page_id ORDER BY pos)),
    n AS (SELECT page_id, pos, {sql.label_norm('text')} AS n1, CASE WHEN r1 THEN {sql.label_norm("text || ' ' || t1")} END AS n2, CASE WHEN r1 AND r2 THEN {sql.label_norm("text || ' ' || t1 || ' ' || t2")} END AS n3, CASE WHEN r1 AND r2 AND r3 THEN {sql.label_norm("text || ' ' || t1 || ' ' || t2 || ' ' || t3")} END AS n4 FROM w)
    SELECT * FROM (SELECT page_id, pos, CASE {' '.join(f"WHEN n{k} IS NOT NULL AND {sql.label_phrase(f'n{k}')} AND {sql.pii_label(f'n{k}')} THEN {k}" for k in (4, 3, 2, 1))} END AS span FROM n) AS s WHERE span IS NOT NULL"""


@query(_CANDIDATES)
def label_candidates(spark, sf):
    return word_op.label_candidates(_words(spark, sf))


_SAME = lambda a, b: f"least({a}.top + {a}.height, {b}.top + {b}.height) - greatest({a}.top, {b}.top) > 0.3 * least({a}.height, {b}.height)"
_FIRST = lambda cond: f"min(CASE WHEN {cond} THEN pos END) OVER (PARTITION BY page_id, lab)"
#: Labels follow each other by ``nxt``; a label's value is what its first near word begins.
_LABEL_VALUES = f"""WITH RECURSIVE w AS MATERIALIZED ({sql.WORDS}), c AS MATERIALIZED ({_CANDIDATES}),
    n AS (SELECT a.page_id, a.pos, a.span, min(b.pos) AS nxt FROM c a LEFT JOIN c b ON a.page_id = b.page_id AND b.pos >= a.pos + a.span GROUP BY a.page_id, a.pos, a.span),
    l AS (SELECT page_id, pos, span, nxt FROM n WHERE pos = (SELECT min(pos) FROM c WHERE c.page_id = n.page_id) UNION ALL SELECT n.page_id, n.pos, n.span, n.nxt FROM l JOIN n ON n.page_id = l.page_id AND n.pos = l.nxt),
    p AS (SELECT w.*, l.pos AS lab, f.top AS lt, f.height AS lh, f."left" AS ll, f."left" + f.width AS edge, f.top + f.height AS foot, greatest(f.height, 1) AS tall, {_SAME('f', 'w')} AND w."left" >= f."left" + f.width AS beside,
        w.top >= f.top + f.height - 0.3 * greatest(f.height, 1) AND w.top - f.top - f.height <= 2.2 * greatest(f.height, 1) AS beneath
        FROM l JOIN w f ON f.page_id = l.page_id AND f.pos = l.pos JOIN w ON w.page_id = l.page_id AND w.pos >= l.pos + l.span),
    h AS (SELECT *, {_FIRST('beside AND "left" - edge <= 12.0 * tall')} AS hr, {_FIRST('beneath AND abs("left" - ll) <= 1.0 * tall')} AS hu FROM p),
    v AS (SELECT h.*, row_number() OVER (PARTITION BY h.page_id, lab ORDER BY h.pos) AS nth, bool_or(s.pos IS NOT NULL) OVER (PARTITION BY h.page_id, lab ORDER BY h.pos) AS ended
        FROM h JOIN w x ON x.page_id = h.page_id AND x.pos = coalesce(hr, hu) LEFT JOIN l s ON s.page_id = h.page_id AND s.pos = h.pos
        WHERE h."left" >= x."left" AND CASE WHEN hr IS NOT NULL THEN beside ELSE beneath AND {_SAME('x', 'h')} END)
    SELECT page_id, CAST(min("left") AS INTEGER) AS "left", CAST(min(top) AS INTEGER) AS top, CAST(max("left" + width) - min("left") AS INTEGER) AS width, CAST(max(top + height) - min(top) AS INTEGER) AS height FROM v WHERE nth <= 12 AND NOT ended GROUP BY page_id, lab"""


@query(_LABEL_VALUES)
def label_values(spark, sf):
    return word_op.label_values(_words(spark, sf))


_LOCATED = f"""SELECT page_id, item, "left", top, width, height FROM (SELECT w.page_id, l.label || ' ' || l.value_start AS item, w.top, CAST(min(w."left") AS INTEGER) AS "left", CAST(max(w."left" + w.width) - min(w."left") AS INTEGER) AS width, CAST(20 AS INTEGER) AS height
    FROM ({sql.WORDS}) AS w JOIN ({_LINES}) AS l ON l.doc_id = w.page_id WHERE list_has_any({sql.tokens('w.text')}, {sql.tokens('l.value')}) GROUP BY w.page_id, l.label, l.value_start, w.top) AS x"""


@query(_LOCATED)
def row_locate(spark, sf):
    """Where the words of each labelled value stand on its page, wherever that is, by row."""
    items = text_fn.labelled_lines(adapters.made(spark, sf, adapters.FORMS)).select(F.col("doc_id").alias("page_id"), F.concat_ws(" ", "label", "value_start").alias("item"), F.col("value").alias("text"))
    return word_op.locate(_words(spark, sf), items)


_DATED = sql.detect(f"SELECT page_id AS doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM ({sql.WORDS}) AS t GROUP BY page_id", named("date"))


@query(f"""WITH o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM ({sql.WORDS}) AS w),
    t AS (SELECT o.page_id, f.entity_type AS label, CAST(min("left") AS INTEGER) AS "left", CAST(min(top) AS INTEGER) AS top, CAST(max("left" + width) - min("left") AS INTEGER) AS width, CAST(max(top + height) - min(top) AS INTEGER) AS height
        FROM o JOIN ({_DATED}) AS f ON f.doc_id = o.page_id AND o.at < f.span_end AND f.span_start < o.at + length(o.text) GROUP BY o.page_id, f.entity_type, f.span_start, f.span_end),
    m AS ({_merge_sql('SELECT * FROM t', 3)}), u AS (SELECT *, 0 AS source FROM m UNION ALL SELECT page_id, 'labelled_value', "left", top, width, height, 1 FROM ({_LABEL_VALUES}) AS v)
    SELECT page_id, label, "left", top, width, height FROM (SELECT *, row_number() OVER (PARTITION BY page_id, "left", top, width, height ORDER BY source, label) AS n FROM u) AS x WHERE n = 1""")
def page_regions(spark, sf):
    """All that is covered on a page, from its words in two variants that were read alike."""
    words = _words(spark, sf).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    return page_op.regions(words, named("date"), dates=True)


@query("""WITH f AS (SELECT o_orderkey AS page_id, unnest([0, 1]) AS line, unnest(['Order key', NULL]) AS label, unnest([CAST(o_orderkey AS VARCHAR), o_orderpriority]) AS value FROM orders),
    p AS (SELECT page_id, line, 0 AS col, unnest(string_split(label || ':', ' ')) AS text, generate_subscripts(string_split(label || ':', ' '), 1) AS nth, 60 AS x FROM f WHERE label IS NOT NULL
        UNION ALL SELECT page_id, line, 1, unnest(string_split(value, ' ')), generate_subscripts(string_split(value, ' '), 1), 320 FROM f)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, col, nth) - 1 AS INTEGER) AS pos, text, CAST(x + 10 * coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id, line, col ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "left",
        CAST(170 + line * 42 AS INTEGER) AS top, CAST(length(text) * 10 AS INTEGER) AS width, CAST(24 AS INTEGER) AS height FROM p WHERE text <> ''""")
def synthetic_pages(spark, sf):
    lines = F.array(F.struct(F.lit(0).alias("line"), F.lit("Order key").alias("label"), F.col("o_orderkey").cast("string").alias("value")), F.struct(F.lit(1).alias("line"), F.lit(None).cast("string").alias("label"), F.col("o_orderpriority").alias("value")))
    fields = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.explode(lines).alias("f")).select("page_id", "f.*")
    return word_op.form_words(fields)


@query(f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, nth) - 1 AS INTEGER) AS pos, text, CAST(0 AS INTEGER) AS "left", CAST(line * 30 AS INTEGER) AS top, CAST(400 AS INTEGER) AS width, CAST(20 AS INTEGER) AS height FROM (
    SELECT page_id, line, unnest(string_split(body, ' ')) AS text, generate_subscripts(string_split(body, ' '), 1) AS nth FROM (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM ({sql.FORMS}) AS f) AS l) AS w WHERE text <> ''""")
def line_words(spark, sf):
    """Words of whole lines, as a recognizer of lines gives them, each with its line's box, from the line's corners."""
    lines = adapters.made(spark, sf, adapters.FORMS).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), (F.col("line") * 30 + y).alias("y"))
    lines = lines.withColumn("box", word_op.polygon_box(F.array(corner(400, 0), corner(0, 0), corner(400, 20), corner(0, 20))))
    return word_op.explode_lines(lines.select("page_id", "line", "text", "box.*"))


# --- visual and elements ----------------------------------------------------------------------------------------------

_PR = "CAST(sum(least(detected, proposed)) AS BIGINT) AS tp, CAST(sum(greatest(0, detected - proposed)) AS BIGINT) AS fp, CAST(sum(greatest(0, proposed - detected)) AS BIGINT) AS fn"


@query(f"SELECT kind, tp, fp, fn, round(tp * 1.0 / nullif(tp + fp, 0), 6) AS precision, round(tp * 1.0 / nullif(tp + fn, 0), 6) AS recall FROM (SELECT kind, {_PR} FROM ({adapters.VISUAL}) AS v GROUP BY kind) AS x")
def visual_pr(spark, sf):
    return measure.visual_scores(adapters.made(spark, sf, adapters.VISUAL))


@query(f"SELECT kind, CAST(sum(proposed) AS BIGINT) AS annotated, CAST(sum(surviving) AS BIGINT) AS surviving, CAST(sum(greatest(0, surviving - proposed)) AS BIGINT) AS unexpected FROM ({adapters.VISUAL}) AS v GROUP BY kind")
def visual_survival(spark, sf):
    return measure.visual_survival(adapters.made(spark, sf, adapters.VISUAL))


_STATES = f"SELECT x.image, x.element, x.state AS state_before, y.state AS state_after FROM ({adapters.READ_BEFORE}) AS x LEFT JOIN ({adapters.READ_AFTER}) AS y ON x.image = y.image AND x.element = y.element"


@query(_STATES)
def element_states(spark, sf):
    return measure.element_states(adapters.made(spark, sf, adapters.READ_BEFORE), adapters.made(spark, sf, adapters.READ_AFTER))


@query(f"SELECT element, count_if(state_after IS DISTINCT FROM 'readable') AS covered, count_if(state_after = 'readable') AS leaked FROM ({_STATES}) AS e WHERE state_before = 'readable' GROUP BY element")
def element_legibility(spark, sf):
    return measure.element_tally(element_states(spark, sf))


_COUNTED = "SELECT 'c' AS corpus, {0} AS image, {1} AS kind, CAST({2} AS BIGINT) AS n FROM {3}"
_PROPOSED = _COUNTED.format("o_custkey", "lower(o_orderstatus)", "o_orderkey % 4", "orders")
_CURRENT = _COUNTED.format("c_custkey", "CASE WHEN c_acctbal < 0 THEN 'f' ELSE 'o' END", "c_nationkey % 3", "customer")
_DETECTED = _COUNTED.format("l_suppkey", "lower(l_linestatus)", "l_linenumber % 3", "lineitem")


@query(f"""SELECT corpus, image, kind, CAST(coalesce(sum(p), 0) AS BIGINT) AS proposed, CAST(coalesce(sum(c), 0) AS BIGINT) AS current, CAST(coalesce(sum(d), 0) AS BIGINT) AS detected FROM (
    SELECT corpus, image, kind, n AS p, 0 AS c, 0 AS d FROM ({_PROPOSED}) AS x UNION ALL SELECT corpus, image, kind, 0, n, 0 FROM ({_CURRENT}) AS y UNION ALL SELECT corpus, image, kind, 0, 0, n FROM ({_DETECTED}) AS z) AS u GROUP BY corpus, image, kind""")
def visual_counts(spark, sf):
    return measure.visual_counts(*(adapters.made(spark, sf, x) for x in (_PROPOSED, _CURRENT, _DETECTED)))


_TRUTH_ITEMS = "SELECT CAST(l_orderkey AS STRING) AS image, l_returnflag AS field, CAST(l_partkey AS STRING) AS text, CASE WHEN l_linestatus = 'O' THEN 'PERSON' END AS expected_type, CASE WHEN l_linenumber = 1 THEN 'sensitive' END AS tier FROM lineitem"
_TOLD = "SELECT CAST(l_orderkey AS STRING) AS image, CAST(l_partkey AS STRING) AS text, min(CASE WHEN l_suppkey % 3 = 0 THEN 'leaked' ELSE 'redacted' END) AS verdict FROM lineitem GROUP BY 1, 2"
_SHOTS = "SELECT CAST(o_orderkey AS STRING) AS image FROM orders", "SELECT CAST(p_partkey AS STRING) AS image FROM part"


@query(f"""SELECT image, shot, total, leak.field AS field, leak.text AS text, leak.expected_type AS expected_type, leak.tier AS tier FROM (
    SELECT i.image, CASE WHEN bool_or(s.image IS NOT NULL) THEN 'scored/' || i.image WHEN bool_or(p.image IS NOT NULL) THEN 'images/' || i.image END AS shot, count(*) AS total,
        unnest(list({{'field': field, 'text': i.text, 'expected_type': expected_type, 'tier': coalesce(tier, 'core')}}) FILTER (verdict = 'leaked')) AS leak
    FROM ({_TRUTH_ITEMS}) AS i LEFT JOIN ({_TOLD}) AS v ON v.image = i.image AND v.text = i.text LEFT JOIN ({_SHOTS[1]}) AS s ON s.image = i.image LEFT JOIN ({_SHOTS[0]}) AS p ON p.image = i.image GROUP BY i.image) AS f""")
def failures(spark, sf):
    made = lambda x: adapters.made(spark, sf, x)
    pages = measure.failures(made(_TRUTH_ITEMS), made(_TOLD), made(_SHOTS[1]), made(_SHOTS[0]))
    return pages.select("image", "shot", "total", F.explode("leaks").alias("leak")).select("image", "shot", "total", "leak.*")


@query(f"""SELECT o_orderkey AS page_id, coalesce(n, 0) AS entity_count, avg_confidence FROM orders LEFT JOIN (SELECT page_id, count(*) AS n, round(avg(width / 128.0), 3) AS avg_confidence FROM ({sql.BOXES}) AS b GROUP BY page_id) AS f ON f.page_id = o_orderkey""")
def mean_confidence(spark, sf):
    found = adapters.made(spark, sf, adapters.BOXES).select("page_id", (F.col("width") / 128.0).alias("score"))
    return measure.mean_confidence(found, adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id")))


_COVERAGE = "SELECT l_returnflag AS field, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_quantity >= 40 THEN CAST(1.0 AS DOUBLE) ELSE l_quantity / 64.0 END AS coverage FROM lineitem"


@query(f"SELECT field, count(*) AS regions, round(avg(coverage), 6) AS mean, count_if(coverage >= 0.99) AS whole FROM ({_COVERAGE}) AS c WHERE coverage IS NOT NULL GROUP BY ROLLUP (field)")
def coverage_summary(spark, sf):
    return measure.coverage_summary(adapters.made(spark, sf, _COVERAGE))


_CORPUS_ITEMS = "SELECT c_mktsegment AS corpus, CASE WHEN c_nationkey % 3 = 0 THEN 'leaked' WHEN c_nationkey % 3 = 1 THEN 'redacted' ELSE 'unverifiable' END AS verdict FROM customer"
_CORPUS_STATES = "SELECT CASE WHEN o_orderstatus = 'F' THEN 'BUILDING' ELSE o_orderstatus END AS corpus, CASE WHEN o_custkey % 2 = 0 THEN 'readable' ELSE 'absent' END AS state_before, CASE WHEN o_orderkey % 3 = 0 THEN 'readable' END AS state_after FROM orders"


@query(f"""WITH i AS (SELECT corpus, 'items' AS unit, count_if(verdict = 'redacted') AS redacted, count_if(verdict = 'leaked') AS leaked, count_if(verdict = 'unverifiable') AS unverifiable FROM ({_CORPUS_ITEMS}) AS x GROUP BY corpus),
    e AS (SELECT corpus, 'elements', count_if(state_after IS DISTINCT FROM 'readable'), count_if(state_after = 'readable'), CAST(0 AS BIGINT) FROM ({_CORPUS_STATES}) AS y WHERE state_before = 'readable' AND corpus NOT IN (SELECT corpus FROM i) GROUP BY corpus)
    SELECT *, round(redacted * 100.0 / (redacted + leaked + unverifiable), 4) AS pct FROM (SELECT * FROM i UNION ALL SELECT * FROM e) AS u""")
def panel_totals(spark, sf):
    return measure.panel_totals(adapters.made(spark, sf, _CORPUS_ITEMS), adapters.made(spark, sf, _CORPUS_STATES))


@query(f"SELECT expected_type, {_C} FROM (SELECT coalesce(expected_type, '(no recognizer)') AS expected_type, verdict FROM ({_verdict_sql(False)}) AS x) AS v GROUP BY expected_type")
def leakage_by_type(spark, sf):
    """Types with the most leaked or unverifiable items first."""
    v = _verdicts(spark, sf).groupBy(F.coalesce("expected_type", F.lit(measure.NO_RECOGNIZER)).alias("expected_type")).agg(*measure.counts(), F.count("*").alias("total"))
    return measure.by_leakage(v, "expected_type")


_MEANINGS = "SELECT * FROM (VALUES ('Customer Name', 'PERSON', 'core'), ('Account No.', NULL, 'core'), ('Mobile Number', 'PHONE_NUMBER', 'core'), ('Amount', NULL, 'sensitive'), ('Branch Address', 'LOCATION', 'core')) AS t(label, expected_type, tier)"
_SKIPPED = "SELECT * FROM (VALUES ('Branch Address'), ('Date')) AS t(label)"
_BUILT = f"SELECT l.doc_id AS page_id, l.label AS field, trim(l.value) AS text, m.expected_type, m.tier FROM ({_LINES}) AS l JOIN ({_MEANINGS}) AS m ON m.label = l.label WHERE l.label NOT IN (SELECT label FROM ({_SKIPPED}) AS s) AND trim(l.label) <> '' AND trim(l.value) <> ''"


@query(_BUILT)
def truth_build(spark, sf):
    fields = text_fn.labelled_lines(adapters.made(spark, sf, adapters.FORMS)).select(F.col("doc_id").alias("page_id"), "label", "value")
    return measure.truth_of_fields(fields, spark.sql(_MEANINGS), spark.sql(_SKIPPED))


@query(f"SELECT tier, count(*) AS items, count_if(expected_type IS NULL) AS unsupported FROM ({_BUILT}) AS t GROUP BY ROLLUP (tier)")
def truth_by_tier(spark, sf):
    return measure.inventory(truth_build(spark, sf))


_FIELDS_OF = "struct(CAST(k AS INT) AS xmin, CAST(k % 7 AS INT) AS ymin, CAST(k + 9 AS INT) AS xmax, CAST(k % 7 + 3 AS INT) AS ymax)"


@query(f"""SELECT filename, unnest(list_filter([{{'field': 'name', 'expected_type': 'PERSON', 'box': CASE WHEN k % 3 > 0 THEN [CAST(k AS INTEGER), CAST(k % 7 AS INTEGER), CAST(k + 9 AS INTEGER), CAST(k % 7 + 3 AS INTEGER)] END}},
    {{'field': 'acno', 'expected_type': NULL, 'box': [CAST(v AS INTEGER), 1, CAST(v + 5 AS INTEGER), 2]}}], lambda x: x.box IS NOT NULL), recursive := true) FROM ({adapters.FIELD_BOXES}) AS f""")
def corpus_build(spark, sf):
    """Boxes of personal fields of a table of checks as annotations; a field that isn't personal stays out."""
    rows = adapters.made(spark, sf, adapters.FIELD_BOXES)
    rows = rows.select("filename", F.when(F.col("k") % 3 > 0, F.expr(_FIELDS_OF)).alias("name"), F.expr("struct(CAST(v AS INT) AS xmin, 1 AS ymin, CAST(v + 5 AS INT) AS xmax, 2 AS ymax)").alias("acno"), F.expr(_FIELDS_OF).alias("date"))
    pages = files.fields_to_corpus(rows, {"name": ("PERSON", "core"), "acno": (None, "core")})
    return pages.select("filename", F.explode("pii").alias("i")).select("filename", "i.field", "i.expected_type", "i.box")


# --- replies, documentation, pixels -----------------------------------------------------------------------------------

_REPLIES = """SELECT p_partkey AS page_id, CAST(500 AS INT) AS page_w, CAST(700 AS INT) AS page_h, CASE WHEN p_partkey % 5 = 0 THEN 'I see nothing' ELSE
    CASE WHEN p_partkey % 5 = 1 THEN '```json' || chr(10) ELSE 'Here: ' END || '{"items": [{"text": "x", "kind": "' || CASE WHEN p_partkey % 2 = 0 THEN 'Name' ELSE 'hat' END || '", "box": [' ||
    CAST(p_partkey * 7 % 300 AS STRING) || ', ' || CAST(p_partkey * 11 % 400 AS STRING) || ', ' || CAST(p_size * 6 AS STRING) || ', ' || CAST(CASE WHEN p_partkey % 3 = 0 THEN 900 ELSE p_size * 5 END AS STRING) || ']}]}' ||
    CASE WHEN p_partkey % 5 = 1 THEN chr(10) || '```' ELSE '' END END AS content FROM part"""


@query(f"""WITH r AS (SELECT page_id, page_w, page_h, regexp_extract(content, '(?s)\\{{.*\\}}') AS body FROM ({_REPLIES}) AS x),
    b AS (SELECT page_id, page_w, page_h, json_extract_string(body, '$.items[0].kind') AS kind, list_transform([0, 1, 2, 3], lambda k: CAST(json_extract(body, '$.items[0].box[' || k || ']') AS DOUBLE)) AS v FROM r WHERE body <> ''),
    s AS (SELECT *, CASE WHEN list_max(v) <= 2 THEN 1.0 WHEN list_max(v) > 700 THEN 1000.0 END AS f FROM b),
    p AS (SELECT page_id, page_w, page_h, kind, list_transform(v, lambda x, i: CASE WHEN f IS NULL THEN x ELSE x / f * CASE WHEN i % 2 = 1 THEN page_w ELSE page_h END END) AS v FROM s),
    c AS (SELECT page_id, page_w, page_h, kind, CAST(trunc(least(v[1], v[3])) AS INT) AS x, CAST(trunc(least(v[2], v[4])) AS INT) AS y, CAST(trunc(abs(v[3] - v[1])) AS INT) AS w, CAST(trunc(abs(v[4] - v[2])) AS INT) AS h FROM p)
    SELECT page_id, CASE lower(kind) WHEN 'name' THEN 'vlm_name' ELSE 'vlm_other' END AS label, least(x, page_w) AS "left", least(y, page_h) AS top, least(w, page_w - least(x, page_w)) AS width, least(h, page_h - least(y, page_h)) AS height, CAST(NULL AS VARCHAR) AS error
    FROM c WHERE least(w, page_w - least(x, page_w)) > 0 AND least(h, page_h - least(y, page_h)) > 0
    UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, 'no JSON in reply' FROM r WHERE body = ''""")
def vlm_reply_parse(spark, sf):
    return parse_replies(adapters.made(spark, sf, _REPLIES))


_TOLD_REPLIES = """SELECT CAST(p_partkey AS STRING) AS image, CASE WHEN p_partkey % 6 = 0 THEN 'I refuse' ELSE '{"verdicts": [{"value": "' || p_brand || '", "verdict": "' || CASE WHEN p_size < 20 THEN 'leaked' WHEN p_size < 40 THEN 'redacted' ELSE 'unsure' END ||
    '", "note": ""}, {"value": "made up", "verdict": "leaked", "note": ""}], "face": ' || CAST(p_size % 3 AS STRING) || ', "qr_code": 1}' END AS content, p_brand AS value FROM part"""


@query(f"SELECT image, value, CASE WHEN contains(content, '\"leaked\", \"note\": \"\"}}, ') THEN 'leaked' ELSE 'redacted' END AS verdict FROM ({_TOLD_REPLIES}) AS r WHERE content <> 'I refuse' AND NOT contains(content, 'unsure')")
def vision_verdicts(spark, sf):
    r = adapters.made(spark, sf, _TOLD_REPLIES)
    return replies.parse_verdicts(r, r.select("image", "value"))


@query(f"""SELECT image, kind, n, CAST(NULL AS VARCHAR) AS error FROM (SELECT image, unnest(['face', 'qr_code', 'barcode']) AS kind, unnest([CAST(regexp_extract(content, '"face": (\d)', 1) AS BIGINT), 1, 0]) AS n FROM ({_TOLD_REPLIES}) AS r WHERE content <> 'I refuse') AS x
    UNION ALL SELECT image, NULL, NULL, 'no JSON in reply' FROM ({_TOLD_REPLIES}) AS s WHERE content = 'I refuse'""")
def vision_counts(spark, sf):
    return replies.parse_visual(adapters.made(spark, sf, _TOLD_REPLIES))


_MISC = """SELECT p_partkey AS id, p_name || CASE WHEN p_size % 4 = 0 THEN '.JPG' WHEN p_size % 4 = 1 THEN '.webp' WHEN p_size % 4 = 2 THEN '.gif' ELSE '' END AS path, '  The ' || p_name || ' (' || p_brand || ')! ' AS heading,
    CASE WHEN p_size % 3 = 0 THEN 'true' WHEN p_size % 3 = 1 THEN 'false' ELSE p_type END AS setting, CASE WHEN p_size % 5 = 0 THEN 'lost' END AS error, p_size % 2 AS entities FROM part"""


@query(f"""SELECT id, CASE WHEN path LIKE '%.JPG' THEN 'image/jpeg' WHEN path LIKE '%.webp' THEN 'image/webp' WHEN path LIKE '%.gif' THEN 'image/gif' ELSE 'image/png' END AS media, replace(regexp_replace(trim(lower(heading)), '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), ' ', '-') AS anchor,
    CASE setting WHEN 'true' THEN 'on' WHEN 'false' THEN 'off' ELSE setting END AS shown, CASE WHEN error IS NOT NULL THEN 'failed' WHEN entities > 0 THEN 'processed' ELSE 'no_pii_found' END AS status FROM ({_MISC}) AS m""")
def names_and_settings(spark, sf):
    m = adapters.made(spark, sf, _MISC)
    return m.select("id", text_fn.media_type(F.col("path")).alias("media"), text_fn.anchor(F.col("heading")).alias("anchor"), text_fn.config_value(F.col("setting")).alias("shown"), files.status(F.col("entities"), F.col("error")).alias("status"))


_PAGES = "SELECT p_partkey AS file, p_name || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'It was removed and is no longer here' WHEN p_partkey % 3 = 1 THEN '> it was removed' ELSE 'Built in 2021, originally' END || chr(10) || '```' || chr(10) || 'used to' || chr(10) || '```' AS text FROM part"


@query(f"""WITH l AS (SELECT file, unnest(string_split(regexp_replace(text, '(?s)```.*?```', '', 'g'), chr(10))) AS body, generate_subscripts(string_split(regexp_replace(text, '(?s)```.*?```', '', 'g'), chr(10)), 1) AS line FROM ({_PAGES}) AS p)
    SELECT file, CAST(line AS INTEGER) AS line, phrase FROM (SELECT file, line, unnest([{', '.join(f"regexp_extract(body, {sql.quoted('(?i)(' + p + ')')}, 1)" for p in lint.PAST)}]) AS phrase FROM l WHERE NOT starts_with(ltrim(body), '>')) AS x WHERE phrase <> ''""")
def docs_lint(spark, sf):
    return lint.tense(adapters.made(spark, sf, _PAGES))


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, 'all' AS field, ceil(p_size * 3 / 3.0) / 64 AS coverage FROM part")
def coverage_pixels(spark, sf):
    part = adapters.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") * 3).alias("n"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"))
    before = part.withColumn("data", F.encode(F.repeat(F.lit("A"), F.lit(192)), "UTF-8"))
    after = part.withColumn("data", F.encode(F.concat(F.expr("repeat('z', n)"), F.expr("repeat('A', 192 - n)")), "UTF-8"))
    boxes = part.select("name", F.lit("all").alias("field"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(8).alias("x1"), F.lit(8).alias("y1"))
    return pixels.coverage(before, after, boxes)


_DOCS = "SELECT CAST(p_partkey AS STRING) AS file, '# The ' || p_brand || ' one' || chr(10) || '[x](#the-' || lower(p_brand) || '-one) [y](#' || p_type || ') see ' || p_name || '.py' AS text FROM part"


@query(f"SELECT file, anchor FROM (SELECT file, unnest(regexp_extract_all(text, '\\[[^\\]]+\\]\\(#([^)]+)\\)', 1)) AS anchor, replace(regexp_replace(lower(regexp_extract(text, '^# (.*)\\n', 1)), '[^a-z0-9 _-]', '', 'g'), ' ', '-') AS head FROM ({_DOCS}) AS d) AS x WHERE anchor <> head")
def docs_anchors(spark, sf):
    return lint.broken_anchors(adapters.made(spark, sf, _DOCS))


@query(f"SELECT script FROM (SELECT n_name || '.py' AS script FROM nation UNION ALL SELECT DISTINCT regexp_extract(p_name, '[\\w./-]*\\w$') || '.py' FROM part) AS s WHERE script NOT IN (SELECT unnest(regexp_extract_all(text, '[\\w./-]*\\w')) FROM ({_DOCS}) AS d)")
def docs_undocumented(spark, sf):
    nation = adapters.table(spark, sf, "nation").select(F.concat("n_name", F.lit(".py")).alias("script"))
    part = adapters.table(spark, sf, "part").select(F.concat(F.regexp_extract("p_name", r"[\w./-]*\w$", 0), F.lit(".py")).alias("script")).distinct()
    return lint.undocumented(nation.unionByName(part), adapters.made(spark, sf, _DOCS))
