"""Inputs made of the driver's tables: ids in sentences, forms, words, boxes, items, verdicts, runs.

Each is one SELECT whose expressions mean the same in Spark SQL and in the SQL that the results are held against.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

# Digits of a row, spread over 16 places; letters are digits in disguise.
_KEYED = "SELECT l_orderkey * 7 + l_linenumber AS k, lpad(CAST(((l_orderkey * 7 + l_linenumber) % 100000000) * 829321873 % 10000000000000000 AS STRING), 16, '0') AS d FROM lineitem"
_L = "translate(substr(d, {0}, {1}), '0123456789', 'ABCDEFGHIJ')"
_FORMS = (
    f"'bank branch ifsc ' || {_L.format(1, 4)} || '0' || substr(d, 5, 6)",
    f"'code ' || {_L.format(1, 4)} || '0' || substr(d, 5, 6) || '.'",
    "'driving licence KA05 2023' || substr(d, 1, 7)",
    "'KL-2009-' || substr(d, 1, 6) || ' issued'",
    "'abha ' || substr(d, 1, 2) || '-' || substr(d, 3, 4) || '-' || substr(d, 7, 4) || '-' || substr(d, 11, 4)",
    "'health id ' || substr(d, 1, 14) || ' and ' || substr(d, 2, 2) || ' ' || substr(d, 3, 4) || ' ' || substr(d, 7, 4) || ' ' || substr(d, 11, 4)",
    "'virtual id ' || substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' ' || substr(d, 9, 4) || ' ' || substr(d, 13, 4) || ' or ' || d",
    "'aadhaar XXXX XXXX ' || substr(d, 1, 4) || ' and ****-****-' || substr(d, 5, 4)",
    f"'phr ' || lower({_L.format(1, 5)}) || '@abdm, ' || lower({_L.format(6, 6)}) || '@sbx'",
    f"'paid to ' || lower({_L.format(1, 6)}) || '@ybl and ' || lower({_L.format(7, 6)}) || '@acme'",
    f"'write to ' || lower({_L.format(1, 6)}) || '@mail.example.com now'",
    f"'vehicle KA ' || substr(d, 1, 2) || ' ' || {_L.format(3, 2)} || ' ' || substr(d, 5, 4) || ', 21 BH ' || substr(d, 9, 4) || ' AB'",
    "'uid ' || substr(d, 1, 4) || '-' || substr(d, 5, 4) || ':' || substr(d, 9, 4) || ' or ' || substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' ' || substr(d, 9, 4)",
    "'number ' || substr(d, 1, 12)",
    f"'pan ' || {_L.format(1, 3)} || 'P' || {_L.format(4, 1)} || substr(d, 5, 4) || 'F gstin 27' || {_L.format(1, 5)} || substr(d, 5, 4) || 'F1Z5'",
    f"'voter ' || {_L.format(1, 3)} || substr(d, 4, 7) || ' passport J' || '8' || substr(d, 4, 5) || '7 on 2024-01-' || '1' || substr(d, 1, 1)",
)
SYNTH_IDS = "SELECT k AS doc_id, CASE " + " ".join(f"WHEN k % {len(_FORMS)} = {i} THEN {x}" for i, x in enumerate(_FORMS)) + f" END AS text FROM ({_KEYED}) AS keyed"

# Forms: a label and a value on each line; some labels are personal, some are an institution's.
_LINES = (
    "'Customer Name: ' || c_name",
    "'Account No.: ' || CAST(c_custkey * 7919 AS STRING)",
    "'Bank Name: Bank of ' || c_mktsegment",
    "CASE WHEN c_custkey % 3 = 0 THEN 'A/C No: ' || CAST(c_custkey * 31 AS STRING) ELSE 'Date: 2024-01-01' END",
    "CASE WHEN c_custkey % 4 = 0 THEN 'Branch Address: ' || c_mktsegment ELSE 'Mobile Number: 98' || lpad(CAST(c_custkey % 100000000 AS STRING), 8, '0') END",
    "CASE WHEN c_custkey % 5 = 0 THEN 'Amount: ' || CAST(c_custkey AS STRING) ELSE 'customer_name: ' || c_name END",
)
FORMS = "SELECT c_custkey AS doc_id, " + " || chr(10) || ".join(_LINES) + " AS text FROM customer"

BOXES = """SELECT l_orderkey AS page_id, CAST(l_linenumber AS INT) AS pos, CAST(l_partkey % 3 AS INT) AS variant,
    CASE WHEN l_partkey % 4 = 0 THEN 'PERSON' WHEN l_partkey % 4 = 1 THEN 'LOCATION' WHEN l_partkey % 4 = 2 THEN 'IN_PAN' ELSE 'face' END AS label,
    CAST(l_partkey * 37 % 300 AS INT) AS "left", CAST(l_suppkey * 53 % 200 AS INT) AS top,
    CAST(20 + l_partkey % 100 AS INT) AS width, CAST(10 + l_suppkey % 30 AS INT) AS height FROM lineitem"""
REGIONS = """SELECT o_orderkey AS page_id, CAST(o_custkey * 17 % 250 AS INT) AS "left", CAST(o_custkey * 29 % 150 AS INT) AS top,
    CAST(40 + o_custkey % 120 AS INT) AS width, CAST(20 + o_custkey % 60 AS INT) AS height FROM orders"""
VISUAL = """SELECT p_partkey AS image, CASE WHEN p_partkey % 3 = 0 THEN 'face' WHEN p_partkey % 3 = 1 THEN 'qr_code' ELSE 'barcode' END AS kind,
    CAST(p_size % 4 AS BIGINT) AS proposed, CAST(p_partkey % 5 AS BIGINT) AS detected, CAST(p_partkey % 2 AS BIGINT) AS surviving FROM part"""
# Two runs' verdicts on customers, each row a value on a page.
RUN_A = "SELECT c_custkey % 50 AS image, CAST(c_custkey AS STRING) AS value, CASE WHEN c_acctbal < 1000 THEN 'leaked' WHEN c_acctbal < 6000 THEN 'redacted' ELSE 'unverifiable' END AS verdict FROM customer"
RUN_B = "SELECT o_custkey % 50 AS image, CAST(o_custkey AS STRING) AS value, CASE WHEN min(o_totalprice) < 20000 THEN 'leaked' ELSE 'redacted' END AS verdict FROM orders GROUP BY o_custkey"
HISTORY = """SELECT event_type AS corpus, CAST(ts AS DATE) AS day, count(*) AS items, CAST(count(*) % 3 AS BIGINT) AS image_count,
    round(CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*), 1) AS recall_floor_pct,
    substr(CAST(min(user_id) AS STRING), 1, 1) AS sha FROM events GROUP BY event_type, CAST(ts AS DATE)"""
# What of an order could be read before and after; not every element was looked for again.
READ_BEFORE = """SELECT l_orderkey AS image, CASE WHEN l_returnflag = 'N' THEN 'date' WHEN l_returnflag = 'A' THEN 'amount' ELSE 'payee' END AS element,
    min(CASE WHEN l_partkey % 3 = 0 THEN 'absent' WHEN l_partkey % 3 = 1 THEN 'readable' ELSE 'unread' END) AS state FROM lineitem GROUP BY 1, 2"""
READ_AFTER = """SELECT l_orderkey AS image, CASE WHEN l_linestatus = 'O' THEN 'date' ELSE 'amount' END AS element,
    min(CASE WHEN l_suppkey % 2 = 1 THEN 'readable' ELSE 'covered' END) AS state FROM lineitem GROUP BY 1, 2"""
# Words of orders on tilted lines: rows drift, and words of different heights stand between them.
TILTED = """SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS pos, CASE WHEN l_linenumber % 5 = 4 THEN ' ' ELSE 'w' || CAST(l_partkey AS STRING) END AS text,
    CAST(l_partkey * 37 % 300 AS INT) AS "left", CAST(l_suppkey * 53 % 60 + floor(l_partkey * 37 % 300 / 10) AS INT) AS top, CAST(20 + l_partkey % 100 AS INT) AS width, CAST(8 + l_suppkey % 24 AS INT) AS height FROM lineitem"""
# Cue words for signatures and the sizes of their pages.
CUES = """SELECT l_orderkey AS page_id, CASE WHEN l_partkey % 3 = 0 THEN 'Signature:' WHEN l_partkey % 3 = 1 THEN ' (Signed' ELSE 'signed,.' END AS text, CAST(l_partkey * 37 % 300 AS INT) AS "left", CAST(l_suppkey * 53 % 200 AS INT) AS top,
    CAST(20 + l_partkey % 100 AS INT) AS width, CAST(1 + l_suppkey % 30 AS INT) AS height, CAST(200 + l_orderkey % 300 AS INT) AS page_w, CAST(300 + l_orderkey % 200 AS INT) AS page_h FROM lineitem"""
FIELD_BOXES = """SELECT CAST(o_orderkey AS STRING) || '.png' AS filename, o_custkey AS k, o_orderkey AS v FROM orders"""


#: A table from this size on is worth spreading.
SPREAD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table that is scanned in fewer tasks than there are cores, as one of a single row group is, dealt to all of them.

    A large table has as many splits as cores at least and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    large = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= SPREAD_BYTES
    return df.repartition(cores) if large and df.rdd.getNumPartitions() < cores else df


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the SELECTs above over the tables in ``sf_dir``."""
    tables = [t for t in ("lineitem", "customer", "orders", "part", "supplier", "nation", "documents", "labels", "events") if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    return spark.sql(_bound(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def _bound(sql: str, tables: list[str]) -> str:
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql.replace('"left"', "`left`")


def words(forms: DataFrame) -> DataFrame:
    """The words of a text as boxes on a page: ten pixels a character, thirty a line."""
    lines = forms.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    each = lines.select("page_id", "line", F.posexplode(F.split("body", " ")).alias("at", "text"))
    before = Window.partitionBy("page_id", "line").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("page_id").orderBy("line", "at")
    placed = each.withColumn("left", (F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)) * 10).cast("int"))
    return placed.select("page_id", (F.row_number().over(order) - 1).alias("pos"), "text", "left", (F.col("line") * 30).alias("top"), (F.length("text") * 10).alias("width"), F.lit(20).alias("height"))


WORDS = f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, nth) - 1 AS INT) AS pos, text,
    CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id, line ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10 AS INT) AS "left",
    CAST(line * 30 AS INT) AS top, CAST(length(text) * 10 AS INT) AS width, CAST(20 AS INT) AS height
    FROM (SELECT page_id, line, unnest(string_split(body, ' ')) AS text, generate_subscripts(string_split(body, ' '), 1) - 1 AS nth
          FROM (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM ({FORMS}) AS f) AS l) AS w"""
