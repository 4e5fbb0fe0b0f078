"""WARC archives and their index, merged from sorted runs.

Records are written as text whose line separator is the record separator of WARC, so Spark's own committed writer makes
valid archives. A payload of at least ``LEAST`` bytes is kept once, by the record of the largest page_id; others of the
same payload are revisit records that refer to it. Archives are read as bytes and parsed by their content lengths.

Index: what is parsed from an archive is one run, sorted by URL key and time in its task. Runs are dealt by ranges of
(URL key, time, page_id), and each range merges its parts of the runs by a loser tree, which needs one comparison for
each level and row, into one ordered capture history.

Nulls: a null html is an empty payload; a null url has the key ``''``; a null page_id comes before all others, so it is
a revisit where a copy has an id. Rows of the same page_id and payload all have the largest page_id and are all response.
An empty table gives no archive and an empty result. Any page_id is taken, however large. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_path, prepare, written

#: Shorter payloads are written each time.
LEAST = 1000
#: Most records of one archive, and bytes that it has at most unless one record has more.
RECORDS, ARCHIVE_BYTES = 10_000, 1 << 28
#: Index rows of one range, which a task holds while it merges them.
RANGE_ROWS = 200_000
END = "\r\n\r\n"
#: Most payloads with copies that are broadcast; more of them are joined by a shuffle.
BROADCAST = 100_000


# --- writing ----------------------------------------------------------------------------------------------------------


def records(pages: DataFrame) -> DataFrame:
    """page_id, url and the text of each record, natively."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    told = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(raw).alias("digest"), F.length(raw).cast("long").alias("bytes"))
    # Short payloads have keys of their own, spread at random.
    key = F.when(F.col("bytes") >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    # Copies are counted before they are moved: one row per payload and task goes to the payload's first record.
    first = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("same"), F.length(F.encode("html", "UTF-8")).alias("n"))
    first = first.where(F.col("n") >= LEAST).groupBy("same").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = written(first, "kept-payloads")
    told = told.join(F.broadcast(first) if first.count() <= BROADCAST else first, key == first["same"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    date = F.date_format(F.timestamp_seconds(F.lit(BASE_SECONDS) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(MOST_SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        line("WARC-Date", date),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit("")).otherwise(line("Content-Type", F.lit("text/html; charset=UTF-8"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("kept").cast("string"), F.lit(">"))), line("X-Payload-Length", F.col("bytes").cast("string")))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return told.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


#: Pages have no time of capture; page_id seconds after this date stands in for it.
BASE_SECONDS = 1_704_067_200
#: Ids from here on, and those below zero, stand for the seconds that remain when divided by it, so that any id gives a date of four-digit years.
MOST_SECONDS = 1 << 37


def write(pages: DataFrame, path: str) -> None:
    """Archives under ``path``, none of more bytes than can be read at once: the largest payload says how many records fit."""
    prepare(pages.sparkSession)
    largest = pages.agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0))).first()[0]
    fit = max(1, min(RECORDS, ARCHIVE_BYTES // (largest + 4096)))
    records(pages).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", fit).text(path)


# --- reading ----------------------------------------------------------------------------------------------------------

_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")
_PAGE = re.compile(r"<urn:page:(-?\d+|null)>")


def parse(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and payload of each record of a gzipped archive; the archive is unpacked as it is read."""
    unpack, buffer, base, at = zlib.decompressobj(31), bytearray(), 0, 0

    def more(upto: int) -> bool:
        nonlocal at
        while len(buffer) < upto:
            if unpack.eof or at >= len(raw):
                return False
            buffer.extend(unpack.decompress(raw[at : at + (1 << 18)]))
            at += 1 << 18
        return True

    while more(1):
        size = 4096
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more(size):
            size *= 2
        if end < 0 or not buffer.startswith(b"WARC/1."):
            raise ValueError(f"no WARC header at {base}")
        head = {k.decode(): v.decode() for k, v in _HEADER.findall(bytes(buffer[: end + 2]))}
        start, n = end + 4, int(head["Content-Length"])
        if not more(start + n + 4) or buffer[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {base} is cut short")
        yield base, head, bytes(buffer[start : start + n])
        base += start + n + 4
        del buffer[: start + n + 4]


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query: captures of a site stand together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").split(".")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    if host[0] == "www":
        host = host[1:]
    return ",".join(reversed(host)) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


_RUN = "run long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]
_RUN_TYPES = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in _RUN.split(", ")]


def _page(urn: str) -> int | None:
    m = _PAGE.fullmatch(urn)
    return None if m is None or m[1] == "null" else int(m[1])


def _order(row) -> tuple:
    """URL key, time, page_id with null first."""
    return row[1], row[2], row[3] is not None, row[3] or 0


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive, sorted: a run. Payloads are checked against their digests."""
    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"]):
            name, rows = path.as_py().rsplit("/", 1)[-1], []
            run = zlib.crc32(name.encode())
            for at, head, payload in parse(raw.as_py()):
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response":
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: the payload at {at} is not that of its digest")
                    n, refers = len(payload), None
                else:
                    n, refers = int(head["X-Payload-Length"]), _page(head["WARC-Refers-To"])
                rows.append((run, url_key(head.get("WARC-Target-URI")), head["WARC-Date"], _page(head["WARC-Record-ID"]), n, digest, kind, refers, name, at))
            rows.sort(key=_order)
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_RUN_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RUN_TYPES)], names=_RUN_NAMES)


class LoserTree:
    """Merges sorted runs. Inner nodes keep the loser of their match, the winner goes up: a new row replays one path."""

    def __init__(self, runs: list[list], key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.width = max(1, len(runs))
        self.rows = [next(r, None) for r in self.runs] or [None]
        self.keys = [None if r is None else key(r) for r in self.rows]
        self.losers = [-1] * self.width
        self.winner = self._play(1)

    def _beats(self, a: int, b: int) -> bool:
        """Ties go to the earlier run; a run that has ended loses."""
        ka, kb = self.keys[a], self.keys[b]
        return ka is not None and (kb is None or ka < kb or ka == kb and a < b)

    def _play(self, node: int) -> int:
        """The first matches of the tree whose leaves are width .. 2 * width - 1."""
        if node >= self.width:
            return node - self.width
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self):
        while (row := self.rows[self.winner]) is not None:
            yield row
            w = self.winner
            self.rows[w] = row = next(self.runs[w], None)
            self.keys[w] = None if row is None else self.key(row)
            node = (w + self.width) // 2
            while node >= 1:
                other = self.losers[node]
                if self._beats(other, w):
                    self.losers[node], w = w, other
                node //= 2
            self.winner = w


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its parts of the runs, merged. Rows of a run arrive in its order, in one or more stretches."""
    runs: dict[int, list[list[tuple]]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            stretches = runs.setdefault(row[0], [[]])
            if stretches[-1] and _order(stretches[-1][-1]) > _order(row):
                stretches.append([])
            stretches[-1].append(row)
    out = []
    for row in LoserTree([s for r in runs.values() for s in r], _order):
        out.append(row)
        if len(out) == 5000:
            yield _batch(out)
            out = []
    yield _batch(out)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, ordered by URL key and time over the whole result."""
    prepare(spark)
    spark_path = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = spark_path.mapInArrow(_parsed, _RUN)
    runs = written(runs, "capture-runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(parts, "url_key", "captured", F.col("page_id").asc_nulls_first()).mapInArrow(_merged, _RUN)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives in the shared folder, and returns what their merged index says of each page."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return index(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "at")
