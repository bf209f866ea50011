r"""WARC archives of pages, read back through a merged capture index.

Writing: a record is headers and payload; of records with equal payloads of at least
``least_bytes`` the least page is the response, the others are revisits without a payload.
Archives are written by Spark's own text writer, whose line separator is the two line breaks
that end a WARC record, so a lost executor's file is written again like any other.

Reading: an archive is parsed by its ``Content-Length`` headers, whatever the payloads hold,
and yields its captures in archive order: a run that is sorted by URL key and time.  The runs
are dealt to ranges of (URL key, time, page), and each range merges its pieces of the k runs
by a loser tree: the result is globally ordered by range and inside each range.

Rows meet by payload digest in a join that can be split, and a hot URL spreads over ranges by
time.  Payloads are held one archive at a time when read; an archive has as many records as
``archive_bytes`` hold at the mean payload.

Defined results: a null html is an empty payload; a null url has an empty key and comes back
null; line breaks in a url are percent-encoded.  A null page is never the one referred to.
Rows that repeat the least page of a payload are all responses.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.shared import ascii_lower, table, written
from quillgate.sources.settle import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])
_CAPTURE = "url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
_SECONDS = 200_000_000_000  #: from 2023 to the year 8361
_END = "\r\n\r\n"


@dataclass(frozen=True)
class Settings:
    least_bytes: int = 100
    archive_bytes: int = 8 << 20  #: payload bytes of an archive at the mean payload
    range_rows: int = 100_000  #: captures of a range, about


def url_key(url: Column) -> Column:
    """Host labels from right to left, then the rest of the url: pages of a site sort together."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def write_archives(pages: DataFrame, path: str, settings: Settings = Settings(), time: str | None = None) -> None:
    """Write ``pages`` (page_id, url, html) as gzip-compressed archives.

    ``time`` names a timestamp column; without one, captures are a second apart by page, and
    begin again after ``_SECONDS`` ids, so that any id has a date of four-digit years.
    """
    second = F.pmod(F.coalesce(F.col("page_id").cast("bigint"), F.lit(0)), F.lit(_SECONDS))
    ts = F.col(time) if time else F.timestamp_seconds(F.lit(1_700_000_000) + second)
    url = F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
    ).withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("bigint"))
    long = F.col("bytes") >= settings.least_bytes
    firsts = written(rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first")).where("first IS NOT NULL"), "warc-firsts")
    told = rows.join(firsts, "digest", "left")
    again = F.coalesce(long & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    told = told.withColumn("again", again).withColumn("payload", F.when(F.col("again"), F.lit("")).otherwise(F.col("html")))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.lit("\r\nWARC-Date: "), F.col("ts"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(F.col("again"), F.concat(
            F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(_END),
    )
    mean = max(1.0, rows.agg(F.avg("bytes")).first()[0] or 0.0)
    records = told.select(url_key(F.col("url")).alias("key"), "ts", F.coalesce("page_id", F.lit(-1)).alias("page"), F.concat(header, "payload").alias("value"))
    # Pages are written where the join has brought them: payloads are shuffled once.
    run = records.sortWithinPartitions("key", "ts", "page").select("value").write.option("maxRecordsPerFile", max(1, int(settings.archive_bytes / mean)))
    run.option("lineSep", _END).option("compression", "gzip").text(path)


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, blob in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
            data = memoryview(gzip.decompress(blob.as_buffer()))
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "ts", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset")}
            at, raw = 0, data.obj
            while at < len(data):
                body = raw.index(b"\r\n\r\n", at) + 4
                head = dict(line.split(": ", 1) for line in raw[at : body - 4].decode("utf-8", "surrogateescape").split("\r\n")[1:])
                length = int(head["Content-Length"])
                revisit = head["WARC-Type"] == "revisit"
                page = lambda k: int(head[k].removeprefix("<urn:page:").rstrip(">")) if k in head else None  # noqa: B023, E731
                out["page_id"].append(page("WARC-Record-ID"))
                out["refers_to"].append(page("WARC-Refers-To"))
                out["url"].append(head.get("WARC-Target-URI"))
                out["ts"].append(head["WARC-Date"])
                out["record_type"].append(head["WARC-Type"])
                out["payload_bytes"].append(int(head["X-Payload-Length"]) if revisit else length)
                digest = hashlib.sha256(data[body : body + length]).hexdigest()
                out["payload_digest"].append(head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else digest)
                out["offset"].append(at)
                at = body + length + 4
            n = len(out["offset"])
            out["archive"] = [name] * n
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("page_id", pa.int64()), ("url", pa.string()), ("ts", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                ("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("archive", pa.string()),
            ]))


class LoserTree:
    """k sorted runs, least item first.  Inner nodes hold the loser of each match, so a step
    replays one path: one comparison for each level."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.top] is not None:
            yield self.heads[self.top]
            at = self.top
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._first(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.top = at


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()  # one range of captures
    if not rows.num_rows:
        return
    keys = list(zip(*(rows.column(c).to_pylist() for c in ("url_key", "ts", "page_id")), range(rows.num_rows), strict=True))
    keys = [(k, t, -1 if p is None else p, i) for k, t, p, i in keys]
    runs: dict[str, list] = {}
    for archive, key in zip(rows.column("archive").to_pylist(), keys, strict=True):
        runs.setdefault(archive, []).append(key)
    order = [key[3] for key in LoserTree([iter(r) for r in runs.values()])]
    yield from rows.take(pa.array(order)).to_batches()


def read_archives(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    """All captures of the archives, in order of URL key, time and page."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.regexp_extract("path", "[^/]*$", 0).alias("archive"), "content"
    )
    found = files.mapInArrow(
        _captures, "page_id long, url string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, archive string"
    )
    runs = written(found.withColumn("url_key", url_key(F.col("url"))), "warc-runs")
    ranges = max(1, math.ceil(runs.count() / settings.range_rows))
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    dealt = runs.select(*names).repartitionByRange(max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))), "url_key", "ts", "page_id")
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(_merge, _CAPTURE)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS lo FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN lo < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN lo < page_id THEN lo END AS refers_to
FROM m
"""
