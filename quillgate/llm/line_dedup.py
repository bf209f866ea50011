"""Line dedup: levelled sorted runs of line hashes, merge-anti-joined by every new batch.

``LineRuns`` keeps, per line key, in how many documents it was found.  A batch is counted on
its own, merge-anti-joined with the runs so that keys that already reached the threshold are
not carried again, and added as a sorted run of level 0.  When a level holds ``fan_in``
runs they are compacted into one sorted run of the next level, so a key is rewritten once
per level only, and the number of runs grows with the logarithm of the batches.

``drop_common_lines`` applies the counts to all documents.  Everything is DataFrame
operations.  A very common line is counted by partial sums and looked up by a join that
adaptive execution can split; a document's lines come together only in its own row.

Defined results: a null or empty text is one empty line, kept as an empty text.  Keys shorter
than ``least_chars`` are never dropped.  Rows that repeat a ``doc_id`` count as one document
(also a null id) and are cleaned one by one.  A document that loses all lines keeps an empty
text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.shared import ascii_lower, bound, carried, documents_of, table, wide_hash, written

_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Settings:
    least_chars: int = 1
    least_docs: int = 10
    batches: int = 4  #: a full table is fed to the runs in so many batches
    fan_in: int = 2  #: runs of a level before they are compacted into the next


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_SPACES)))


@dataclass
class LineRuns:
    """Runs of ``(h1, h2, n_docs)`` by level, each a table in the shared folder."""

    settings: Settings = Settings()
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Count a batch of ``(doc_id, h1, h2)``; no document is in two batches."""
        fresh = batch.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        for run in self.runs():
            closed = run.where(F.col("n_docs") >= self.settings.least_docs).select("h1", "h2")
            fresh = fresh.join(closed.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, fresh)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(written(run, f"line-run-{level}", sort=["h1", "h2"]))
        if len(self.levels[level]) >= self.settings.fan_in:
            merged = _merged(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)

    def common(self) -> DataFrame:
        """Keys found in at least ``least_docs`` documents over all batches."""
        found = _merged(self.runs()).where(F.col("n_docs") >= self.settings.least_docs).select("h1", "h2")
        return written(found, "common-lines")  # as a table of its own, a join to it can be split where a line is hot


def _merged(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def common_lines_of(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(row, dropped)``: the places of common lines, for the rows that have any."""
    # One 64-bit key for a row: equal rows share it, and share their lines too.
    rows = documents_of(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    lines = rows.select("doc_id", "row", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("at", "key"))
    keyed = written(
        lines.where(F.length("key") >= settings.least_chars).select("doc_id", "row", "at", *wide_hash(F.col("key"))), "line-keys"
    )
    runs = LineRuns(settings)
    for k in range(settings.batches):
        runs.add(keyed.where(F.pmod(F.xxhash64("doc_id"), F.lit(settings.batches)) == k))
    return keyed.join(runs.common(), ["h1", "h2"]).groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def drop_common_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``whole`` (the columns of ``docs`` as a struct), ``n_lines``, ``n_dropped`` and ``kept_text``:
    one row for each row of ``docs``."""
    joined = carried(docs).join(common_lines_of(docs, settings), "row", "left")
    text = F.coalesce(F.col("whole").getField("text").cast("string"), F.lit(""))
    clean = F.col("dropped").isNull()
    return joined.select(
        "whole",
        F.size(lines_of(text)).cast("bigint").alias("n_lines"),
        F.when(clean, F.lit(0)).otherwise(F.size("dropped")).cast("bigint").alias("n_dropped"),
        F.when(clean, text).otherwise(_without(lines_of(text), F.col("dropped"))).alias("kept_text"),
    )


def _without(lines: Column, dropped: Column) -> Column:
    """The other lines, joined: the stretches between the sorted dropped positions."""
    before = F.concat(F.array(F.lit(-1)), dropped)

    def stretches(lines: Column) -> Column:
        after = F.concat(dropped, F.array(F.size(lines)))
        return F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1))

    return F.array_join(F.flatten(bound(lines, stretches)), "\n")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("whole.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line, translate(trim(u.line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(d.l) AS line, generate_subscripts(d.l, 1) AS pos) u
), common AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
