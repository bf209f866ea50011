"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word that is covered by a window which also starts in a document with a smaller id is
removed; removed windows merge into maximal intervals.

Counting a row for every window would move many times the text, so windows are counted in
two steps, with the same result:

1. Every window names an anchor: the leftmost least hash among its ``anchor``-word grams.
   Equal windows have equal anchors.  Neighbouring windows with the same anchor form a run
   (about twenty windows); a run is one row with the hash of all its words.  An anchor that
   is found in one document only belongs to windows of that document only.
2. Runs are counted first: a run that also occurs, as a whole, in an earlier document is
   removed as a whole.  The first copy of every other run with a repeated anchor is opened:
   its windows are hashed one by one (128 bits) and counted in Spark.

Minima by hash are summed partially before each shuffle and looked up by joins that adaptive
execution can split, so a passage in a third of all documents is spread over tasks.

Defined results: a null, empty or wordless text has no words and stays empty; a text shorter
than a window stays whole.  Rows that repeat a ``doc_id`` do not remove each other and are
judged one by one; rows with a null id neither remove nor lose words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.arrays import mix, prefix_hashes, range_hashes, slices, windows
from quillgate.llm.packing import packed, unpacked
from quillgate.llm.shared import documents_of, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
_SIDES = (11, 12)  # seeds of the two halves of a 128-bit hash


@dataclass(frozen=True)
class Settings:
    window: int = 50  #: words
    anchor: int = 10  #: words in the grams that anchors are chosen from


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in ``values[i : i + width]``, for every full window."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        near, far = at[:-step], at[step:]
        at = np.where(values[far] < values[near], far, near)
        have += step
    return at


def _runs(settings: Settings):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = settings.window, settings.anchor
        for batch in batches:
            for lo, hi, texts in slices(batch.column("text")):
                starts, ends, first = texts.words()
                if len(starts) < n or np.diff(first).max(initial=0) < n:
                    continue
                h = texts.word_hashes(starts, ends)
                base = 0x2545F4914F6CDD1D
                every = np.arange(len(h) - k + 1)
                grams = mix(range_hashes(prefix_hashes(h, base), every, every + k, base), 5)
                start, row = windows(h, first, n)[:2]
                anchor = _leftmost_least(grams, n - k + 1)[start]
                head = np.flatnonzero(np.diff(anchor, prepend=-1))
                tail = np.append(head[1:], len(anchor)) - 1
                a, b, p, r = start[head], start[tail], anchor[head], row[head]
                shape = ((p - a).astype(np.uint64) << np.uint64(32)) | (b - a).astype(np.uint64)
                sides = []
                for seed in _SIDES:
                    radix = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64 | 5
                    sides.append(mix(range_hashes(prefix_hashes(mix(h, seed), radix), a, b + n, radix) ^ mix(shape, seed)))
                take = pa.array(lo + r)
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column("row").take(take), "doc_id": batch.column("doc_id").take(take),
                    "anchor": pa.array(grams[p].view(np.int64)), "s1": pa.array(sides[0].view(np.int64)), "s2": pa.array(sides[1].view(np.int64)),
                    "a": pa.array((a - first[r]).astype(np.int32)), "b": pa.array((b - first[r]).astype(np.int32)),
                })

    return cut


def _ranges(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in slice, first, last) of a list<struct<a, b>> column."""
    part = column.slice(lo, hi - lo).fill_null([])
    flat = part.flatten()
    row = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
    return row, np.asarray(flat.field("a")).astype(np.int64), np.asarray(flat.field("b")).astype(np.int64)


def _opened(settings: Settings):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for lo, hi, texts in slices(unpacked(batch.column("blob"))):
                    starts, ends, first = texts.words()
                    start, row, h1, h2 = windows(texts.word_hashes(starts, ends), first, settings.window, _SIDES)
                    r, a, b = _ranges(batch.column("ranges"), lo, hi)
                    wanted = np.zeros(len(starts) + 1, dtype=np.int64)
                    np.add.at(wanted, first[r] + a, 1)
                    np.add.at(wanted, first[r] + b + 1, -1)
                    hit = np.cumsum(wanted)[start] > 0
                    take = pa.array(lo + row[hit])
                    yield pa.RecordBatch.from_pydict({
                        "row": batch.column("row").take(take), "doc_id": batch.column("doc_id").take(take),
                        "h1": pa.array(h1[hit].view(np.int64)), "h2": pa.array(h2[hit].view(np.int64)),
                        "at": pa.array((start - first[row])[hit].astype(np.int32)),
                    })

    return hashes


def _kept(settings: Settings):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                counts, removed, spans, texts = [], [], [], []
                for blob, ranges in zip(batch.column("blob").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                    words = unpack(blob).split()  # bytes.split() cuts at ASCII white space
                    counts.append(len(words))
                    intervals: list[dict] = []
                    for a, b in sorted((x["a"], x["b"] + settings.window) for x in ranges or ()):
                        if intervals and a <= intervals[-1]["to"]:
                            intervals[-1]["to"] = max(b, intervals[-1]["to"])
                        else:
                            intervals.append({"from": a, "to": b})
                    if intervals:
                        stays = np.ones(len(words), dtype=bool)
                        for x in intervals:
                            stays[x["from"] : x["to"]] = False
                        words = list(compress(words, stays))
                    removed.append(counts[-1] - len(words))
                    spans.append(intervals)
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                    pa.array(texts, pa.binary()),
                ], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return keep


def repeated_ranges(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(row, ranges)``: the first and last starts of windows to remove, for rows that have any."""
    rows = documents_of(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    runs = written(rows.mapInArrow(_runs(settings), "row long, doc_id long, anchor long, s1 long, s2 long, a int, b int"), "runs")
    repeated = runs.groupBy("anchor").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("s1") != F.max("s1")).alias("mixed")
    ).where("lo < hi").select("anchor", "mixed")
    # Tables of minima are written before they are joined: both sides of a join are then plain shuffles,
    # which adaptive execution can split where a hash is hot.
    live = written(runs.join(written(repeated, "repeated-anchors"), "anchor"), "live-runs")
    first = written(live.groupBy("s1", "s2").agg(F.min("doc_id").alias("first")), "first-runs")
    told = live.join(first, ["s1", "s2"]).select("row", "a", "b", (F.col("doc_id") > F.col("first")).alias("gone"), "mixed")
    told = written(told, "told-runs")
    to_open = told.where("mixed AND NOT gone").groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    single = written(
        packed(rows).join(to_open, "row").mapInArrow(_opened(settings), "row long, doc_id long, h1 long, h2 long, at int"), "windows"
    )
    earliest = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    earliest = written(earliest, "earliest-windows")
    more = single.join(earliest, ["h1", "h2"]).where("doc_id > lo").select("row", F.col("at").alias("a"), F.col("at").alias("b"))
    gone = told.where("gone").select("row", "a", "b").unionByName(more)
    return gone.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_words, n_removed, removed`` (maximal intervals of word positions) and ``kept_text``
    (the other words, joined by a space): one row for each row of ``docs``."""
    ranges = written(repeated_ranges(docs, settings), "ranges")
    rows = documents_of(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    wide = packed(rows).join(ranges, "row", "left").select("doc_id", "blob", "ranges")
    out = wide.mapInArrow(_kept(settings), "doc_id long, n_words long, n_removed long, removed array<struct<from:int,to:int>>, kept binary")
    return out.withColumn("kept_text", F.col("kept").cast("string")).drop("kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), g AS (
  SELECT r, doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)
), m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT r, unnest(generate_series(s, s + 49)) AS p FROM g JOIN m USING (h) WHERE doc_id > lo
), per AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN per USING (r)
"""
