"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets verify them.

1. Every text becomes its set of 5-word shingles (ASCII letters lower-cased).  Texts with
   equal sets form a class; only one text of each class goes on.
2. ``choose_bands`` takes bands and rows so that a pair at the threshold is found with the
   target recall.  The bands are shuffled by hash, a row of numbers for each band.
3. The least member of a bucket is its hub.  Members meet by hub, so a group of near copies
   that shares twenty buckets meets once, not twenty times.  A hub with more members than
   ``block`` is cut into blocks, and each pair of blocks is a task of its own.
4. A task counts the shingles that two texts share by multiplying incidence matrices and
   writes, for each text, its number of links, and one edge to the least linked text: rows
   grow with the members, never with the pairs.  A pair that meets at several hubs is
   counted at the least of them.
5. Edges are contracted to connected groups by alternating stars.

Defined results: a text of fewer than 5 words is one shingle; a null or wordless text is in
no class but its own, without links.  Rows that repeat a ``doc_id`` are joined one by one;
rows with a null id are in no group.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.arrays import Texts, mix, slices, windows
from quillgate.llm.packing import packed, unpacked
from quillgate.llm.shared import documents_of, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): as many rows in a band as ``most_hashes`` allow at the target recall."""
    for rows in range(most_hashes, 0, -1):
        chance = threshold**rows  # that a pair at the threshold agrees in one band
        bands = math.ceil(math.log1p(-recall) / math.log1p(-chance)) if 0 < chance < 1 else int(chance) or most_hashes + 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no bands reach the recall with so few hashes")


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    most_hashes: int = 128
    block: int = 1024  #: members that one side of a task holds
    bin_rows: int = 2048  #: members of small hubs that share a task


def _shingles(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) pairs, sorted; a text of fewer words is one shingle."""
    low = texts.lowered()
    starts, ends, first = low.words()
    h = low.word_hashes(starts, ends)
    _, row, gram = windows(h, first, length)
    counts = np.diff(first)
    for r in np.flatnonzero((counts > 0) & (counts < length)):
        whole = np.uint64(counts[r])
        for x in h[first[r] : first[r + 1]]:
            whole = mix(np.array([whole ^ x]), 3)[0]
        row, gram = np.append(row, r), np.append(gram, whole)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _signer(settings: Settings):
    bands, rows = choose_bands(settings.threshold, settings.recall, settings.most_hashes)
    rng = np.random.default_rng(29)
    factor = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column("text")):
                row, gram = _shingles(texts, settings.words)
                has, at = np.unique(row, return_index=True)
                if not len(has):
                    continue
                size = np.diff(np.append(at, len(row)))
                sums = [np.add.reduceat(mix(gram, seed), at) for seed in (1, 2)]  # a sum does not depend on the order
                hashes = np.empty((len(has), bands), dtype=np.uint64)
                for band in range(bands):
                    joint = np.full(len(has), band, dtype=np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        joint = mix(joint ^ np.minimum.reduceat((gram * factor[k] + shift[k]) ^ (gram >> np.uint64(29)), at), 4)
                    hashes[:, band] = joint
                take = pa.array(lo + has)
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column("row").take(take), "doc_id": batch.column("doc_id").take(take),
                    "size": pa.array(size.astype(np.int32)),
                    "c1": pa.array(sums[0].view(np.int64)), "c2": pa.array(sums[1].view(np.int64)),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.arange(0, hashes.size + 1, bands, dtype=np.int32)), pa.array(hashes.ravel().view(np.int64))
                    ),
                })

    return sign


def _shared(left: tuple, right: tuple) -> np.ndarray:
    """How many keys each left and right member have in common; a side is (member, key, members)."""
    (lm, lk, ln), (rm, rk, rn) = left, right
    out = np.zeros((ln, rn), dtype=np.float32)
    both = np.intersect1d(lk, rk)
    for at in range(0, len(both), 2048):
        some = both[at : at + 2048]
        sides = []
        for member, key, n in (left, right):
            column = np.minimum(np.searchsorted(some, key), len(some) - 1)
            hit = some[column] == key
            dense = np.zeros((n, len(some)), dtype=np.float32)
            dense[member[hit], column[hit]] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def _side(rows: list[dict], keys: list[np.ndarray]) -> tuple:
    lengths = [len(k) for k in keys]
    return np.repeat(np.arange(len(rows)), lengths), np.concatenate(keys) if keys else np.zeros(0), len(rows)


def _linker(settings: Settings):
    def links(left: list[dict], right: list[dict], hub: int, same: bool) -> np.ndarray:
        a, b = (_side(x, [r["grams"] for r in x]) for x in (left, right))
        shared = _shared(a, b)
        na, nb = (np.array([len(r["grams"]) for r in x], dtype=np.float64) for x in (left, right))
        linked = shared >= settings.threshold * (na[:, None] + nb[None, :] - shared) - 1e-6
        lower = [_side(x, [np.array([h for h in r["hubs"] if h < hub], dtype=np.int64) for r in x]) for x in (left, right)]
        linked &= _shared(*lower) == 0  # a lower hub of both counts the pair
        if same:
            np.fill_diagonal(linked, False)
        return linked

    def task(table: pa.Table) -> pa.Table:
        rows = table.select(["row", "hub", "side", "hubs", "same"]).to_pylist()
        for lo, hi, texts in slices(unpacked(table.column("blob").combine_chunks())):
            member, gram = _shingles(texts, settings.words)
            cuts = np.searchsorted(member, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                rows[lo + k]["grams"] = gram[cuts[k] : cuts[k + 1]]
        groups: dict[int, tuple[list, list]] = {}
        for r in rows:
            groups.setdefault(r["hub"], ([], []))[r["side"]].append(r)
        out: dict[str, list] = {"row": [], "n": [], "to": []}
        for hub, (left, right) in groups.items():
            same = left[0]["same"] if left else False
            right = left if same else right
            if not left or not right:
                continue
            linked = links(left, right, hub, same)
            ids = [np.array([r["row"] for r in x], dtype=np.int64) for x in (left, right)]
            big = np.int64(2**63 - 1)
            # The least id among linked texts: following it from both sides connects all of them.
            label = [i.copy() for i in ids]
            while True:
                news = [
                    np.minimum(label[0], np.where(linked, label[1][None, :], big).min(axis=1, initial=big)),
                    np.minimum(label[1], np.where(linked, label[0][:, None], big).min(axis=0, initial=big)),
                ]
                done = all((x == y).all() for x, y in zip(news, label, strict=True))
                label = [np.minimum(*news)] * 2 if same else news
                if done:
                    break
            for k in range(1 if same else 2):
                n = linked.sum(axis=1 - k)
                hit = np.flatnonzero(n)
                out["row"] += ids[k][hit].tolist()
                out["n"] += n[hit].tolist()
                out["to"] += label[k][hit].tolist()
        return pa.table({"row": pa.array(out["row"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "to": pa.array(out["to"], pa.int64())})

    return task


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes of ``edges (a, b)``; the root is the least node it is connected to.

    Alternating large and small stars; every round is a few aggregations and joins over at
    most as many edges as before.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        # small star: a node and its smaller neighbours are tied to the least of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        rooted = after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        # Done when every node has one root: none is source and target, none is tied to two roots.
        if rooted.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("last")).where("least < last").isEmpty():
            return rooted
        now = after


def joined(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, row, class_id, n_links, text_id, group_id``: one row for each row of ``docs``.

    ``text_id`` is the least id with the same shingle set, ``class_id`` the least id of the
    group of linked texts, ``n_links`` the number of other shingle sets at the threshold.
    ``group_id`` tells groups apart: unlike ``class_id`` it differs between unrelated texts
    that share a ``doc_id``.  It is the hash of a row of the group.
    """
    rows = documents_of(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    signed = written(
        rows.where("doc_id IS NOT NULL").mapInArrow(_signer(settings), "row long, doc_id long, size int, c1 long, c2 long, bands array<long>"), "signatures"
    )
    classes = written(
        signed.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.first("bands").alias("bands"))
        .select("c1", "c2", F.col("rep.doc_id").alias("text_id"), F.col("rep.row").alias("rep"), "bands"),
        "classes",
    )
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("bucket", "hub")
    met = written(banded.join(written(buckets, "buckets"), "bucket").select("rep", "hub").distinct(), "met")
    # A text has at most one hub for each band.
    of_text = met.groupBy("rep").agg(F.collect_set("hub").alias("hubs"))
    size = written(met.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).select("hub", F.ceil(F.col("members") / settings.block).alias("blocks")), "hubs")
    total = met.count()
    bins = max(1, total // settings.bin_rows)
    placed = met.join(size, "hub").withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "rep", "hub",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("hub"), F.lit(bins))).otherwise(F.xxhash64("hub", F.least("mine", "other"), F.greatest("mine", "other"))).alias("task"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") == F.col("other")).alias("same"),
    )
    # Equal rows send one text: a task must not meet copies of a representative.
    texts = packed(rows.select("row", "text")).dropDuplicates(["row"]).withColumnRenamed("row", "rep")
    # Texts always meet their members by a shuffle: the member lists grow with the input, so a plan
    # that broadcasts them on small tables would say nothing about large ones.
    members = texts.join(written(of_text, "text-hubs").hint("merge"), "rep").join(written(placed, "placed").hint("merge"), "rep")
    found = members.select(F.col("rep").alias("row"), "hub", "hubs", "task", "side", "same", "blob").groupBy("task").applyInArrow(
        _linker(settings), "row long, n long, to long"
    )
    linked = written(found, "links")
    counts = linked.groupBy(F.col("row").alias("rep")).agg(F.sum("n").alias("n_links"))
    roots = components(linked.select(F.col("row").alias("a"), F.col("to").alias("b")))
    named = roots.join(classes.select(F.col("rep").alias("node"), "text_id"), "node")
    group = written(named.groupBy("root").agg(F.min("text_id").alias("class_id")), "groups")
    whole = classes.select("c1", "c2", "text_id", "rep").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(group, "root", "left")
    told = written(
        whole.select(
            "c1", "c2", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            F.coalesce("root", "rep").alias("group_id"),
        ),
        "class-table",
    )
    by_row = signed.select("row", "c1", "c2").distinct().join(told, ["c1", "c2"]).drop("c1", "c2")
    return rows.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id", "row", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("text_id", "doc_id").alias("text_id"),
        F.coalesce("group_id", "row").alias("group_id"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).drop("row")
