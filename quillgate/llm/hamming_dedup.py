"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

1. Every text becomes its set of 5-word shingles (A-Z lower-cased); texts with equal sets are one
   class.  A class is signed by ``chunks * slots`` minima, of which ``bits`` bits are kept.
2. Two signatures differ in at most ``radius`` slots.  By the pigeonhole principle one of their
   chunks then differs in at most ``errors`` slots.  All places of so many errors are enumerated:
   a key is a chunk with those slots left out.  Both signatures have that key, so every pair
   within the radius shares a bucket.  ``choose_chunks`` takes the radius from the tail of the
   binomial, so that a pair at the threshold lies within it with the target recall.
3. Buckets are named by their least member, so classes that share many of them meet once.
   Every member is compared with the centre of its bucket, the member whose keys are the most
   common, on full sets: rows grow with the members.
4. Members tied to the centre are connected and need no comparison with each other.  Members that
   are not (loose ones) meet all others in blocks of bounded size: signatures first, then full
   sets; each writes one edge.
5. Edges are contracted to components.

Defined results: a text of fewer than 5 words is one shingle.  A null, empty or wordless text has
none, is linked with nothing and is its own component.  Rows that repeat an id are judged one by
one.  A row with a null id links nothing, has no component and is kept.  Extra columns are not
read; an empty table gives no row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.arrays import Texts, mix, prefix_hashes, range_hashes, slices, windows
from quillgate.llm.jaccard_join import components
from quillgate.llm.packing import packed, unpacked
from quillgate.llm.shared import documents_of, table, wide_hash, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
_KEY = pa.binary(16)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 85  #: links have 100 * intersection >= percent * union
    recall: float = 0.9999  #: of pairs at the threshold that lie within the radius
    slots: int = 5  #: signature slots of a chunk
    errors: int = 1  #: slots of a chunk that may differ
    bits: int = 16  #: bits of a slot
    most_chunks: int = 64
    block: int = 1024  #: members of one side of a task
    block_shingles: int = 400_000  #: and their shingles
    slice_bytes: int = 1 << 18  #: packed texts a worker opens at a time


def choose_chunks(settings: Settings) -> tuple[int, int]:
    """(chunks, radius): the fewest chunks whose radius holds a pair at the threshold with the recall."""
    differ = (1 - settings.percent / 100) * (1 - 2.0**-settings.bits)
    for chunks in range(1, settings.most_chunks + 1):
        n, radius = chunks * settings.slots, chunks * (settings.errors + 1) - 1
        inside = sum(math.comb(n, k) * differ**k * (1 - differ) ** (n - k) for k in range(min(n, radius) + 1))
        if inside >= settings.recall:
            return chunks, radius
    raise ValueError("no signature of so few chunks reaches the recall")


def shingles(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) pairs, sorted; a text of fewer words is one shingle."""
    low = texts.lowered()
    starts, ends, first = low.words()
    h = low.word_hashes(starts, ends)
    _, row, gram = windows(h, first, length)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < length))
    radix = 0xD1342543DE82EF95
    whole = mix(range_hashes(prefix_hashes(mix(h, 9), radix), first[short], first[short + 1], radix) ^ counts[short].astype(np.uint64), 8)
    row, gram = np.concatenate((row, short)), np.concatenate((gram, whole))
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _binary(rows: np.ndarray, width: int) -> pa.Array:
    """A matrix of bytes as a binary column."""
    data = np.ascontiguousarray(rows).tobytes()
    offsets = np.arange(0, len(data) + 1, width, dtype=np.int32) if width else np.zeros(1, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _signer(settings: Settings):
    n_slots = choose_chunks(settings)[0] * settings.slots
    rng = np.random.default_rng(31)
    factor = rng.integers(1, 2**62, n_slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, n_slots, dtype=np.uint64)
    keep = np.uint64((1 << settings.bits) - 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column("text")):
                row, gram = shingles(texts, settings.words)
                size = np.bincount(row, minlength=hi - lo)
                has, at = np.unique(row, return_index=True)
                key, signature = np.zeros((len(has), 2), dtype=np.uint64), np.zeros((len(has), n_slots), dtype=np.uint16)
                if len(has):
                    for k in range(2):  # a sum does not depend on the order
                        key[:, k] = mix(np.add.reduceat(mix(gram, k + 1), at), k + 5)
                    for k in range(n_slots):
                        least = np.minimum.reduceat((gram * factor[k] + shift[k]) ^ (gram >> np.uint64(29)), at)
                        signature[:, k] = mix(least, 4) & keep
                where = np.full(hi - lo, -1)
                where[has] = np.arange(len(has))
                take = pa.array(where, pa.int64(), mask=where < 0)
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "t1", "t2")}, "n": pa.array(size, pa.int64()),
                    "key": _binary(key, 16).take(take), "signature": _binary(signature, 2 * n_slots).take(take),
                })

    return sign


def _keyed(settings: Settings):
    """``buckets``: the chunks of a signature with every choice of ``errors`` slots left out."""
    chunks = choose_chunks(settings)[0]
    stay = [list(x) for x in combinations(range(settings.slots), settings.slots - settings.errors)]

    def enumerate_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = _matrix(batch.column("signature")).astype(np.uint64).reshape(batch.num_rows, chunks, settings.slots)
            keys = np.empty((batch.num_rows, chunks, len(stay)), dtype=np.uint64)
            for k, places in enumerate(stay):
                h = np.broadcast_to(mix(np.arange(chunks, dtype=np.uint64) * np.uint64(len(stay)) + np.uint64(k), 11), (batch.num_rows, chunks))
                for place in places:
                    h = mix(h ^ signature[:, :, place], 12)
                keys[:, :, k] = h
            width = chunks * len(stay)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), lists], names=["key", "n", "buckets"])

    return enumerate_errors


def _matrix(signatures: pa.Array) -> np.ndarray:
    values = signatures.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint16).reshape(len(values), -1) if values else np.zeros((0, 1), dtype=np.uint16)


def _stretches(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a heavier row is alone."""
    at, sums = 0, np.concatenate(([0], np.cumsum(weights)))
    while at < len(weights):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, side="right")) - 1)
        yield at, to
        at = to


def _sets(blobs: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of packed texts."""
    rows, grams = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for lo, _, texts in slices(unpacked(blobs)):
        row, gram = shingles(texts, settings.words)
        rows.append(row + lo)
        grams.append(gram)
    return np.concatenate(rows), np.concatenate(grams)


def _weights(blobs: pa.Array) -> np.ndarray:
    return np.array([len(x) for x in blobs.to_pylist()], dtype=np.int64)


def _verifier(settings: Settings):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in _stretches(_weights(whole.column("blob_a")) + _weights(whole.column("blob_b")), settings.slice_bytes):
                batch = whole.slice(lo, hi - lo)
                sides = [_sets(batch.column(c), settings) for c in ("blob_a", "blob_b")]
                row, gram = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (gram[1:] == gram[:-1])], minlength=hi - lo)
                linked = 100 * both >= settings.percent * (np.bincount(row, minlength=hi - lo) - both)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return verify


def _linker(settings: Settings, radius: int):
    def meet(left: np.ndarray, right: np.ndarray, m: dict, label: np.ndarray) -> None:
        """Join the labels of linked members; the right side is indexed by shingle."""
        start, gram, n, tied, signature = m["start"], m["gram"], m["n"], m["tied"], m["signature"]
        ours = np.concatenate([gram[start[j] : start[j + 1]] for j in right])
        owner = np.repeat(np.arange(len(right)), n[right])
        order = np.argsort(ours, kind="stable")
        ours, owner = ours[order], owner[order]
        for i in left:
            open_ = (label[right] != label[i]) & ~(tied[right] & tied[i])
            open_ &= 100 * np.minimum(n[right], n[i]) >= settings.percent * np.maximum(n[right], n[i])
            some = np.flatnonzero(open_)
            some = some[(signature[right[some]] != signature[i]).sum(axis=1) <= radius]
            if not len(some):
                continue
            mine = gram[start[i] : start[i + 1]]
            lo, hi = np.searchsorted(ours, mine, side="left"), np.searchsorted(ours, mine, side="right")
            width = hi - lo
            places = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
            both = np.bincount(owner[places], minlength=len(right))[some]
            linked = right[some[100 * both >= settings.percent * (n[i] + n[right[some]] - both)]]
            if len(linked):
                old = np.append(label[linked], label[i])
                label[np.isin(label, old)] = old.min()

    def task(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        row, gram = _sets(rows.column("blob").combine_chunks(), settings)
        count = rows.num_rows
        start = np.searchsorted(row, np.arange(count + 1))
        m = {
            "start": start, "gram": gram, "n": np.diff(start), "signature": _matrix(rows.column("signature").combine_chunks()),
            "tied": rows.column("tied").to_numpy().astype(bool),
        }
        keys, side = rows.column("key").to_pylist(), rows.column("side").to_numpy()
        _, hub = np.unique(np.array(rows.column("hub").to_pylist(), dtype="V16"), return_inverse=True)
        out: dict[str, list] = {"a": [], "b": []}
        order = np.argsort(hub, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(hub[order])) + 1) if count else []:
            label = np.arange(count)
            tied = members[m["tied"][members]]
            label[tied] = tied.min(initial=count)  # connected through the centre
            first, second = members[side[members] == 0], members[side[members] == 1]
            loose = first[~m["tied"][first]]
            others = second if len(second) else first
            if len(loose) and len(others):
                meet(loose, others, m, label)
            for i in members[label[members] != members]:
                if not (m["tied"][i] and m["tied"][label[i]]):
                    out["a"].append(keys[i])
                    out["b"].append(keys[label[i]])
        return pa.table({c: pa.array(v, pa.binary()) for c, v in out.items()})

    return task


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, blob`` of the wanted classes, one text for each."""
    blobs = packed(rows.where("doc_id IS NOT NULL").select("doc_id", "t1", "t2", "text"))
    found = blobs.hint("merge").join(written(wanted.select("key", "doc_id", "t1", "t2"), "wanted").hint("merge"), ["doc_id", "t1", "t2"])
    return written(found.groupBy("key").agg(F.first("blob").alias("blob")), "class-texts")


def _loose_edges(standing: DataFrame, classes: DataFrame, texts: DataFrame, settings: Settings, radius: int) -> DataFrame:
    """Edges between members of a bucket that the centre has not connected."""
    tied, n = F.col("tied"), F.col("n")
    groups = standing.where("NOT centre").groupBy("hub").agg(
        *[F.count(F.when(x, 1)).alias(f"{name}_rows") for name, x in (("loose", ~tied), ("tied", tied))],
        *[F.sum(F.when(x, n).otherwise(0)).alias(f"{name}_n") for name, x in (("loose", ~tied), ("tied", tied))],
    ).where("loose_rows > 0 AND loose_rows + tied_rows > 1")
    blocks = lambda name: F.ceil(F.greatest(F.col(f"{name}_rows") / settings.block, F.col(f"{name}_n") / settings.block_shingles))
    small = (F.col("loose_rows") + F.col("tied_rows") <= settings.block) & (F.col("loose_n") + F.col("tied_n") <= settings.block_shingles)
    groups = written(groups.select("hub", small.alias("small"), blocks("loose").alias("loose"), blocks("tied").alias("rest"), (F.col("loose_n") + F.col("tied_n")).alias("n")), "loose-groups")
    total = groups.where("small").agg(F.sum("n")).first()[0]
    if total is None and groups.isEmpty():
        return standing.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    bins = max(1, (total or 0) // settings.block_shingles)
    met = standing.where("NOT centre").drop("n", "centre").join(groups.drop("n"), "hub")
    own = F.when(tied, F.col("loose") + F.pmod(F.xxhash64("key", F.lit(5)), F.greatest("rest", F.lit(1)))).otherwise(F.pmod(F.xxhash64("key", F.lit(5)), F.col("loose")))
    last = F.when(tied, F.col("loose")).otherwise(F.col("loose") + F.col("rest")) - 1  # tied members meet loose ones only
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("small"), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), last))))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        "key", "hub", "tied",
        F.when(F.col("small"), F.pmod(F.xxhash64("hub"), F.lit(bins))).otherwise(F.xxhash64("hub", first, second)).alias("task"),
        F.when(F.col("small") | (F.col("own") == first), 0).otherwise(1).alias("side"),
    )
    members = texts.hint("merge").join(classes.select("key", "signature").hint("merge"), "key").join(written(dealt, "dealt").hint("merge"), "key")
    return members.groupBy("task").applyInArrow(_linker(settings, radius), "a binary, b binary")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``."""
    radius = choose_chunks(settings)[1]
    rows = documents_of(docs).select("doc_id", *wide_hash(F.coalesce("text", F.lit("")), "t"), "text")
    signed = written(rows.mapInArrow(_signer(settings), "doc_id long, t1 long, t2 long, n long, key binary, signature binary"), "signed")
    known = signed.where("key IS NOT NULL AND doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "t1", "t2")).alias("least")
    classes = written(known.groupBy("key").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), least).select("key", "n", "signature", "least.*"), "classes")

    keyed = written(classes.select("key", "n", "signature").mapInArrow(_keyed(settings), "key binary, n long, buckets array<long>"), "keyed")
    entries = keyed.select("key", "n", F.explode("buckets").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("key").alias("hub"), F.max("key").alias("last"), F.count(F.lit(1)).alias("size")).where("hub < last").drop("last")
    met = entries.join(written(buckets, "buckets"), "bucket").groupBy("hub", "key").agg(F.sum("size").alias("weight"), F.first("n").alias("n"))
    met = written(met, "met")
    centres = written(met.groupBy("hub").agg(F.max(F.struct("weight", "key", "n")).alias("c")).select("hub", F.col("c.key").alias("centre"), F.col("c.n").alias("centre_n")), "centres")
    near = 100 * F.least("n", "centre_n") >= settings.percent * F.greatest("n", "centre_n")
    star = met.join(centres, "hub").select("hub", "key", "n", F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b"), near.alias("near"))
    star = written(star, "star")
    pairs = written(star.where("near AND a < b").select("a", "b").distinct(), "pairs")
    texts = _texts_of(rows, met.select("key").distinct().join(classes, "key"))
    sides = [texts.select(F.col("key").alias(c), F.col("blob").alias(f"blob_{c}")).hint("merge") for c in ("a", "b")]
    tested = pairs.hint("merge").join(sides[0], "a").join(sides[1], "b").select("a", "b", "blob_a", "blob_b")
    links = written(tested.mapInArrow(_verifier(settings), "a binary, b binary, linked boolean").where("linked").select("a", "b"), "links")

    marked = star.join(links.withColumn("link", F.lit(True)), ["a", "b"], "left")
    standing = written(marked.select("hub", "key", "n", (F.col("a") == F.col("b")).alias("centre"), F.coalesce("link", F.lit(False)).alias("tied")), "standing")
    more = written(_loose_edges(standing, classes, texts, settings, radius), "loose-edges")
    roots = components(links.unionByName(more))
    ids = classes.select(F.col("key").alias("node"), "doc_id")
    tree = written(roots.join(ids, "node").groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    named = roots.join(tree, "root").select(F.col("node").alias("key"), "component_id")
    told = written(classes.select("key", "doc_id").join(named, "key", "left").select("key", F.coalesce("component_id", "doc_id").alias("component_id")), "told")
    out = known.join(told, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("key IS NULL OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op11_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
