"""Merkle manifest, embedding whitening and the multi-index Hamming join, against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgate.llm import hamming_dedup, merkle, whitening

from .conftest import CLASHES, SCHEMA, awkward_texts, sentence, with_clashes
from .test_join_and_models import LOWER, rows_of, shingles

# --- manifest ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def brute_tree(nodes, fan):
    """The root, and the siblings of every node level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // fan * fan : p // fan * fan + fan]
            paths[k].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
        at = [p // fan for p in at]
        level = [sha(*level[k : k + fan]) for k in range(0, len(level), fan)]
    return level[0], paths


def brute_manifest(rows, fan=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in groups[g]], fan) for g in names}
    root, over = brute_tree([trees[g][0] for g in names], fan)
    out = []
    for g, up in zip(names, over, strict=True):
        for (_, _, leaf, r), path in zip(groups[g], trees[g][1], strict=True):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf_of(r, r[4].translate(LOWER)) if touched else leaf
            for left, right in path + up:
                node = sha(left, node, right)
            out.append((r[0], leaf, trees[g][0], root, sha(*(x + y for x, y in path + up)), node, node == root))
    return sorted(out, key=repr)


def checked(docs, settings=merkle.Settings()):
    found = merkle.manifest(docs, settings)
    found = found.withColumn("folded", merkle.folded(F.coalesce("other", "leaf"), F.col("path"))).withColumn("proof", F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256))
    return rows_of(found.withColumn("verified", F.col("folded") == F.col("root")), "doc_id", "leaf", "subroot", "root", "proof", "folded", "verified")


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest_of_awkward_rows(awkward, nothing):
    assert checked(awkward) == brute_manifest(plain(awkward))
    assert merkle.manifest(nothing).count() == 0


@pytest.mark.parametrize("settings", [merkle.Settings(), merkle.Settings(fan=2, depth=2), merkle.Settings(fan=3, depth=1)])
def test_manifest_of_any_ids_and_depths(spark, settings):
    rng = random.Random(5)
    ids = [*range(150), *(rng.randrange(-(2**63), 2**63) for _ in range(150)), -1, -64, -65, 2**63 - 1, -(2**63), 2**62, *[7] * 30, *[None] * 20]
    rows = [(i, f"Text {k % 40} Ä" if k % 7 else None, (None, "", "en", "de", "é")[k % 5] if k % 3 else "en", None if k % 2 else "s", k % 4) for k, i in enumerate(ids)]
    rows += [rows[3]] * 40  # equal rows are as many leaves
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert checked(docs, settings) == brute_manifest(plain(docs), settings.fan)


def test_one_leaf_is_its_own_root(spark):
    docs = spark.createDataFrame([(1, "A", "en", "s", 1)], SCHEMA)
    (row,) = checked(docs)
    assert row == brute_manifest(plain(docs))[0] and row[1] == row[2] == row[3]


def test_places_are_ranks_by_many_words(spark):
    """Ids spread so that the directory has several levels."""
    docs = spark.range(3000).select((F.col("id") * 1_000_003).alias("doc_id"), *[F.lit(None).cast("string").alias(c) for c in ("text", "source", "lang")], F.col("id").alias("n_chars"))
    found = merkle.placed(merkle.leaves_of(docs))
    assert [r["place"] for r in found.orderBy("doc_id").collect()] == list(range(3000))


# --- whitening ---


@pytest.mark.parametrize("kind", ["full", "repeated", "equal", "parted", "tiny", "zero"])
def test_leading_values_and_vectors(kind):
    rng = np.random.default_rng(3)
    d = {"tiny": 2}.get(kind, 40)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"full": rng.random(d), "repeated": np.repeat([5.0, 2.0, 0.5, 0.0], d // 4), "equal": np.ones(d), "parted": np.arange(d, 0, -1.0), "tiny": np.array([1.0, 1e-9]), "zero": np.zeros(d)}[kind]
    a = np.diag(values) if kind == "parted" else turn @ np.diag(values) @ turn.T
    a = (a + a.T) / 2
    found, axes = whitening.leading(a, 32)
    k = min(d, 32)
    want = np.sort(values)[::-1][:k]
    assert np.abs(found - want).max() <= 1e-13 * max(1, want[0]) and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
    assert np.abs(a @ axes - axes * found).max() < 1e-12 * max(1, want[0])


def test_sturm_counts():
    diagonal, beside = np.array([2.0, 1.0, 3.0, 0.0]), np.array([1.0, 0.0, 2.0])
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    at = np.linspace(-3, 6, 41) + 1e-3
    assert (whitening.count_below(diagonal, beside, at) == (values[:, None] < at).sum(axis=0)).all()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_whitening_is_exact_and_white(spark, tmp_path):
    rng = np.random.default_rng(11)
    c = (rng.standard_normal((700, 40)) * np.linspace(1, 3, 40)).astype(np.float32)
    rows = [(k, [float(v) for v in x], 0) for k, x in enumerate(c)]
    bad = [(900, None, 0), (901, [], 0), (902, [None] + [1.0] * 39, 0), (903, [float("nan")] + [1.0] * 39, 0), (904, [float("inf")] * 40, 0), (905, [1.0] * 39, 0), (906, [3e38] * 40, 0)]
    df = vectors(spark, rows + bad + [rows[5], (None, rows[6][1], 0)])
    for k, name in enumerate([*CLASHES, "n", "deviation", "whitened", "component", "vector"]):
        df = df.withColumn(name, F.lit(k))
    df.repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op12_whitening(spark, str(tmp_path)).toPandas()
    x = np.floor(64 * np.vstack([c, c[5:7]]).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    e, axes = np.linalg.eigh(z.T @ z / n)
    e, axes = e[::-1][:32], axes[:, ::-1][:, :32]
    white, far = z @ axes / np.sqrt(e), ((n * x - s) ** 2).sum(axis=1)
    assert len(got) == 702 * 32 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    one = got[got["vec_id"].notna() & (got["vec_id"] != 5)].pivot(index="vec_id", columns="component", values="whitened").sort_index()
    mine = np.delete(white[:700], 5, axis=0)
    assert np.abs(np.abs(one.to_numpy()) - np.abs(mine)).max() < 1e-8
    sign = np.sign((one.to_numpy() * mine).sum(axis=0))
    assert np.abs(one.to_numpy() * sign - mine).max() < 1e-8
    assert dict(zip(got["vec_id"], got["deviation"], strict=True))[17] == far[17] and set(got[got["vec_id"].isna()]["deviation"]) == {far[6]}
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.abs(share - e / np.trace(z.T @ z / n)).max() < 1e-12


def test_whitening_of_flat_and_empty_tables(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(k, [0.5, 0.25], 0) for k in range(5)], [(1, None, 0)]):
        df = whitening.vectors_of(vectors(spark, rows))
        assert whitening.projected(df, whitening.fitted(df)).count() == 0
    df = whitening.vectors_of(vectors(spark, [(k, [0.5 * k, 1.0], 0) for k in range(6)]))  # one of two dimensions is flat
    fit = whitening.fitted(df)
    assert len(fit.values) == 1 and abs(fit.values[0] - np.var(32 * np.arange(6))) < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    df = whitening.vectors_of(vectors(spark, [(0, [1e9, 0.0], 0), (1, [-1e9, 1.0], 0), (2, [1.0, 2.0], 0)]))
    got = {r["vec_id"]: r["deviation"] for r in whitening.projected(df, whitening.fitted(df)).collect()}
    x = [[math.floor(64 * float(np.float32(v))) + 10**6 for v in row] for row in ([1e9, 0.0], [-1e9, 1.0], [1.0, 2.0])]
    s = [sum(col) for col in zip(*x, strict=True)]
    exact = [sum((3 * a - t) ** 2 for a, t in zip(row, s, strict=True)) for row in x]
    assert got == {k: v if v < 2**63 else None for k, v in enumerate(exact)} and None in got.values()


# --- Hamming join ---


def brute_components(texts, percent=85):
    known = [(i, shingles(t)) for i, t in texts]
    sets = list({s for i, s in known if s and i is not None})
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, s in known:
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    own = [(i, len(s), least[find(s)] if s and i is not None else i) for i, s in known]
    return sorted(((i, n, c, i is None or i == c) for i, n, c in own), key=repr)


def near(docs, settings=hamming_dedup.Settings()):
    return rows_of(hamming_dedup.near_duplicates(docs, settings), "doc_id", "n_shingles", "component_id", "kept")


def test_chunks_hold_pairs_at_the_threshold():
    for recall in (0.9, 0.99, 0.9999):
        settings = hamming_dedup.Settings(recall=recall)
        chunks, radius = hamming_dedup.choose_chunks(settings)
        assert radius // chunks <= settings.errors < (radius + 1) / chunks
        rng = np.random.default_rng(1)
        assert (rng.binomial(chunks * settings.slots, 0.15, 200_000) <= radius).mean() >= recall - 1e-3


def test_pairs_within_the_radius_share_a_key():
    """The pigeonhole guarantee, for every way to place errors that a random search finds."""
    import pyarrow as pa

    settings = hamming_dedup.Settings()
    chunks, radius = hamming_dedup.choose_chunks(settings)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**16, (400, chunks * settings.slots), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(len(row), radius, replace=False)] ^= 1
    keys = []
    for x in (a, b):
        batch = pa.RecordBatch.from_pydict({"key": pa.array([b"k"] * 400), "n": pa.array([1] * 400), "signature": pa.array([r.tobytes() for r in x])})
        (out,) = hamming_dedup._keyed(settings)([batch])
        keys.append(out.column("buckets").to_pylist())
    assert all(set(x) & set(y) for x, y in zip(*keys, strict=True))


def test_awkward_rows_by_hamming(awkward, nothing):
    assert near(awkward) == brute_components(awkward_texts())
    assert hamming_dedup.near_duplicates(nothing).count() == 0


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("settings", [hamming_dedup.Settings(), hamming_dedup.Settings(block=8), hamming_dedup.Settings(block_shingles=900, slice_bytes=500)])
def test_components_of_stars_chains_and_crowds(spark, settings):
    rng = random.Random(9)
    texts = []
    for g in range(4):  # a star: copies are near the original and not near each other
        base = sentence(700 + g, 150).split()
        texts += [" ".join(base), *(" ".join(edited(rng, base, rng.randint(1, 2))) for _ in range(25))]
    chain = sentence(800, 150).split()
    for _ in range(25):  # each link is near its neighbours only
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    for g in range(6):  # pairs around the threshold
        base = sentence(820 + g, 100 + g).split()
        texts += [" ".join(base), " ".join(edited(rng, base, g))]
    base = sentence(840, 300).split()
    texts += [" ".join(base[k : k + 200]) for k in range(0, 100, 3)]  # shifted windows
    texts += [t.upper() for t in texts[:40]] + [sentence(860 + k, 3) for k in range(5)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_components(rows)
    assert len({c for _, _, c, _ in want}) < len(texts) / 2
    assert near(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), settings) == want


def test_new_operators_take_extra_columns(spark):
    docs = with_clashes(spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", None, None)], SCHEMA))
    for name in ("n", "group", "place", "leaf", "other", "path", "t1", "signature", "weight", "tied"):
        docs = docs.withColumn(name, F.lit("extra"))
    assert near(docs) == [(1, 2, 1, True), (2, 2, 1, False)]
    assert checked(docs) == brute_manifest(plain(docs))
