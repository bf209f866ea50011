"""Selection of the mix, quality scores and neighbour odds against plain Python over all rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quillgate.llm import mixing, quality, secret_scan

from .conftest import awkward_texts, sentence


def spark_hash(*values):
    """What xxhash64 gives for strings: each value's hash seeds the next; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode(), h)
    return h - (1 << 64) if h >= 1 << 63 else h


# ---------------------------------------------------------------- mixing


def taken_words(rows, settings):
    """``rows`` are (source, size, weight, draw); every source sorted as a whole."""
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    sums = [(s, sum(r[1] for r in rows if r[0] == s)) for s in sources]
    out = {}
    for (source, total), target in zip(sums, mixing.targets(sums, settings), strict=True):
        epochs = math.floor(target / total) if total else 0
        rest, start = target - epochs * total, 0
        mine = [(-math.log(((r[3] % (1 << 64) >> 11) + 0.5) / (1 << 53)) / r[2], r[3], k) for k, r in enumerate(rows) if r[0] == source]
        for _, _, k in sorted(mine):
            size = rows[k][1]
            out[k] = size * (epochs + (size > 0 and start + size / 2 <= rest))
            start += size
    return out


@pytest.mark.parametrize("share,cells", [(1.5, 4096), (0.3, 7), (0.05, 1), (1.0, 64)])
def test_the_mix_takes_what_one_sort_of_each_source_takes(spark, share, cells):
    rng = random.Random(cells)
    docs = [(i, sentence(i, rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    quality_of = {i: rng.choice([0, 1]) for i in range(0, 400, 3)}
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame(list(quality_of.items()), "doc_id bigint, quality int")
    settings = mixing.Settings(share=share, cells=cells)
    draws = {r[0]: r[1] for r in table.select("doc_id", F.xxhash64(F.lit(settings.seed), "doc_id", "text")).collect()}
    weight = {1: settings.good, 0: settings.poor, None: 1.0}
    want = taken_words([(s, len(t.split()), weight[quality_of.get(i)], draws[i]) for i, t, s in docs], settings)
    got = {r["doc_id"]: r["taken"] for r in mixing.mixed(table, labels, settings).collect()}
    assert got == want and 0 < sum(got.values())


# ---------------------------------------------------------------- quality


def grams_of(text, buckets):
    words = (text or "").split()
    return [spark_hash(w) % buckets for w in words] + [spark_hash(a, b) % buckets for a, b in zip(words, words[1:])]


def test_quality_scores_are_mean_log_ratios(spark):
    texts = [(i, t) for i, t in awkward_texts() if t is None or "　" not in t]  # str.split takes wide spaces too
    texts += [(100 + i, sentence(i % 7, 60) + " " + sentence(i, 30)) for i in range(60)]
    labelled = [(0, 1), (1, 1), (1, 0), (8, 1), (13, 1), (4, 1), (777, 1), (None, 1), (3, None)] + [(100 + i, i % 2) for i in range(40)]
    settings = quality.Settings(buckets=512)
    worst = {}
    for i, q in labelled:
        if i is not None and q is not None:
            worst[i] = min(q, worst.get(i, q))
    raw, good = Counter(), Counter()
    for i, t in texts:
        grams = grams_of(t, settings.buckets)
        raw.update(grams)
        if worst.get(i) == 1:
            good.update(grams)
    scale, s = sum(good.values()) / sum(raw.values()), settings.smoothing
    want = Counter()
    for i, t in texts:
        grams = grams_of(t, settings.buckets)
        score = sum(math.log((good[g] + s) / (raw[g] * scale + s)) for g in grams) / len(grams) if grams else None
        words = (t or "").split()
        threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = Counter(threes)
        covered = {k + j for k, g in enumerate(threes) if twice[g] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        kept = not failed and score is not None and score >= settings.threshold
        want[(i, None if score is None else round(score, 9) + 0.0, failed, kept)] += 1
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    out = quality.judged(docs, spark.createDataFrame(labelled, "doc_id bigint, quality int"), settings).collect()
    got = Counter((r["doc_id"], None if r["score"] is None else round(r["score"], 9) + 0.0, r["base_failed"], r["kept"]) for r in out)
    assert got == want and len({k[3] for k in got}) == 2


# ---------------------------------------------------------------- secret scan


def findings(spark):
    """Neighbours that few findings share, copies of documents under other ids, and documents without a path."""
    rng, rows = random.Random(5), []
    for i in range(120):
        true = rng.random() < 0.5
        value = f'token="{rng.getrandbits(160):040x}"' if true else f"{10**15 + rng.randrange(10**12)}"
        text = f"{sentence(i, 4)} {value} {rng.choice(['end', 'stop', f'only{i}'])} {sentence(900 + i, 3)}"
        rows += [(1000 * k + i, text, rng.choice(["x", "y", None])) for k in range(1 + (i % 5 == 0))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_odds_leave_a_findings_own_fold_out(spark):
    docs, settings = findings(spark), secret_scan.Settings(folds=5)
    found = secret_scan.candidates(docs, settings).cache()
    known = secret_scan.pattern_labels(found).where("doc_id % 4 > 0").cache()
    got = {(r["row"], r["at"], r["doc_id"]): (r["path_odds"], r["right_odds"]) for r in secret_scan.features(found, docs, known, settings).collect()}
    label = {(r["row"], r["at"]): r["label"] for r in known.collect()}
    rows = found.withColumn("fold", F.pmod(F.xxhash64(F.lit(settings.seed), "bare"), F.lit(5))).collect()
    told = [(r, label[(r["row"], r["at"])]) for r in rows if (r["row"], r["at"]) in label]
    a, n_true = settings.smoothing, sum(x for _, x in told)
    base = (n_true + a) / (len(told) - n_true + a)
    by = {c: defaultdict(list) for c in ("path", "right1")}
    for r, x in told:
        for c in by:
            by[c][r[c]].append((r["fold"], x))

    def odds(r, c):
        if r[c] is None or r[c] not in by[c]:
            return 0.0
        mine = (r["row"], r["at"]) in label
        others = [x for f, x in by[c][r[c]] if not (mine and f == r["fold"])]
        return math.log((sum(others) + a * base) / (len(others) - sum(others) + a) / base)

    assert len(got) == len(rows) > 140 and 0 < n_true < len(told) < len(rows)
    for r in rows:
        assert got[(r["row"], r["at"], r["doc_id"])] == pytest.approx((odds(r, "path"), odds(r, "right1")), abs=1e-9)
    # a neighbour that stands beside one value alone says nothing about it, copied or not
    lone = [r for r, _ in told if r["right1"].startswith("only")]
    assert lone and all(got[(r["row"], r["at"], r["doc_id"])][1] == pytest.approx(0.0) for r in lone)
