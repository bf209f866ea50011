"""Line dedup, substring dedup, decontamination and quality features against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillgate.llm import decontaminate, line_dedup, quality, substring_dedup

from .conftest import awkward_texts, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def table_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_lines(texts, least_docs):
    docs_of = defaultdict(set)
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    for i, t in texts:
        for line in (t or "").split("\n"):
            docs_of[key(line)].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(docs_of[key(x)]) >= least_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_common_lines_go_from_all_documents(spark, awkward):
    settings = line_dedup.Settings(least_docs=2)
    out = line_dedup.drop_common_lines(awkward, settings)
    got = out.select(F.col("whole.doc_id"), "n_lines", "n_dropped", "kept_text")
    assert table_of(got) == brute_lines(awkward_texts(), 2)
    assert table_of(out.select("whole.hub", "whole.h1").distinct()) == table_of(awkward.select("hub", "h1").distinct())


def test_runs_give_the_same_counts_for_any_batching(spark):
    texts = [(i, "\n".join(f"Line {j}" for j in range(0, 40, 1 + i % 5))) for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for batches, fan_in in ((1, 2), (7, 3)):
        settings = line_dedup.Settings(least_docs=10, batches=batches, fan_in=fan_in)
        got = line_dedup.drop_common_lines(docs, settings).select(F.col("whole.doc_id"), "n_lines", "n_dropped", "kept_text")
        assert table_of(got) == brute_lines(texts, 10)


def brute_windows(texts, n):
    first = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                g = tuple(w[k : k + n])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in texts:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                keep[k : k + n] = [False] * n
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=repr)


def test_windows_of_earlier_documents_are_removed(awkward):
    out = substring_dedup.without_repeats(awkward)
    assert table_of(out.select("doc_id", "n_words", "n_removed", "kept_text")) == brute_windows(awkward_texts(), 50)
    for r in out.collect():
        assert sum(x["to"] - x["from"] for x in r["removed"]) == r["n_removed"]
        assert all(a["to"] < b["from"] for a, b in zip(r["removed"], r["removed"][1:], strict=False))


def test_windows_inside_edited_copies(spark):
    """Shared stretches of any length and place, so that runs match in part only."""
    parts = [sentence(100 + k, 7 + 5 * k) for k in range(6)]
    texts = [(i, " ".join(parts[(i * k + k) % 6] for k in range(1, 7)) + f" end{i}") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for window, anchor in ((12, 4), (20, 10)):
        got = substring_dedup.without_repeats(docs, substring_dedup.Settings(window=window, anchor=anchor))
        assert table_of(got.select("doc_id", "n_words", "n_removed", "kept_text")) == brute_windows(texts, window)


def bench_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER)) if w]


def brute_hits(texts, items, n=10):
    grams = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        for k in range(max(len(w) - n + 1, 1) if w else 0):
            grams[tuple(w[k : k + n])].add(i)
    lengths = {len(g) for g in grams}
    out = []
    for i, t in texts:
        w, hit, found = bench_words(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in grams:
                    hit |= set(range(k, k + m))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def test_benchmark_windows_are_found(spark, awkward):
    texts = dict(awkward_texts())
    items = [
        (1, " ".join(texts[8].split()[25:45])), (2, "ONE, two!"), (2, sentence(50, 12)), (3, None), (4, ""), (5, " ".join(texts[10].split()[:10])),
        (None, " ".join(texts[10].split()[20:31])), (6, "zzzz " + " ".join(texts[8].split()[30:38])), (7, "a b"),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("phrase", F.lit(1))
    got = decontaminate.decontamination_report(awkward, bench).select("doc_id", "n_words", "n_hit", "n_items", "items")
    assert table_of(got) == brute_hits(awkward_texts(), items)
    clean = decontaminate.clean_documents(awkward, bench)
    assert clean.columns == awkward.columns
    want = sorted((i for (i, *_), hit in zip(brute_hits(awkward_texts(), items), [r[2] for r in brute_hits(awkward_texts(), items)], strict=True) if not hit), key=repr)
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == want


def test_equal_contaminated_rows_are_all_found(spark):
    passage = sentence(60, 20)
    dirty = sentence(61, 30) + " " + passage + " " + sentence(62, 5)
    texts = [(1, dirty)] * 3 + [(2, dirty), (None, dirty), (None, dirty), (3, sentence(63, 40)), (3, sentence(63, 40))]
    items = [(1, passage), (2, " ".join(passage.split()[:1]))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontamination_report(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items")
    assert table_of(got) == brute_hits(texts, items)
    assert [r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()] == [3, 3]


def test_proximity_allows_a_slip(spark):
    docs = spark.createDataFrame([(1, "red x green blue"), (2, "red green blue"), (3, "red x y z green"), (4, "green red")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "red green")], "item_id bigint, text string")
    phrases = decontaminate.phrases_of(items)
    index = decontaminate.build_index(docs, phrases)
    anchors = decontaminate.anchors_of(phrases, index)
    key = docs.select("doc_id", decontaminate.row_key().alias("doc"))
    near = lambda s: sorted(r["doc_id"] for r in decontaminate.proximity_matches(index, anchors, s).join(key, "doc").select("doc_id").distinct().collect())
    assert sorted(r["doc_id"] for r in decontaminate.exact_matches(index, anchors).join(key, "doc").collect()) == [2]
    assert near(0) == [2]
    assert near(1) == [1, 2]
    assert near(3) == [1, 2, 3, 4]


def brute_features(text):
    w = words(text)
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), failed


def test_base_features(awkward):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.base_features(awkward).select("doc_id", *names)
    assert table_of(got) == sorted(((i, *brute_features(t)) for i, t in awkward_texts()), key=repr)


def test_ratio_parts_trusted_from_junk(spark):
    good = [(i, " ".join(sentence(200 + (i * 7 + k) % 9, 12) for k in range(8)) + f" doc{i}") for i in range(40)]
    junk = [(100 + i, " ".join(w + "###" for w in good[i][1].split())) for i in range(10)]
    docs = spark.createDataFrame(good + junk, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100, 0)], "doc_id bigint, quality int")
    out = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert all(out[i]["kept"] for i, _ in good)
    assert not any(out[i]["kept"] for i, _ in junk)


def test_quality_of_awkward_rows(awkward, labels):
    rows = quality.judged(awkward, labels).collect()
    assert len(rows) == len(awkward_texts())
    assert all(not r["kept"] for r in rows if r["n_words"] < 50)
    assert all(r["score"] is None for r in rows if r["n_words"] == 0)


def test_empty_tables(spark, nothing, labels):
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert line_dedup.drop_common_lines(nothing).count() == 0
    assert substring_dedup.without_repeats(nothing).count() == 0
    assert decontaminate.decontamination_report(nothing, no_items).count() == 0
    assert quality.judged(nothing, labels.limit(0)).count() == 0


def test_no_items_leave_documents_alone(spark, awkward):
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    rows = decontaminate.decontamination_report(awkward, no_items).collect()
    assert len(rows) == len(awkward_texts()) and not any(r["n_hit"] for r in rows)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
