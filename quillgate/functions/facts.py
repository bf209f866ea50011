"""Facts of a text: conclusion polarity, key values and dates; drift between two fact sets.

A fact set is ``struct<polarity, value, date>`` of sorted distinct string arrays.
The facts of several answers are read in one pass by joining the answers with a
character no pattern can match (``pool_text``), so a pool needs neither an explode nor
a shuffle.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions.text import JOINER, SPACE_CLASS, as_col, bind, fold_joined, is_blank, length_groups, nfkc, stripped, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

_S = SPACE_CLASS


@dataclass(frozen=True)
class FactPack:
    """Patterns and terms; the defaults are fixed values, in order."""

    polarity: tuple[str, ...] = (
        "免征", "免税", "不征税", "应缴", "应纳税", "需缴纳", "不得", "不可以", "无需", "不需要",
        "可以", "允许", "禁止", "超过", "不超过", "属于", "不属于",
    )
    date: str = rf"\d{{4}}{_S}*年(?:{_S}*\d{{1,2}}{_S}*月)?(?:{_S}*\d{{1,2}}{_S}*日)?"
    values: tuple[str, ...] = (
        rf"\d+(?:\.\d+)?{_S}*%",
        r"万分之[零一二三四五六七八九十百点\d]+|千分之[零一二三四五六七八九十百点\d]+",
        rf"\d[\d,]*(?:\.\d+)?{_S}*(?:万元|亿元|万|亿|元)",
        rf"\d+{_S}*(?:个)?(?:日|天|个月|月|年|季度)",
    )
    units: tuple[tuple[str, str], ...] = (("万元", "万"), ("亿元", "亿"))


ZH_FACTS = FactPack()


def _overlaps(a: str, b: str) -> bool:
    """Can an occurrence of ``a`` share a character with an occurrence of ``b``?"""
    if a in b or b in a:
        return True
    longest = min(len(a), len(b))
    return any(a[-n:] == b[:n] or b[-n:] == a[:n] for n in range(1, longest))


def masking_plan(terms: tuple[str, ...]) -> list[tuple[str, list[str]]]:
    """For each term, longest first, the earlier terms whose hits must be masked before it.

    Terms that cannot share a character with a term never change its hits, so most
    terms need no masking at all and cost a single substring search.
    """
    ordered = sorted(terms, key=len, reverse=True)
    plan: list[tuple[str, list[str]]] = []
    for i, term in enumerate(ordered):
        needed: set[str] = set()
        frontier = [term]
        while frontier:
            current = frontier.pop()
            for earlier in ordered[: ordered.index(current)]:
                if earlier not in needed and _overlaps(earlier, current):
                    needed.add(earlier)
                    frontier.append(earlier)
        plan.append((term, [t for t in ordered[:i] if t in needed]))
    return plan


def polarity_terms(text: Column, terms: tuple[str, ...] = ZH_FACTS.polarity) -> Column:
    """Terms found longest first, each hit masked before the shorter terms are looked for."""
    hits = []
    for term, masks in masking_plan(terms):
        masked = reduce(lambda t, m: F.replace(t, F.lit(m), F.lit("　")), masks, text)
        # Masking only takes hits away.
        hits.append(F.when(F.contains(text, F.lit(term)) & F.contains(masked, F.lit(term)), F.lit(term)))
    return F.sort_array(F.array_compact(F.array(*hits)))


def _compact(items: Column, pattern: str) -> Column:
    return F.transform(items, lambda x: F.regexp_replace(x, pattern, ""))


KINDS = ("polarity", "value", "date")


def no_facts() -> Column:
    return F.struct(*[F.array().cast("array<string>").alias(k) for k in KINDS])


def _same_in_both_engines(pack: FactPack) -> bool:
    """Only digits, spaces, dots and code points are escaped, nothing is negated: Java and Python read
    such patterns alike, and none matches across ``_ROW``."""
    plain = r"(?:\\(?:[ds.]|x[0-9a-f]{2})|\(\?:|\((?!\?)|\[(?!\^)|[^\\(\[.^$])*"
    return all(re.fullmatch(plain, p) and "&&" not in p for p in (pack.date, *pack.values))


_ROW = "\ue004"  # private use, stands between the texts of a batch
_MARKS = re.compile(r"[\s,]+")
_GAPS = re.compile(r"\s+")


def _led(pattern: str) -> re.Pattern:
    """Compiled with its first digit alone, which lets the engine skip to digits."""
    once = re.sub(r"^\\d\+", r"\\d\\d*", pattern)
    return re.compile(re.sub(r"^\\d\{(\d+)\}", lambda m: rf"\d\d{{{int(m[1]) - 1}}}", once))


def _rows_of(places: list[int], joined: str) -> np.ndarray:
    """Which of the texts that are joined by ``_ROW`` stands at each place."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.searchsorted(np.flatnonzero(points == ord(_ROW)), np.array(places, dtype=np.int64))


def _join(texts: pa.Array) -> str:
    """The texts, none of them null, joined by ``_ROW``; a text's own ``_ROW`` is as strange to every
    pattern as the joiner is."""
    own = pc.replace_substring(texts, _ROW, JOINER)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), _ROW)[0].as_py()


def _found(patterns: list[re.Pattern], joined: str) -> tuple[list[int], list[str]]:
    """Place and text of all hits."""
    at, found = [], []
    for p in patterns:
        for m in p.finditer(joined):
            at.append(m.start())
            found.append(m.group())
    return at, found


def _without(joined: str, at: list[int], found: list[str]) -> str:
    """A space in the place of each hit of one pattern."""
    starts = [0, *map(int.__add__, at, map(len, found))]
    return " ".join(map(joined.__getitem__, map(slice, starts, [*at, len(joined)])))


def _hits(at: list[int], found: list[str], joined: str, squeeze) -> tuple[np.ndarray, pa.Array]:
    """Row and text of hits in texts that are joined by ``_ROW``."""
    if not found:
        return np.zeros(0, dtype=np.int64), pa.array([], pa.string())
    return _rows_of(at, joined), pa.array(squeeze(_ROW.join(found)).split(_ROW), pa.string())


def _lists(n: int, rows: np.ndarray, texts: pa.Array) -> pa.Array:
    """Sorted distinct texts of each of ``n`` rows."""
    coded = texts.dictionary_encode()
    words = sorted(coded.dictionary.to_pylist())
    rank = {w: i for i, w in enumerate(words)}
    place = np.array([rank[w] for w in coded.dictionary.to_pylist()], dtype=np.int64)
    width = max(1, len(words))
    keys = np.unique(rows * width + place[coded.indices.to_numpy()]) if len(texts) else np.zeros(0, dtype=np.int64)
    offsets = np.searchsorted(keys // width, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(words, pa.string()).take(pa.array(keys % width)))


def _polarity_hits(joined: str, plan: list[tuple[str, list[str]]]) -> tuple[np.ndarray, pa.Array]:
    """Row and term of all hits in texts that are joined by ``_ROW``; a mask is as long as what it hides."""
    places, terms = [], []
    for i, (term, masks) in enumerate(plan):
        if term not in joined:  # masking only takes hits away
            continue
        masked = reduce(lambda t, m: t.replace(m, "　" * len(m)), masks, joined)
        at = masked.find(term)
        while at >= 0:
            places.append(at)
            terms.append(i)
            at = masked.find(term, at + max(1, len(term)))
    words = pa.array([term for term, _ in plan], pa.string())
    return _rows_of(places, joined), words.take(pa.array(terms, pa.int64()))


def _read_by_arrow(text: Column, pack: FactPack, normalise: bool, kinds: tuple[str, ...], listed: bool) -> Column:
    plan, date, values, units = masking_plan(pack.polarity), _led(pack.date), [_led(p) for p in pack.values], pack.units

    def clean(found: str) -> str:
        return reduce(lambda t, u: t.replace(*u), units, _MARKS.sub("", found))

    def read(texts: pa.Array) -> pa.Array:
        joined = _join(texts)
        joined = fold_joined(joined, _ROW) if normalise else joined
        n, hits = len(texts), {}
        if "polarity" in kinds:
            hits["polarity"] = _polarity_hits(joined, plan)
        if "value" in kinds or "date" in kinds:
            dates = _found([date], joined)
            hits["date"] = _hits(*dates, joined, lambda t: _GAPS.sub("", t))
        if "value" in kinds:
            masked = _without(joined, *dates)
            hits["value"] = _hits(*_found(values, masked), masked, clean)
        if not listed:
            return pa.StructArray.from_arrays([_lists(n, *hits[k]) for k in kinds], names=list(kinds))
        marked = [pc.binary_join_element_wise(_MARK_OF[k], hits[k][1], "") for k in kinds]
        return _lists(n, np.concatenate([hits[k][0] for k in kinds]), pa.concat_arrays(marked))

    kind = pa.list_(pa.string()) if listed else pa.struct([(k, pa.list_(pa.string())) for k in kinds])

    @F.arrow_udf("array<string>" if listed else f"struct<{','.join(f'{k}:array<string>' for k in kinds)}>")
    def facts_of(texts: pa.Array) -> pa.Array:
        lengths = pc.utf8_length(texts).to_pylist()
        parts = [read(texts.slice(lo, hi - lo)) for lo, hi in length_groups(lengths)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return facts_of(text)


def extract_facts(text: Column | str, pack: FactPack = ZH_FACTS, normalise: bool = True,
                  kinds: tuple[str, ...] = KINDS) -> Column:
    """Facts of a text.  Dates are masked first so that durations cannot reuse their parts.

    With ``normalise=False`` the caller has already applied ``nfkc`` (as a column of its own).
    Texts are folded and read in one Arrow pass; a pack whose patterns only Java reads is
    evaluated in the JVM.  A caller that compares some ``kinds`` only gets a struct of these;
    the patterns of the others are not tried.
    """
    if _same_in_both_engines(pack):
        return _read_by_arrow(text_or_empty(text), pack, normalise, kinds, False)
    norm = nfkc(text) if normalise else as_col(text)
    date = "(?U)" + pack.date

    def clean(x: Column) -> Column:
        bare = F.regexp_replace(x, f"(?U)(?:{_S}|,)+", "")
        return reduce(lambda t, u: F.replace(t, F.lit(u[0]), F.lit(u[1])), pack.units, bare)

    def values_of(masked: Column) -> Column:
        found = F.concat(*[F.regexp_extract_all(masked, F.lit("(?U)" + p), F.lit(0)) for p in pack.values])
        return F.sort_array(F.array_distinct(F.transform(found, clean)))

    def facts_of(plain: Column) -> Column:
        dates = _compact(F.regexp_extract_all(plain, F.lit(date), F.lit(0)), f"(?U){_S}+")
        found = {
            "polarity": polarity_terms(plain, pack.polarity),
            "value": bind(F.regexp_replace(plain, date, " "), values_of),
            "date": F.sort_array(F.array_distinct(dates)),
        }
        return F.struct(*[found[k].alias(k) for k in kinds])

    return bind(norm, facts_of)


# In a list of the facts of all kinds each starts with the digit of its kind.
_MARK_OF = {k: str(i) for i, k in enumerate(KINDS)}


def listed_facts(text: Column | str, pack: FactPack = ZH_FACTS, kinds: tuple[str, ...] = KINDS) -> Column:
    """The facts of a text as one sorted list of marked texts, cheaper to explode and collect than a struct."""
    if _same_in_both_engines(pack):
        return _read_by_arrow(text_or_empty(text), pack, True, kinds, True)

    def of(f: Column, kind: str) -> Column:
        return F.transform(f[kind], lambda x: F.concat(F.lit(_MARK_OF[kind]), x))

    def marked(f: Column) -> Column:
        return F.concat(*[of(f, k) for k in kinds])

    return bind(extract_facts(text, pack, kinds=kinds), marked)


def facts_of_list(listed: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The struct of a list of marked facts; each kind keeps the list's order."""

    def of(kind: str) -> Column:
        own = F.filter(listed, lambda x: F.startswith(x, F.lit(_MARK_OF[kind])))
        return F.transform(own, lambda x: F.substring(x, 2, 2147483647))

    return F.struct(*[of(k).alias(k) for k in kinds])


def pool_text(answers: Column | str) -> Column:
    """All answers of a pool as one text, for a single extraction pass."""
    return F.concat_ws(JOINER, F.coalesce(as_col(answers), F.array().cast("array<string>")))


def all_facts(facts: Column) -> Column:
    return F.sort_array(F.array_union(F.array_union(facts["polarity"], facts["value"]), facts["date"]))


def has_facts(facts: Column) -> Column:
    return (F.size(facts["polarity"]) + F.size(facts["value"]) + F.size(facts["date"])) > 0


def date_covered(date: Column, pool_dates: Column) -> Column:
    """A date counts as known when either side is a coarser spelling of the other."""
    return F.exists(pool_dates, lambda p: F.startswith(date, p) | F.startswith(p, date))


def drift_facts(model: Column, pool: Column) -> Column:
    fresh_dates = F.filter(model["date"], lambda d: ~date_covered(d, pool["date"]))
    return F.sort_array(
        F.concat(
            F.array_except(model["polarity"], pool["polarity"]),
            F.array_except(model["value"], pool["value"]),
            fresh_dates,
        )
    )


def pool_verdict(answer: Column | str, model: Column, pool: Column, fields: tuple[str, ...] | None = None) -> Column:
    """Does an answer stay inside the facts of its pool?

    A struct of all results, or of ``fields`` only: what is not asked for is not computed.

    ``in_pool`` is also reported for answers that cannot be compared; ``comparable``
    tells the two cases apart.  A blank answer is never in the pool.
    """
    known = F.struct(
        is_blank(answer).alias("empty"),
        model.alias("model"),
        pool.alias("pool"),
    )

    def judged(x: Column) -> Column:
        empty, in_model, in_pool_side = x["empty"], has_facts(x["model"]), has_facts(x["pool"])
        inside = ~empty & (F.size(x["drift"]) == 0)
        reason = (
            F.when(empty, "empty_answer")
            .when(~in_model, F.when(in_pool_side, "no_comparable_facts").otherwise("no_facts_in_either"))
            .when(~in_pool_side, "v1_pool_has_no_facts")
            .when(~inside, "introduced_new_fact")
            .otherwise("ok")
        )
        told = {
            "in_pool": inside,
            "comparable": empty | (in_model & in_pool_side),
            "reason": reason,
            "drift_facts": x["drift"],
            "model_facts": all_facts(x["model"]),
            "pool_facts": all_facts(x["pool"]),
            "pool_size": F.size(all_facts(x["pool"])),
        }
        return F.struct(*[told[f].alias(f) for f in fields or told])

    with_drift = bind(
        known,
        lambda x: F.struct(
            x["empty"].alias("empty"), x["model"].alias("model"), x["pool"].alias("pool"),
            drift_facts(x["model"], x["pool"]).alias("drift"),
        ),
    )
    return bind(with_drift, judged)


def merged_pool(canonical: Column | str, gold: Column | str, samples: Column | str) -> Column:
    """Ordered distinct answers: canonical, gold, then samples; stripped, blanks dropped."""
    raw = F.concat(
        F.array(as_col(canonical), as_col(gold)),
        F.coalesce(as_col(samples), F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(F.transform(raw, stripped), lambda x: x != ""))


def pool_is_trainable(pool_facts: Column) -> Column:
    """Some answer of the pool must carry a fact, or there is nothing to compare against."""
    return has_facts(pool_facts)


# The labels of the three anchor lines.
ANCHOR_LABELS = (
    ("polarity", "结论方向（只能落在这些极性上、不得相反）："),
    ("value", "可用的关键数字/金额/比例（只能用这些、不得新增）："),
    ("date", "涉及日期/期限："),
)


def anchor_text(facts: Column) -> Column:
    """Labelled, sorted, joined facts of a pool; empty string when it has none."""
    lines = [
        F.when(F.size(facts[kind]) > 0, F.concat(F.lit(label), F.array_join(facts[kind], "、")))
        for kind, label in ANCHOR_LABELS
    ]
    return F.concat_ws("\n", *lines)
