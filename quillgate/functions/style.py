"""Surface traces of a retrieval tone in a reasoning text.

``has_trace`` is the cheap yes/no gate.  ``trace_spans`` lists the hits and is only
evaluated for rows that have one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions.text import SENTENCE_ENDS, SPACE_CLASS, SPACES, bind, contains_any, strip, text_or_empty

_S = SPACE_CLASS


@dataclass(frozen=True)
class Category:
    name: str
    patterns: tuple[str, ...]
    ignore_case: bool = False
    # A cheap pattern every hit must contain; spares the costly patterns on most rows.
    must_contain: str | None = None
    # Texts one of which every hit contains.  With them in all categories, and in the label of
    # the list, a text without any is settled by one search.
    words: tuple[str, ...] | None = None

    @property
    def flags(self) -> str:
        return "(?iU)" if self.ignore_case else "(?U)"

    @property
    def joined(self) -> str:
        """Any pattern of the category."""
        return "|".join(f"(?:{p})" for p in self.patterns)


@dataclass(frozen=True)
class ListDump:
    """When does naming documents count as dumping a list instead of reasoning?"""

    name: str
    document: str
    label: str
    form_name: str
    reasoning_word: str
    must_contain: str
    per_sentence: int = 3
    reported: int = 8
    # Texts one of which every label contains.
    label_words: tuple[str, ...] | None = None


@dataclass(frozen=True)
class StylePack:
    categories: tuple[Category, ...]
    list_dump: ListDump | None = None


# Pattern lists, in order.
ZH_STYLE = StylePack(
    categories=(
        Category("A_检索装置腔", (
            r"参考问答对", r"参考资料", r"参考内容", r"检索结果", r"资料(?:显示|表明|指出)",
            r"原始(?:问答对|资料|回答)", r"根据(?:检索|参考|提供的资料|上述资料|以上资料)",
            r"如(?:上|前)(?:文|述|参考|资料|所示)", r"对照(?:参考|资料|问答)",
        ), words=("参考", "检索", "资料", "原始", "如上", "如前", "对照")),
        Category("B_编号引用", (
            rf"问答对{_S}*[0-9一二三四五六七八九十]", rf"问题{_S}*\d+{_S}*[:：]", rf"回答{_S}*[:：]",
            rf"第{_S}*[0-9一二三四五六七八九十]{_S}*个?参考", r"(?:逐条|依次|分别)(?:对照|参考|归纳)",
        ), words=("问答对", "问题", "回答", "参考", "逐条", "依次", "分别")),
        Category("C_客服话术", (
            r"小贴士", r"温馨提(?:示|醒)", r"参考下图", r"如下图", r"您可以参考", r"哦[~～]", r"亲[，,~～]",
        ), words=("小贴士", "温馨提", "下图", "您可以参考", "哦", "亲")),
        Category("D_图床附件", (
            r"<img\b", r"https?://\S*(?:aliyuncs|oss-|servu)\S*",
            r"\b\S+\.(?:png|jpe?g|xlsx?|pdf)(?![a-z0-9])",
        ), ignore_case=True, must_contain=r"<img|https?://|\.(?:png|jpe?g|xlsx?|pdf)", words=("<img", "http", ".png", ".jp", ".xls", ".pdf")),
    ),
    list_dump=ListDump(
        name="D_清单式甩文号",
        document=(
            r"(?:《[^》]{2,80}》(?:第[一二三四五六七八九十百千万\d]+条)?"
            rf"|[^\s\x1c-\x1f，。；、]{{0,12}}[财税会发函公告令]{_S}*[〔\[\(（]?\d{{4}}[〕\]\)）]?{_S}*\d+{_S}*号"
            rf"|[^\s\x1c-\x1f，。；、]{{0,16}}(?:公告|令){_S}*(?:\d{{4}}{_S}*年)?{_S}*第?{_S}*\d+{_S}*号)"
        ),
        label=rf"(?md)^{_S}*(?:政策依据|参考文件|参考法规|文件依据){_S}*[:：]",
        form_name=r"《[^》]{1,80}(?:表|单|凭证)》",
        reasoning_word=(
            "规定|按照|明确|适用|应当|可以|不得|免征|征收|处理|确认|扣除|申报|"
            "判断|区分|属于|不属于|满足|导致|计算|缴纳|计入|结转|抵扣|"
            "依据|由于|若|如果|因此|所以|意味着|对应|决定|需要|无需|涉及|"
            "享受|选择|采用|执行|发生|取得|提供|销售|转让|出租|支付|收到"
        ),
        must_contain="[《号]",
        label_words=("政策依据", "参考文件", "参考法规", "文件依据"),
    ),
)


def trigger(pack: StylePack) -> str | None:
    """One linear-time pattern that every text with a trace contains; None when the pack does not tell."""
    rule = pack.list_dump
    if any(c.words is None for c in pack.categories) or (rule and rule.label_words is None):
        return None
    plain = [re.escape(w) for c in pack.categories if not c.ignore_case for w in c.words]
    folded = [re.escape(w) for c in pack.categories if c.ignore_case for w in c.words]
    if rule:
        plain += [re.escape(w) for w in rule.label_words] + [f"(?:{rule.must_contain})"]
    ways = list(dict.fromkeys(plain)) + ([f"(?i:{'|'.join(folded)})"] if folded else [])
    return "|".join(ways) or None


def may_have_trace(text: Column, pack: StylePack) -> Column:
    """False only for texts without a trace."""
    pattern = trigger(pack)
    return F.lit(True) if pattern is None else contains_any(text, pattern)


def category_hit(text: Column, category: Category) -> Column:
    hit = text.rlike(category.flags + category.joined)
    if category.must_contain:
        hit = text.rlike(category.flags + category.must_contain) & hit
    if category.words and not category.ignore_case:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in category.words]) & hit
    return hit


def standalone_documents(text: Column, rule: ListDump) -> Column:
    """Document names of sentences that only list them: no reasoning word, or too many at once."""
    # A sentence without what every document contains names none.
    naming = F.filter(F.split(text, SENTENCE_ENDS), lambda s: s.rlike(rule.must_contain))
    reduced = F.transform(naming, lambda s: F.regexp_replace(strip(s), "(?U)" + rule.form_name, ""))
    per_sentence = F.transform(
        reduced,
        lambda s: F.struct(
            F.regexp_extract_all(s, F.lit("(?U)" + rule.document), F.lit(0)).alias("docs"),
            s.rlike(rule.reasoning_word).alias("reasons"),
        ),
    )
    listing = F.filter(per_sentence, lambda x: ~x["reasons"] | (F.size(x["docs"]) >= rule.per_sentence))
    docs = F.flatten(F.transform(listing, lambda x: x["docs"]))
    return F.when(text.rlike(rule.must_contain), docs).otherwise(F.array().cast("array<string>"))


def list_dump_hit(text: Column, rule: ListDump) -> Column:
    return text.rlike("(?U)" + rule.label) | (F.size(standalone_documents(text, rule)) >= rule.per_sentence)


def has_trace(value: Column | str, pack: StylePack = ZH_STYLE) -> Column:
    """True when any category hits or documents are dumped as a list."""

    def any_hit(text: Column) -> Column:
        tests = [category_hit(text, c) for c in pack.categories]
        if pack.list_dump:
            tests.append(list_dump_hit(text, pack.list_dump))
        return reduce(lambda a, b: a | b, tests)

    text = text_or_empty(value)
    return may_have_trace(text, pack) & bind(text, any_hit)


# ---------------------------------------------------------------- spans
#
# The report is one SQL expression with its intermediate results bound by one-element
# ``transform`` calls, so each is computed once per row.  A text without the trigger of
# the pack is searched once; else every category and pattern is gated by its own yes/no test.

# Private-use fences put around hits; the same characters in a text are replaced first.
_OPEN, _CLOSE, _PLAIN = "\ue001", "\ue002", "\ue003"
_SPAN = "array<struct<lo:int,hi:int,text:string,type:string>>"
_NO_SPANS = f"cast(array() as {_SPAN})"
_NO_TEXTS = "cast(array() as array<string>)"


def _lead(pattern: str) -> str:
    """Plain text that every match of a pattern begins with; empty when the pattern does not tell."""
    if re.search(r"\\[()|]|\[[^\]]*[()|]", pattern) or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    plain = re.match(r"[^\\.\[\](){}|*+?^$]*", pattern).group()
    return plain[:-1] if pattern[len(plain):][:1] in tuple("*+?{") else plain


def _holds(text: str) -> str:
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"contains(t, '{quoted}')"


def _strip_sql(text: str) -> str:
    return f"trim(BOTH '{SPACES}' FROM {text})"


def _pattern_spans(pattern: str, category: Category) -> str:
    """All hits of one pattern in ``t`` with character offsets.

    Splitting at the fences leaves the hits at the odd places; running lengths give the
    offsets.
    """
    exact = f"r'{category.flags}(?:{pattern})'"
    fenced = f"regexp_replace(t, {exact}, '{_OPEN}$0{_CLOSE}')"
    span = (
        f"named_struct('lo', a.pos, 'hi', a.pos + char_length(piece), 'text', piece, 'type', '{category.name}')"
    )
    spans = (
        f"aggregate(split({fenced}, '[{_OPEN}{_CLOSE}]', -1), "
        f"named_struct('pos', 0, 'hit', false, 'spans', {_NO_SPANS}), "
        "(a, piece) -> named_struct('pos', a.pos + char_length(piece), 'hit', NOT a.hit, "
        f"'spans', if(a.hit, array_append(a.spans, {span}), a.spans))).spans"
    )
    test = f"t rlike {exact}"
    if not category.ignore_case and (lead := _lead(pattern)):
        test = _holds(lead) if lead == pattern else f"{_holds(lead)} AND {test}"
    return f"if({test}, {spans}, {_NO_SPANS})"


def _category_spans(category: Category) -> str:
    """Hits of one category, each place once, without those inside a longer hit.

    With hits ordered by start, longer first, a hit repeats or lies inside an earlier one
    exactly when an earlier hit ends no sooner: one pass with the furthest end so far.
    """
    found = [_pattern_spans(p, category) for p in category.patterns]
    if len(found) == 1:
        return found[0]
    ordered = "array_sort(transform(c, s -> named_struct('lo', s.lo, 'back', -s.hi, 'text', s.text)))"
    kept = f"named_struct('lo', s.lo, 'hi', -s.back, 'text', s.text, 'type', '{category.name}')"
    outer = (
        f"aggregate({ordered}, named_struct('reach', -1, 'spans', {_NO_SPANS}), "
        "(a, s) -> named_struct('reach', greatest(a.reach, -s.back), "
        f"'spans', if(-s.back > a.reach, array_append(a.spans, {kept}), a.spans))).spans"
    )
    return _bind("c", f"concat({', '.join(found)})", f"if(size(c) < 2, c, {outer})")


def _gated_spans(category: Category, rank: int) -> str:
    test = f"t rlike r'{category.flags}{category.joined}'"
    if category.words and not category.ignore_case:
        # Each pattern has its own test behind this one.
        test = f"({' OR '.join(map(_holds, category.words))})"
    if category.must_contain:
        test = f"t rlike r'{category.flags}{category.must_contain}' AND {test}"
    return (
        f"transform(if({test}, {_category_spans(category)}, {_NO_SPANS}), "
        f"s -> named_struct('lo', s.lo, 'hi', s.hi, 'rank', {rank}, 'text', s.text, 'type', s.type))"
    )


def _documents_sql(rule: ListDump) -> str:
    # A sentence without what every document contains names none.
    naming = f"filter(split(t, '{SENTENCE_ENDS}'), s -> s rlike '{rule.must_contain}')"
    read = (
        f"transform({naming}, s -> regexp_replace({_strip_sql('s')}, r'(?U){rule.form_name}', ''))"
    )
    judged = (
        f"transform({read}, s -> named_struct('docs', regexp_extract_all(s, r'(?U){rule.document}', 0), "
        f"'reasons', s rlike '{rule.reasoning_word}'))"
    )
    listing = f"filter({judged}, x -> NOT x.reasons OR size(x.docs) >= {rule.per_sentence})"
    return f"if(t rlike '{rule.must_contain}', flatten(transform({listing}, x -> x.docs)), {_NO_TEXTS})"


def _bind(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


_REPORT = {
    "has_rag_style": "false", "spans": "cast(array() as array<struct<text:string,type:string>>)",
    "n_by_type": "cast(map() as map<string,int>)", "n": "0",
}


def trace_report(column: str, pack: StylePack = ZH_STYLE, fields: tuple[str, ...] | None = None) -> Column:
    """``struct<has_rag_style, spans, n_by_type, n>`` of a text column, given by name.

    With ``fields`` a struct of these only: what is not asked for is not computed.

    Spans are ordered by position, then category order, documents last.  At most
    ``reported`` document names are listed, while the count of that category covers all.
    """
    found = ", ".join(_gated_spans(c, i) for i, c in enumerate(pack.categories))
    found = f"concat({found})" if fields and "spans" not in fields else f"array_sort(concat({found}))"
    placed = f"transform({found}, s -> named_struct('text', s.text, 'type', s.type))"
    rule = pack.list_dump
    docs = _documents_sql(rule) if rule else _NO_TEXTS
    label = f"regexp_extract(t, r'(?U){rule.label}', 0)" if rule else "''"
    hits = f"named_struct('placed', {placed}, 'docs', {docs}, 'label', {label})"

    names = [c.name for c in pack.categories]
    counts = [f"size(filter(h.placed, s -> s.type = '{n}'))" for n in names]
    spans = "h.placed"
    if rule:
        dumping = f"(h.label != '' OR size(h.docs) >= {rule.per_sentence})"
        shown = f"if(size(h.docs) > 0, slice(h.docs, 1, {rule.reported}), array({_strip_sql('h.label')}))"
        listed = f"transform({shown}, d -> named_struct('text', d, 'type', '{rule.name}'))"
        spans = f"if({dumping}, concat(h.placed, {listed}), h.placed)"
        names.append(rule.name)
        counts.append(f"if({dumping}, greatest(size(h.docs), if(h.label != '', 1, 0)), 0)")
    keys = ", ".join(f"'{n}'" for n in names)
    by_type = f"map_filter(map_from_arrays(array({keys}), array({', '.join(counts)})), (k, v) -> v > 0)"
    told = {"has_rag_style": "size(r) > 0", "spans": "r", "n_by_type": by_type, "n": "size(r)"}
    fields = fields or tuple(told)
    report = _bind("r", spans, f"named_struct({', '.join(f'{k!r}, {told[k]}' for k in fields)})")
    fenced = f"{column} rlike '[{_OPEN}{_CLOSE}]'"
    text = f"coalesce(if({fenced}, translate({column}, '{_OPEN}{_CLOSE}', '{_PLAIN}{_PLAIN}'), {column}), '')"
    full = F.expr(_bind("t", text, _bind("h", hits, report)))
    nothing = F.expr(f"named_struct({', '.join(f'{k!r}, {_REPORT[k]}' for k in fields)})")
    return F.when(may_have_trace(text_or_empty(column), pack), full).otherwise(nothing)
