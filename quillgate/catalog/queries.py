"""Named queries over the driver tables, one per operator, each with its DuckDB statement.

Every query reads whole tables and whole texts.  ``@query`` registers a callable
``(spark, sf_dir) -> DataFrame``; ``oracle`` is the same result stated in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.catalog import oracle_parts as o
from quillgate.catalog.derived import CANDIDATES_CTE, POOL_CTE, PROMPT, candidates, pools, score_of_key, sql_score_of_key
from quillgate.catalog.derived import flagged, numbered, order_lines, sampled_answers, spread, with_texts, worded
from quillgate.catalog.derived import table as t
from quillgate.functions import facts, noise, penalties, replies, style, tags, text
from quillgate.functions.facts import FactPack
from quillgate.functions.style import Category, StylePack
from quillgate.operators import calibrate, dedup, joins, ledger, lookup, moments, observed, ranking, resume, rewards, scorecard, scores, waves
from quillgate.operators import candidates as cands
from quillgate.operators.pools import facts_by_key
from quillgate.plans import training_rows, upstream
from quillgate.settings import DEFAULTS, GateSettings, SpendSettings
from quillgate.sources.settle import checkpoint_dir, settled, shuffles_cleaned, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
N = DEFAULTS.noise


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def big(column):
    return column.cast("bigint")


def long_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, dealt evenly."""
    return spread(t(spark, sf_dir, name))


def joined(column):
    return F.array_join(column, "|")


# ---------------------------------------------------------------- keys, text


@query("qid_key", "SELECT doc_id, substring(sha1(text), 1, 12) AS qid FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.question_id("text").alias("qid"))


@query("fill_qid", """
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END, ''),
  substring(sha1(text), 1, 12)) AS qid FROM documents""")
def _(spark, sf):
    given = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source"))
    return t(spark, sf, "documents").select("doc_id", text.filled_question_id(given, "text").alias("qid"))


@query("nfkc_round_trip", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def _(spark, sf):
    wide = F.translate("text", "abcdefgh 0123456789", "ａｂｃｄｅｆｇｈ　０１２３４５６７８９")
    return long_texts(spark, sf, "documents").select("doc_id", F.md5(text.nfkc(wide)).alias("digest"))


@query("sentence_count", r"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[。！？!?\n;；]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))),
    lambda x: x <> '') AS s FROM documents)""")
def _(spark, sf):
    s = long_texts(spark, sf, "documents").select("doc_id", text.sentences("text").alias("s"))
    return s.select("doc_id", big(F.size("s")).alias("n_sentences"), F.md5(joined(F.col("s"))).alias("digest"))


@query("clean_filter", """
SELECT doc_id, CAST(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS BIGINT) AS n_stripped FROM documents
WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND n_chars >= 200""")
def _(spark, sf):
    docs = t(spark, sf, "documents").filter(~text.is_blank("text") & (F.col("n_chars") >= 200))
    return docs.select("doc_id", big(text.char_length(text.stripped("text"))).alias("n_stripped"))


@query("empty_answer_count", f"""
WITH {CANDIDATES_CTE} SELECT count(*) AS n, count(*) FILTER (trim(answer) = '') AS n_empty_answer FROM cand""")
def _(spark, sf):
    return upstream.empty_answer_count(candidates(spark, sf))


@query("system_prompt_switch", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('', 'MACHINERY') THEN 'retrieval' ELSE 'neutral' END AS prompt FROM customer""")
def _(spark, sf):
    short = replies.PromptPack(retrieval_system="retrieval", neutral_system="neutral")
    switch = replies.system_prompt_for("c_mktsegment", "MACHINERY", short)
    return t(spark, sf, "customer").select("c_custkey", switch.alias("prompt"))


@query("gold_fallback", """
SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN d.source END, CASE WHEN l.toxic = 1 THEN d.lang END, '') AS gold
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, sf):
    both = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    gold = text.first_non_empty(
        F.when(F.col("quality") == 1, F.col("source")).otherwise(""), F.when(F.col("toxic") == 1, F.col("lang"))
    )
    return both.select("doc_id", gold.alias("gold"))


# ---------------------------------------------------------------- tags


@query("parse_tags", f"""
WITH {CANDIDATES_CTE} SELECT qid, cand_idx, md5(p_think) AS think, p_answer AS answer, p_reason = 'ok' AS format_ok,
  p_reason AS format_reason, q % 10 NOT IN (0, 1) AS in_order
FROM (SELECT *, {o.parsed('text')} FROM cand)""")
def _(spark, sf):
    p = candidates(spark, sf).select(
        "qid", "cand_idx", tags.parse_diagnostic("text").alias("p"), tags.tags_in_order("text").alias("in_order"))
    return p.select("qid", "cand_idx", F.md5("p.think").alias("think"), "p.answer", "p.format_ok", "p.format_reason", "in_order")


@query("parse_tags_tolerant", f"""
WITH {CANDIDATES_CTE} SELECT qid, cand_idx, CASE WHEN q % 10 = 0 THEN '' ELSE p_think END AS think,
  CASE WHEN q % 10 = 0 THEN trim(text) ELSE p_answer END AS answer
FROM (SELECT *, {o.parsed('text')} FROM cand)""")
def _(spark, sf):
    p = candidates(spark, sf).select("qid", "cand_idx", tags.parse_tolerant("text").alias("p"))
    return p.select("qid", "cand_idx", "p.think", "p.answer")


@query("wrap_and_parse", """
SELECT conv_id, turn, md5(trim(text, ' ' || chr(10))) AS think, role AS answer FROM conversations""")
def _(spark, sf):
    turns = t(spark, sf, "conversations").withColumn("w", tags.wrap_completion("text", "role"))
    p = turns.select("conv_id", "turn", tags.parse_tolerant("w").alias("p"))
    return p.select("conv_id", "turn", F.md5("p.think").alias("think"), "p.answer")


@query("references", """
SELECT c_custkey, trim(c_mktsegment) AS refs FROM customer""")
def _(spark, sf):
    prompt = F.concat(F.lit("题面【参考问答对】 "), "c_mktsegment", F.lit(" 【问题】"), "c_name")
    return t(spark, sf, "customer").select("c_custkey", tags.references_of(prompt).alias("refs"))


@query("completion_text", """
SELECT conv_id, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    turns = t(spark, sf, "conversations").withColumn("m", F.struct("role", F.col("text").alias("content")))
    nested = cands.nest_in_order(turns, ["conv_id"], "turn", "m", "messages")
    return nested.select("conv_id", F.md5(tags.completion_text("messages")).alias("digest"))


# ---------------------------------------------------------------- dedup, order, splits


@query("dedup_first", """
SELECT min(doc_id) AS doc_id, substring(sha1(text), 1, 12) AS qid FROM documents GROUP BY text""")
def _(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", text.question_id("text").alias("qid"))
    return dedup.first_per_key(docs, "qid", "doc_id")


@query("dedup_last", """
SELECT max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, substring(sha1(text), 1, 12) AS qid
FROM documents GROUP BY text""")
def _(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source", text.question_id("text").alias("qid"))
    return dedup.index_by(docs, "qid", "doc_id")


@query("split_eval_train", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || qid)) <= 100 THEN 'eval' ELSE 'train' END AS split
FROM (SELECT min(doc_id) AS doc_id, substring(sha1(text), 1, 12) AS qid FROM documents GROUP BY text)""")
def _(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", text.question_id("text").alias("qid"))
    unique = dedup.first_per_key(docs, "qid", "doc_id")
    return ranking.fixed_count_split(unique, "qid", 100, 42).select("doc_id", "split")


@query("problem_sets", """
WITH s AS (SELECT qid, doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || qid)) <= 100 THEN 'eval' ELSE 'train' END AS split
FROM (SELECT min(doc_id) AS doc_id, substring(sha1(text), 1, 12) AS qid FROM documents GROUP BY text))
SELECT qid, split, source AS gold_answer, 'all' AS set_name FROM s JOIN documents USING (doc_id)
UNION ALL SELECT qid, split, source, 'train' FROM s JOIN documents USING (doc_id) WHERE split = 'train'""")
def _(spark, sf):
    docs = t(spark, sf, "documents").select(
        F.col("text").alias("query"), F.lit("p").alias("user_prompt"), F.col("source").alias("answer"),
        F.lit("").alias("reasoning"), "doc_id")
    questions = ranking.fixed_count_split(upstream.clean_questions(docs, "doc_id"), "qid", 100, 42)
    labelled = [upstream.problems(questions, s).withColumn("set_name", F.lit(n)) for s, n in ((None, "all"), ("train", "train"))]
    return labelled[0].unionByName(labelled[1]).select("qid", "split", "gold_answer", "set_name")


@query("shuffled_limit", """
SELECT c_custkey FROM customer ORDER BY md5('42:' || cast(c_custkey as string)) LIMIT 500""")
def _(spark, sf):
    return ranking.shuffled_limit(t(spark, sf, "customer"), "c_custkey", 500, 42).select("c_custkey")


@query("holdout_every_n", """
SELECT c_custkey, (row_number() OVER (ORDER BY substring(sha1(c_name), 1, 12)) - 1) % 10 = 0 AS held_out,
  (row_number() OVER (ORDER BY c_name) - 1) % 4 = 0 AS by_name FROM customer""")
def _(spark, sf):
    keyed = t(spark, sf, "customer").select("c_custkey", "c_name", text.question_id("c_name").alias("qid"))
    held = ranking.hold_out_every(keyed, "qid", 0.10)
    named = ranking.hold_out_every(keyed, "c_name", 0.25).select("c_custkey", F.col("held_out").alias("by_name"))
    return held.select("c_custkey", "held_out").join(named, "c_custkey")


@query("gather_until", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY md5('42:' || cast(o_orderkey as string))) AS rn FROM orders),
h AS (SELECT rn, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS hits FROM r)
SELECT o_orderkey, o_orderstatus = 'F' AS selected FROM r
WHERE rn <= coalesce((SELECT ceil(min(rn) / 48.0) * 48 FROM h WHERE hits >= 700), 9e18)""")
def _(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("selected"))
    return ranking.gather_until(orders, "o_orderkey", "selected", 700, 48, 42)


@query("gather_in_waves", ORACLES["gather_until"])
def _(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("selected"))
    return waves.gather_in_waves(orders, lambda part: part, "o_orderkey", "selected", 700, 48, 42).rows


@query("wave_counts", """
WITH r AS (SELECT o_orderstatus, row_number() OVER (ORDER BY md5('42:' || cast(o_orderkey as string))) AS rn FROM orders),
h AS (SELECT rn, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS hits FROM r),
s AS (SELECT min(rn) AS stop, (SELECT count(*) FROM orders) AS n FROM h WHERE hits >= 700),
w AS (SELECT n, min(k) AS k FROM s, generate_series(1, 40) g(k) WHERE 48 * (pow(2, k) - 1) >= coalesce(stop, n) GROUP BY n)
SELECT n AS n_items, least(n, 48 * (pow(2, k) - 1))::BIGINT AS n_scored, k::BIGINT AS n_waves FROM w""")
def _(spark, sf):
    """How many orders the work was done for: counted where it is done, not where it stops."""
    from pyspark.sql import Observation

    orders = t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("selected"))
    seen = []

    def work(part: DataFrame) -> DataFrame:
        seen.append(Observation(f"wave {len(seen)}"))
        return part.observe(seen[-1], F.count(F.lit(1)).alias("n"))

    made = waves.gather_in_waves(orders, work, "o_orderkey", "selected", 700, 48, 42)
    counted = sum(o.get["n"] for o in seen)
    assert counted == made.scored
    return orders.agg(F.count(F.lit(1)).alias("n_items")).select(
        "n_items", F.lit(counted).cast("bigint").alias("n_scored"), F.lit(made.waves).cast("bigint").alias("n_waves"))


# ---------------------------------------------------------------- joins and checks


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return joins.not_done(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")


@query("resume_union", """
SELECT doc_id, 'old' AS origin FROM labels UNION ALL
SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    done = t(spark, sf, "labels").select("doc_id", F.lit("old").alias("origin"))
    fresh = joins.not_done(t(spark, sf, "documents"), done, "doc_id").select("doc_id", F.lit("new").alias("origin"))
    return done.unionByName(fresh)


@query("resume_filtered", """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus AS state FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O')""")
def _(spark, sf):
    """Lines of orders that are still open; the finished orders are asked through the key filter."""
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("state"))
    done = t(spark, sf, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return resume.remaining(lines, done, "l_orderkey")


@query("resume_requests", """
SELECT DISTINCT md5(text) AS user_digest, substring(sha1(text), 1, 12) AS qid FROM documents
WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)""")
def _(spark, sf):
    """Requests for the texts that no labelled document holds: long keys, of which the filter sees hashes."""
    docs = t(spark, sf, "documents").select("doc_id", F.col("text").alias("query"), F.lit(None).cast("string").alias("qid"), F.col("text").alias("user_prompt"))
    done = docs.join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("query")
    asked = upstream.base_requests(docs, done, left=resume.remaining)
    return asked.select(F.md5("user").alias("user_digest"), "qid").distinct()


@query("leaked_key_sample", """
WITH d AS (SELECT substring(sha1(text), 1, 12) AS qid, substring(md5(cast(doc_id as string)), 1, 1) < '4' AS held FROM documents)
SELECT DISTINCT qid FROM d WHERE NOT held AND qid IN (SELECT qid FROM d WHERE held) ORDER BY qid LIMIT 5""")
def _(spark, sf):
    """What the error of a leaking training table names; the five are the feature."""
    return joins.least_keys(QUERIES["leak_check"](spark, sf), 5)


@query("leak_check", """
WITH d AS (SELECT doc_id, substring(sha1(text), 1, 12) AS qid, substring(md5(cast(doc_id as string)), 1, 1) < '4' AS held FROM documents)
SELECT doc_id, qid FROM d WHERE NOT held AND qid IN (SELECT qid FROM d WHERE held)""")
def _(spark, sf):
    docs = t(spark, sf, "documents").select(
        "doc_id", F.lit("train").alias("split"), F.col("text").alias("query"), text.question_id("text").alias("qid"),
        (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "4").alias("held"))
    return joins.leaked_questions(docs.filter("not held"), docs.filter("held")).select("doc_id", "qid")


@query("left_join_default", """
SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    found = joins.join_unique(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")
    return found.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("hot_key_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name, s_acctbal FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def _(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    who = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_acctbal")
    return joins.join_unique(lines, who, "l_suppkey", min_rows=300)


@query("coverage", "SELECT doc_id AS qid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("qid"))
    return joins.uncovered(docs, t(spark, sf, "labels").withColumnRenamed("doc_id", "qid"))


@query("missing_pool", f"""
WITH {CANDIDATES_CTE}, {POOL_CTE} SELECT DISTINCT qid FROM cand WHERE qid NOT IN (
  SELECT qid FROM pool WHERE len(list_filter(pool_answers, lambda x: trim(x) <> '')) > 0)""")
def _(spark, sf):
    cand = candidates(spark, sf)
    return joins.without_long_pool(cand.select("qid").distinct(), sampled_answers(cand))


@query("candidates_posexplode", """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cand_idx, md5(text) AS digest FROM conversations""")
def _(spark, sf):
    nested = cands.nest_in_order(t(spark, sf, "conversations"), ["conv_id"], "turn", "text", "candidates")
    long = cands.explode_candidates(nested)
    return long.select("conv_id", big(F.col("cand_idx")).alias("cand_idx"), F.md5("text").alias("digest"))


@query("aligned_candidates", """
WITH k AS (SELECT (SELECT count(*) FROM part) // (SELECT count(*) FROM supplier) AS k)
SELECT s_suppkey, p_partkey, p_partkey % k AS cand_idx FROM part, k, supplier WHERE s_suppkey = p_partkey // k""")
def _(spark, sf):
    prompts = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("position"), "s_suppkey")
    completions = t(spark, sf, "part").select(F.col("p_partkey").alias("position"), "p_partkey")
    return cands.aligned_candidates(prompts, completions).select("s_suppkey", "p_partkey", "cand_idx")


# ---------------------------------------------------------------- facts and pools

_ANCHOR_SQL = "concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN len({column}) > 0 THEN '{label}' || array_to_string({column}, '、') END"
    for (_, label), column in zip(facts.ANCHOR_LABELS, ("p_pol", "p_val", "p_date"))
) + ")"

LATIN_FACTS = FactPack(
    polarity=("there", "the", "her", "ere", "tion", "ation", "on"),
    date=r"\d{4}-\d{2}-\d{2}", values=(r"\d+(?:\.\d+)?%", r"\d{3,}"), units=(),
)
_LATIN_TERMS = ["there", "ation", "tion", "the", "her", "ere", "on"]


@query("latin_facts", f"""
SELECT doc_id, array_to_string({o.terms('t', _LATIN_TERMS)}, '|') AS polarity,
  array_to_string(list_sort(list_distinct(list_transform(flatten([
    regexp_extract_all(regexp_replace(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', ' ', 'g'), '[0-9]+(?:\\.[0-9]+)?%'),
    regexp_extract_all(regexp_replace(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', ' ', 'g'), '[0-9]{{3,}}')]),
    lambda x: replace(x, ',', '')))), '|') AS vals
FROM (SELECT doc_id, nfc_normalize(text) AS t FROM documents)""")
def _(spark, sf):
    f = long_texts(spark, sf, "documents").select("doc_id", facts.extract_facts("text", LATIN_FACTS).alias("f"))
    return f.select("doc_id", joined(F.col("f.polarity")).alias("polarity"), joined(F.col("f.value")).alias("vals"))


@query("answer_facts", f"""
WITH {CANDIDATES_CTE} SELECT qid, cand_idx, array_to_string(f_pol, '|') AS polarity, array_to_string(f_val, '|') AS vals,
  array_to_string(f_date, '|') AS dates FROM (SELECT *, {o.facts('answer', 'f')} FROM cand)""")
def _(spark, sf):
    f = candidates(spark, sf).select("qid", "cand_idx", facts.extract_facts("answer").alias("f"))
    return f.select("qid", "cand_idx", joined(F.col("f.polarity")).alias("polarity"), joined(F.col("f.value")).alias("vals"),
                    joined(F.col("f.date")).alias("dates"))


@query("polarity_gate", f"""
WITH {CANDIDATES_CTE} SELECT a.qid, a.cand_idx, len(list_filter(a.pol, lambda x: NOT list_contains(b.pol, x))) = 0 AS inside
FROM (SELECT *, {o.terms('answer', o.TERMS)} AS pol FROM cand) a
JOIN (SELECT qid, list_distinct(flatten(list({o.terms('answer', o.TERMS)}))) AS pol FROM cand WHERE l_linenumber <= 2 GROUP BY qid) b USING (qid)""")
def _(spark, sf):
    cand = candidates(spark, sf)
    terms = cand.select("qid", "cand_idx", facts.extract_facts("answer")["polarity"].alias("pol"))
    known = facts_by_key(cand.filter("l_linenumber <= 2"), "qid", "answer")
    allowed = known.select("qid", F.col("facts.polarity").alias("allowed"))
    both = joins.join_unique(terms, allowed, "qid", how="inner")
    return both.select("qid", "cand_idx", (F.size(F.array_except("pol", "allowed")) == 0).alias("inside"))


@query("pool_ordered_distinct", """
WITH p AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS g FROM orders GROUP BY o_custkey),
f AS (SELECT o_custkey, x, min(i) AS i FROM (
  SELECT o_custkey, unnest(list_concat([g, o_custkey::VARCHAR], s)) AS x, generate_subscripts(list_concat([g, o_custkey::VARCHAR], s), 1) AS i FROM p) GROUP BY 1, 2)
SELECT o_custkey, string_agg(x, '|' ORDER BY i) AS pool FROM f GROUP BY o_custkey""")
def _(spark, sf):
    orders = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    sampled = orders.withColumn("v", F.concat(F.lit(" "), "o_orderpriority"))
    # An order key is its own index here, so a customer's answers may stand far apart.
    nested = cands.nest_in_order(sampled, ["o_custkey"], "o_orderkey", "v", "samples")
    last = dedup.last_per_key(orders, "o_custkey", "o_orderkey").select("o_custkey", "o_orderpriority")
    both = nested.join(last, "o_custkey")
    pool = facts.merged_pool("o_orderpriority", F.col("o_custkey").cast("string"), "samples")
    return both.select("o_custkey", joined(pool).alias("pool"))


@query("pool_facts", f"""
WITH {CANDIDATES_CTE}, {POOL_CTE} SELECT qid, array_to_string(p_pol, '|') AS polarity, array_to_string(p_val, '|') AS vals,
  array_to_string(p_date, '|') AS dates, len(p_pol) + len(p_val) + len(p_date) > 0 AS trainable,
  {_ANCHOR_SQL} AS anchor
FROM (SELECT qid, {o.facts("array_to_string(pool_answers, '#')", 'p')} FROM pool)""")
def _(spark, sf):
    sampled = candidates(spark, sf).filter("l_tax <= 0.045")
    f = facts_by_key(sampled, "qid", "answer").withColumnRenamed("facts", "f")
    return f.select("qid", joined(F.col("f.polarity")).alias("polarity"), joined(F.col("f.value")).alias("vals"),
                    joined(F.col("f.date")).alias("dates"), facts.pool_is_trainable(F.col("f")).alias("trainable"),
                    facts.anchor_text(F.col("f")).alias("anchor"))


_WITH_FACTS = f"""{CANDIDATES_CTE}, {POOL_CTE},
pf AS (SELECT qid, {o.facts("array_to_string(pool_answers, '#')", 'p')} FROM pool),
both_sides AS (SELECT c.*, {o.facts('c.answer', 'm')}, coalesce(p_pol, {o.NO_FACTS}) AS p_pol, coalesce(p_val, {o.NO_FACTS}) AS p_val,
  coalesce(p_date, {o.NO_FACTS}) AS p_date, pf.qid IS NULL AS no_pool FROM cand c LEFT JOIN pf USING (qid)),
judged AS (SELECT *, {o.verdict('answer')} FROM both_sides)"""


@query("pool_verdict", f"""
WITH {_WITH_FACTS} SELECT qid, cand_idx, in_pool, comparable, reason, array_to_string(drift, '|') AS drift,
  CAST(len(p_pol) + len(p_val) + len(p_date) AS BIGINT) AS pool_size FROM judged""")
def _(spark, sf):
    cand = candidates(spark, sf)
    target = facts_by_key(cand.filter("l_tax <= 0.045"), "qid", "answer").withColumnRenamed("facts", "p")
    none = facts.no_facts()
    both = joins.join_unique(cand, target, "qid").withColumn("m", facts.extract_facts("answer"))
    both = both.withColumn("p", F.coalesce("p", none))
    told = ("in_pool", "comparable", "reason", "drift_facts", "pool_size")
    v = both.select("qid", "cand_idx", facts.pool_verdict("answer", F.col("m"), F.col("p"), told).alias("v"))
    return v.select("qid", "cand_idx", "v.in_pool", "v.comparable", "v.reason", joined(F.col("v.drift_facts")).alias("drift"),
                    big(F.col("v.pool_size")).alias("pool_size"))


@query("date_cover", """
WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1
  THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders),
p AS (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y') ELSE strftime(l_shipdate, '%Y-%m') END AS d FROM lineitem)
SELECT o_orderkey, coalesce(bool_or(starts_with(m.d, p.d) OR starts_with(p.d, m.d)), false) AS covered
FROM m LEFT JOIN p ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def _(spark, sf):
    key, d = F.col("o_orderkey"), F.col("o_orderdate")
    spelled = F.when(key % 3 == 0, F.date_format(d, "yyyy")).when(key % 3 == 1, F.date_format(d, "yyyy-MM")).otherwise(
        F.date_format(d, "yyyy-MM-dd"))
    model = t(spark, sf, "orders").select("o_orderkey", spelled.alias("d"))
    known = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy")).otherwise(
            F.date_format("l_shipdate", "yyyy-MM")).alias("d"))
    # Distinct spellings first: an order's dates come down to a few months and years.
    dates = known.distinct().groupBy("o_orderkey").agg(F.collect_set("d").alias("dates"))
    both = model.join(dates, "o_orderkey", "left")
    return both.select("o_orderkey", F.coalesce(facts.date_covered(F.col("d"), F.col("dates")), F.lit(False)).alias("covered"))


@query("date_cover_by_prefix", """
WITH m AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS question,
  CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 5 < 3
  THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders),
p AS (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS question,
  CASE WHEN l_linenumber % 4 = 0 THEN strftime(l_shipdate, '%Y-%m') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d FROM lineitem)
SELECT m.question, m.d AS date, coalesce(bool_or(starts_with(m.d, p.d) OR starts_with(p.d, m.d)), false) AS covered
FROM m LEFT JOIN p ON m.question = p.question GROUP BY m.question, m.d""")
def _(spark, sf):
    def spelled(at, exact, month):
        return F.when(exact, F.date_format(at, "yyyy-MM-dd")).when(month, F.date_format(at, "yyyy-MM")).otherwise(F.date_format(at, "yyyy"))

    key, line = F.col("o_orderkey"), F.col("l_linenumber")
    model = t(spark, sf, "orders").select(
        F.when(key % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("question"),
        spelled("o_orderdate", key % 5 >= 3, key % 5 != 0).alias("date"))
    known = t(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_suppkey")).alias("question"),
        spelled("l_shipdate", line % 4 != 0, F.lit(True)).alias("date"))
    return lookup.covered_dates(model, known, "question")


# ---------------------------------------------------------------- style

LATIN_STYLE = StylePack(categories=(
    Category("license", (r"the Apache License, Version", r"Apache License", r"General Public License")),
    Category("shout", (r"!!+",)),
    Category("mail", (r"[a-z0-9._]+@[a-z0-9.]+",), ignore_case=True, must_contain="@"),
    Category("marks", (r"[#$%&*]{3}",)),
))


@query("style_report", r"""
SELECT doc_id, n_license + n_shout + n_mail + n_marks > 0 AS traced, n_license, n_shout, n_mail, n_marks FROM (
  SELECT doc_id, CAST(len(regexp_extract_all(text, 'the Apache License, Version|Apache License|General Public License')) AS BIGINT) AS n_license,
    CAST(len(regexp_extract_all(text, '!!+')) AS BIGINT) AS n_shout,
    CAST(len(regexp_extract_all(text, '(?i)[a-z0-9._]+@[a-z0-9.]+')) AS BIGINT) AS n_mail,
    CAST(len(regexp_extract_all(text, '[#$%&*]{3}')) AS BIGINT) AS n_marks FROM documents)""")
def _(spark, sf):
    r = long_texts(spark, sf, "documents").select("doc_id", style.trace_report("text", LATIN_STYLE).alias("r"))
    return r.select("doc_id", F.col("r.has_rag_style").alias("traced"), *[
        big(F.coalesce(F.col("r.n_by_type")[c.name], F.lit(0))).alias(f"n_{c.name}") for c in LATIN_STYLE.categories])


@query("style_gate", f"WITH {CANDIDATES_CTE} SELECT qid, cand_idx, {o.style('think')} AS traced FROM cand")
def _(spark, sf):
    return candidates(spark, sf).select("qid", "cand_idx", style.has_trace("think").alias("traced"))


@query("style_spans", f"""
WITH {CANDIDATES_CTE} SELECT qid, cand_idx,
  CASE WHEN contains(think, '根据参考资料') THEN '根据参考|参考资料' WHEN contains(think, '您可以参考下图') THEN '您可以参考|参考下图'
       WHEN contains(think, '回答：') THEN '回答：' WHEN contains(think, '.PNG') THEN regexp_extract(think, 'table[0-9]+.PNG')
       WHEN contains(think, '《') THEN '《甲办法》|《乙办法》|《丙办法》' ELSE '' END AS spans FROM cand""")
def _(spark, sf):
    r = candidates(spark, sf).select("qid", "cand_idx", style.trace_report("think")["spans"].alias("s"))
    return r.select("qid", "cand_idx", joined(F.transform("s", lambda x: x["text"])).alias("spans"))


@query("style_rate", f"WITH {CANDIDATES_CTE} SELECT count(*) AS n, count(*) FILTER ({o.style('think')}) AS n_traced FROM cand")
def _(spark, sf):
    return scorecard.style_rate(candidates(spark, sf), "think")


# ---------------------------------------------------------------- penalties


def _top(text_sql: str, size: int) -> str:
    return (
        f"coalesce(list_max(map_values(list_aggregate(list_transform(range(1, length({text_sql}) - {size} + 2), "
        f"lambda i: substr({text_sql}, i, {size})), 'histogram'))), 0)"
    )


@query("ngram_max_count", f"""
SELECT conv_id, turn, CAST({_top('text', 3)} AS BIGINT) AS top_3, CAST({_top('text', 8)} AS BIGINT) AS top_8 FROM conversations""")
def _(spark, sf):
    g = long_texts(spark, sf, "conversations").select("conv_id", "turn", penalties.gram_counts("text", (3, 8)).alias("g"))
    return g.select("conv_id", "turn", big(F.col("g")[0]).alias("top_3"), big(F.col("g")[1]).alias("top_8"))


@query("repeat_penalty", f"""
SELECT doc_id, round(least(0.8, CASE WHEN length(c) < 80 THEN 0 ELSE
  (CASE WHEN {_top('c', 8)} >= 5 THEN 0.35 ELSE 0 END) + (CASE WHEN {_top('c', 12)} >= 4 THEN 0.35 ELSE 0 END)
  + (CASE WHEN {_top('c', 20)} >= 3 THEN 0.25 ELSE 0 END) END), 4)::DOUBLE AS penalty
FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS c FROM documents)""")
def _(spark, sf):
    p = penalties.repeat_penalty("text", DEFAULTS.reward)
    return long_texts(spark, sf, "documents").select("doc_id", F.round(p, 4).alias("penalty"))


@query("length_penalty", """
SELECT doc_id, round(least(0.6, greatest(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) - 2200, 0) / 1000.0 * 0.3), 4)::DOUBLE AS penalty FROM documents""")
def _(spark, sf):
    p = penalties.length_penalty("text", DEFAULTS.reward)
    return t(spark, sf, "documents").select("doc_id", F.round(p, 4).alias("penalty"))


# ---------------------------------------------------------------- judge observations and calibration

_REPLY = """
case when event_id % 5 = 0 then 'score: {"clean_score": ' || regexp_extract(props, '[0-9]+', 0) || '} end'
     when event_id % 5 = 1 then '{"clean_score": "' || regexp_extract(props, '[0-9]+', 0) || '"}'
     when event_id % 5 = 2 then 'cut {"clean_score": ' || regexp_extract(props, '[0-9]+', 0) || '.5, '
     when event_id % 5 = 3 then '{"other": ' || regexp_extract(props, '[0-9]+', 0) || '}'
     else 'no score' end
"""
_SCORE_SQL = """
CASE WHEN event_id % 5 IN (0, 1) THEN least(10.0, regexp_extract(props, '[0-9]+', 0)::DOUBLE)
     WHEN event_id % 5 = 2 THEN least(10.0, regexp_extract(props, '[0-9]+', 0)::DOUBLE + 0.5) END
"""


def _observations(spark, sf) -> DataFrame:
    events = t(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr(_REPLY).alias("raw_reply"))
    return scores.observed_scores(events)


@query("judge_reply_parse", f"SELECT event_id, ({_SCORE_SQL})::DOUBLE AS score FROM events")
def _(spark, sf):
    return _observations(spark, sf).select("event_id", "score")


@query("k_repeat_score", f"""
SELECT user_id, round(avg(s), 6) AS clean_score, round(coalesce(stddev_samp(s), 0), 6) AS sd, count(s) AS n
FROM (SELECT user_id, {_SCORE_SQL} AS s FROM events) GROUP BY user_id""")
def _(spark, sf):
    made = scores.repeat_scores(_observations(spark, sf), "user_id")
    return made.select("user_id", F.round("clean_score", 6).alias("clean_score"), F.round("sd", 6).alias("sd"), "n")


@query("admitted_scores", f"""
SELECT user_id, round(avg(s), 6) AS clean_score, count(s) AS n FROM (SELECT user_id, {_SCORE_SQL} AS s FROM events)
GROUP BY user_id HAVING count(s) >= 16""")
def _(spark, sf):
    k = scores.require_select_k(DEFAULTS.gates.k_select, DEFAULTS.gates.min_select_k)
    made = scores.admitted_to_cache(scores.repeat_scores(_observations(spark, sf), "user_id"), k, DEFAULTS.gates.min_select_k)
    return made.select("user_id", F.round("clean_score", 6).alias("clean_score"), "n")


@query("score_cache", f"""
WITH k AS (SELECT user_id, count(s) AS n, round(avg(s), 6) AS m FROM (SELECT user_id, {_SCORE_SQL} AS s FROM events) GROUP BY user_id),
cached AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN -1.0 ELSE m END AS m FROM k WHERE n >= 16)
SELECT cast(user_id as string) AS key, m AS clean_score, 'cached' AS state FROM cached
UNION ALL SELECT DISTINCT cast(user_id as string), NULL::DOUBLE, 'to_send' FROM events WHERE user_id NOT IN (SELECT user_id FROM cached)""")
def _(spark, sf):
    seen = _observations(spark, sf).withColumn("key", F.col("user_id").cast("string"))
    fresh = scores.admitted_to_cache(scores.repeat_scores(seen, "key"), 16, DEFAULTS.spend.cache_min_k)
    old = fresh.filter(F.col("key").cast("bigint") % 2 == 0).withColumn("clean_score", F.lit(-1.0))
    cache = scores.update_cache(old, fresh)
    missing = scores.requests_to_send(seen.select("key"), cache)
    return cache.select("key", F.round("clean_score", 6).alias("clean_score"), F.lit("cached").alias("state")).unionByName(
        missing.select("key", F.lit(None).cast("double").alias("clean_score"), F.lit("to_send").alias("state")))


@query("merged_scores", ORACLES["k_repeat_score"])
def _(spark, sf):
    """``k_repeat_score`` from the stored moments of three parts of the observations, one after another."""
    seen = _observations(spark, sf)
    state = None
    for part in range(3):
        more = moments.moments(seen.filter(F.col("event_id") % 3 == part), ["user_id"], "score")
        state = settled(more if state is None else moments.merged_moments(state, more, ["user_id"]))
    made = moments.scores_of_moments(state, ["user_id"])
    return made.select("user_id", F.round("clean_score", 6).alias("clean_score"), F.round("sd", 6).alias("sd"), "n")


@query("score_cache_partitions", f"""
WITH k AS (SELECT user_id, count(s) AS n, round(avg(s), 6) AS m FROM (SELECT user_id, {_SCORE_SQL} AS s FROM events) GROUP BY user_id)
SELECT cast(user_id as string) AS key, CASE WHEN user_id % 2 = 0 THEN -1.0 ELSE m END AS clean_score, n FROM k WHERE n >= 16""")
def _(spark, sf):
    """The cache in hash partitions: half of the keys are stored first, with another score that stays."""
    import uuid

    from quillgate.sources.score_cache import add_scores, answered

    path = f"{checkpoint_dir(spark)}/score-cache-{uuid.uuid4().hex}"
    seen = _observations(spark, sf).withColumn("key", F.col("user_id").cast("string"))
    fresh = scores.admitted_to_cache(scores.repeat_scores(seen, "key"), 16, DEFAULTS.spend.cache_min_k)
    add_scores(spark, path, fresh.filter(F.col("key").cast("bigint") % 2 == 0).withColumn("clean_score", F.lit(-1.0)), 64)
    add_scores(spark, path, fresh)
    return answered(spark, path, seen.select("key")).select("key", F.round("clean_score", 6).alias("clean_score"), "n")


_SCALED = "(p_retailprice - 900) / 110.0"


@query("sigma_lookup", f"SELECT p_partkey, round({o.sigma('x')}, 6)::DOUBLE AS sigma FROM (SELECT p_partkey, {_SCALED} AS x FROM part)")
def _(spark, sf):
    part = t(spark, sf, "part").selectExpr("p_partkey", f"{_SCALED} as x")
    return part.select("p_partkey", F.round(noise.sigma_of_score("x", N), 6).alias("sigma"))


_JUDGE_TIERS = "SELECT p_brand AS judge, floor(p_size / 10) + count(*) % 7 / 8.0 AS mean, count(*) % 17 / 8.0 AS sigma FROM part GROUP BY p_brand, floor(p_size / 10)"


@query("sigma_by_judge", f"""
WITH tiers AS ({_JUDGE_TIERS}), steps AS (
  SELECT judge, mean AS x0, sigma AS y0, lead(mean) OVER w AS x1, lead(sigma) OVER w AS y1 FROM tiers WINDOW w AS (PARTITION BY judge ORDER BY mean)
), ends AS (
  SELECT judge, min(mean) AS low, max(mean) AS high, min_by(sigma, mean) AS y_low, max_by(sigma, mean) AS y_high FROM tiers GROUP BY judge
), scored AS (SELECT p_partkey, p_brand AS judge, {_SCALED} * 0.7 AS x FROM part)
SELECT p_partkey, round(CASE WHEN x <= low THEN y_low WHEN x >= high THEN y_high ELSE y0 + (x - x0) / (x1 - x0) * (y1 - y0) END, 6)::DOUBLE AS sigma
FROM scored JOIN ends USING (judge) LEFT JOIN steps ON steps.judge = scored.judge AND x > x0 AND x <= x1""")
def _(spark, sf):
    part = t(spark, sf, "part")
    size = F.floor(F.col("p_size") / 10)
    tiers = part.groupBy(F.col("p_brand").alias("judge"), size.alias("size")).agg(F.count("*").alias("n")).select(
        "judge", (F.col("size") + F.col("n") % 7 / 8.0).alias("mean"), (F.col("n") % 17 / 8.0).alias("sigma"))
    scored = part.selectExpr("p_partkey", "p_brand as judge", f"{_SCALED} * 0.7 as score")
    return lookup.sigma_by_judge(scored, tiers).select("p_partkey", F.round("sigma", 6).alias("sigma"))


@query("separable", f"""
SELECT p_partkey, {o.clearly('x', 'y', 2.0)} AS clear2, {o.clearly('x', 'y', 3.0)} AS clear3
FROM (SELECT p_partkey, {_SCALED} AS x, p_size / 10.0 AS y FROM part)""")
def _(spark, sf):
    part = t(spark, sf, "part").selectExpr("p_partkey", f"{_SCALED} as x", "p_size / 10.0D as y")
    return part.select("p_partkey", noise.clearly_cleaner("x", "y", N, 2.0).alias("clear2"),
                       noise.clearly_cleaner("x", "y", N, 3.0).alias("clear3"))


@query("eval_error", f"""
SELECT event_type, n, round({o.error('n')}, 6) AS se, round(3 * ({o.error('n')}), 6) AS threshold, round(sqrt(p * (1 - p) / n), 6) AS rate_se
FROM (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS p FROM events GROUP BY event_type)""")
def _(spark, sf):
    by = t(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("p"))
    return by.select("event_type", "n", F.round(noise.mean_score_error("n", 3, N), 6).alias("se"),
                     F.round(noise.true_gain_threshold("n", 3, N), 6).alias("threshold"),
                     F.round(noise.rate_error("p", "n"), 6).alias("rate_se"))


@query("tier_fit", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sigma, count(value) AS n FROM events GROUP BY event_type""")
def _(spark, sf):
    fit = calibrate.fit_tiers(t(spark, sf, "events"), "event_type", "value")
    return fit.select("event_type", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"), "n")


@query("tier_separability", """
WITH f AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type)
SELECT a.event_type AS tier_a, b.event_type AS tier_b, round(abs(a.m - b.m) / (a.s + b.s), 6) AS distance,
  abs(a.m - b.m) / (a.s + b.s) > 0.01 AS separable FROM f a JOIN f b ON a.event_type < b.event_type""")
def _(spark, sf):
    fit = calibrate.fit_tiers(t(spark, sf, "events"), "event_type", "value")
    pairs = calibrate.tier_separability(fit, "event_type", 0.01)
    return pairs.withColumn("distance", F.round("distance", 6))


@query("variance_parts", """
WITH i AS (SELECT user_id, avg(value) AS m, var_samp(value) AS v, count(value) AS k FROM events GROUP BY user_id)
SELECT round(avg(k), 6) AS k, round(avg(v), 4) AS judge_var, round(greatest(var_samp(m) - avg(v) / avg(k), 0), 4) AS between_var FROM i""")
def _(spark, sf):
    parts = calibrate.variance_parts(t(spark, sf, "events"), "user_id", "value")
    return parts.select(F.round("k", 6).alias("k"), F.round("judge_var", 4).alias("judge_var"),
                        F.round("between_var", 4).alias("between_var"))


@query("spearman", """
SELECT round(corr(rx, ry), 8) AS spearman FROM (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)""")
def _(spark, sf):
    made = calibrate.rank_correlation(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return made.select(F.round("spearman", 8).alias("spearman"))


# ---------------------------------------------------------------- best of K, rewards


@query("best_of_k", """
SELECT l_orderkey, cand_idx, l_extendedprice FROM (
  SELECT l_orderkey, cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 100000 + l_suppkey AS cand_idx, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 100000 + l_suppkey) AS rn
  FROM lineitem) WHERE rn = 1""")
def _(spark, sf):
    lines = t(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 100000 + l_suppkey as cand_idx", "l_extendedprice")
    return cands.best_of(lines, "l_orderkey", "l_extendedprice", "cand_idx", [])


@query("group_advantage", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (l_quantity - m) / s END, 6)::DOUBLE AS advantage FROM (
  SELECT *, avg(l_quantity) OVER (PARTITION BY l_orderkey) AS m, stddev_samp(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)""")
def _(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    made = cands.group_advantage(lines, "l_orderkey", "l_quantity")
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("advantage", 6).alias("advantage"))


_PENALTY_SQL = f"""(CASE WHEN length(think) < 80 THEN 0 ELSE least(0.8,
  (CASE WHEN {_top('think', 8)} >= 5 THEN 0.35 ELSE 0 END) + (CASE WHEN {_top('think', 12)} >= 4 THEN 0.35 ELSE 0 END)
  + (CASE WHEN {_top('think', 20)} >= 3 THEN 0.25 ELSE 0 END)) END)"""
_GATE_SQL = f"""CASE WHEN q % 10 IN (0, 1, 2, 4) OR length(think) < 40 THEN 'format' WHEN NOT in_pool THEN 'out_of_pool'
  WHEN NOT comparable THEN 'not_comparable' WHEN {o.style('think')} THEN 'style' ELSE 'clean' END"""
_REWARD_SQL = """CASE gate WHEN 'format' THEN -4 WHEN 'out_of_pool' THEN -3 WHEN 'not_comparable' THEN -2
  WHEN 'style' THEN round(0.5 - penalty, 4) ELSE round(1 + 0.4 * {judge} / 10 - penalty, 4) END"""


def _reward_inputs(spark, sf) -> tuple[DataFrame, DataFrame]:
    cand, lines = candidates(spark, sf), order_lines(spark, sf, dealt=False)
    pooled = stored(pools(worded(lines)), "pools")  # the pool is a table of its own in a run
    prompts = pooled.select("qid", F.to_json("pool_answers").alias("v1_answers_json"))
    key = replies.score_key(DEFAULTS.spend.cache_version, F.col("qid"), F.col("think"), 2)
    return cand.select("qid", "cand_idx", "text", key.alias("key")), prompts


_REWARD_CTE = f"""{_WITH_FACTS}, usable AS (
  SELECT qid FROM pool WHERE len(list_filter(pool_answers, lambda x: trim(x) <> '')) > 0),
gated AS (SELECT *, {_GATE_SQL} AS gate, {_PENALTY_SQL} AS penalty, {o.key('qid', 'think', 2)} AS key
  FROM judged WHERE qid IN (SELECT qid FROM usable))"""


@query("candidate_rewards", f"WITH {_REWARD_CTE} SELECT qid, cand_idx, gate, ({_REWARD_SQL.format(judge='0')})::DOUBLE AS reward FROM gated")
def _(spark, sf):
    cand, prompts = _reward_inputs(spark, sf)
    # Only candidates of prompts with a pool take part, as in an online run.
    made = rewards.candidate_rewards(cand, prompts, DEFAULTS.reward, pooled_only=True)
    return made.select("qid", "cand_idx", "gate", "reward")


@query("judged_rewards", f"""
WITH {_REWARD_CTE}, r AS (SELECT qid, cand_idx, gate, ({_REWARD_SQL.format(judge=sql_score_of_key('key'))})::DOUBLE AS reward FROM gated)
SELECT qid, cand_idx, reward, round(CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (reward - m) / s END, 4)::DOUBLE AS advantage FROM (
  SELECT *, avg(reward) OVER (PARTITION BY qid) AS m, stddev_pop(reward) OVER (PARTITION BY qid) AS s FROM r)""")
def _(spark, sf):
    cand, prompts = _reward_inputs(spark, sf)

    def judged(gated: DataFrame) -> DataFrame:
        observed = gated.select("key").distinct().select("key", score_of_key("key").alias("score"))
        return scores.repeat_scores(observed)

    rewarded = rewards.candidate_rewards(cand, prompts, DEFAULTS.reward, judged, pooled_only=True)
    made = stored(rewarded.select("qid", "cand_idx", "reward"), "rewards")
    return cands.group_advantage(made, ddof=0).select("qid", "cand_idx", "reward", F.round("advantage", 4).alias("advantage"))


# ---------------------------------------------------------------- selection


def _selection_inputs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, base rows and pools: a question's base reasoning is that of its smallest candidate."""
    cand, lines = candidates(spark, sf), order_lines(spark, sf, dealt=False)  # short answers are merged before a shuffle
    rollouts = cand.selectExpr("qid", "qid as query", f"{PROMPT} as user_prompt", "cand_idx", "text")
    base = worded(flagged(dedup.first_per_key(numbered(lines), "qid", "cand_idx"))).select(
        "qid", F.col("qid").alias("query"), F.expr(PROMPT).alias("user_prompt"), "answer",
        F.concat(F.lit("资料显示"), "think").alias("reasoning"), F.lit("train").alias("split"))
    return rollouts, base, sampled_answers(worded(lines))


def _scores_for(keys: DataFrame) -> DataFrame:
    return scores.repeat_scores(keys.distinct().select("key", score_of_key("key").alias("score")))


def _selected(spark, sf) -> DataFrame:
    """Survivors and screened candidates are tables of their own in a run: judge requests are made from them.

    The survivors' gates have written theirs already; the others are written without the keys.
    """
    rollouts, base, pooled = _selection_inputs(spark, sf)
    kept = training_rows.long_survivors(rollouts, base, pooled)
    best = stored(training_rows.screened(kept, _scores_for(kept.select(F.col("screen_key").alias("key")))), "screened")
    keys = best.select(F.explode(F.array("select_key", "base_key")).alias("key"))
    return training_rows.confirmed(best, _scores_for(keys))


_REF = "'第' || qid || '题的依据'"
_SELECT_CTE = f"""{_WITH_FACTS},
base AS (SELECT qid, min_by(answer, cand_idx) AS b_answer, '资料显示' || min_by(think, cand_idx) AS b_think FROM cand GROUP BY qid),
alive AS (SELECT *, {sql_score_of_key(o.key(_REF, 'think', 2))} AS quick FROM judged
  WHERE q % 10 NOT IN (0, 2) AND in_pool AND NOT {o.style('think')}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY quick DESC, cand_idx) AS rn FROM alive) WHERE rn = 1),
final AS (SELECT best.qid, think, trim(b_answer) AS b_answer, b_think, {sql_score_of_key(o.key(_REF, 'think', 16))} AS sc,
  {sql_score_of_key(o.key(_REF, 'b_think', 16))} AS sb FROM best JOIN base USING (qid)),
chosen AS (SELECT *, {o.clearly('sc', 'sb', 2.0)} AS selected, {o.clearly('sc', 'sb', 3.0)} AS three FROM final)"""


@query("select_best_candidate", f"""
WITH {_SELECT_CTE} SELECT qid, md5(think) AS best_think, round(sc, 4)::DOUBLE AS score_clean, round(sb, 4)::DOUBLE AS score_base, selected,
  CASE WHEN three THEN 3 WHEN selected THEN 2 END AS sigma_bucket FROM chosen""")
def _(spark, sf):
    return _selected(spark, sf).select(
        "qid", F.md5("best_think").alias("best_think"), F.round("score_clean", 4).alias("score_clean"),
        F.round("score_base", 4).alias("score_base"), "selected", "sigma_bucket")


@query("survivor_counts", f"WITH {_SELECT_CTE} SELECT qid, count(*) AS n_survivors FROM alive GROUP BY qid")
def _(spark, sf):
    return training_rows.survivor_counts(training_rows.long_survivors(*_selection_inputs(spark, sf)))


_WRAP = "'<think>' || chr(10) || {t} || chr(10) || '</think>' || chr(10) || chr(10) || '<answer>' || chr(10) || b_answer || chr(10) || '</answer>'"


@query("preference_pairs", f"""
WITH {_SELECT_CTE} SELECT qid AS query, md5({_WRAP.format(t='think')}) AS chosen, md5({_WRAP.format(t='b_think')}) AS rejected,
  round(sc, 4)::DOUBLE AS score_clean, round(sb, 4)::DOUBLE AS score_base FROM chosen WHERE selected""")
def _(spark, sf):
    pairs = training_rows.pair_rows(_selected(spark, sf).filter("selected"))
    return pairs.select("query", F.md5(F.element_at("messages", -1)["content"]).alias("chosen"),
                        F.md5("rejected_response").alias("rejected"), F.round("meta.score_clean", 4).alias("score_clean"),
                        F.round("meta.score_base", 4).alias("score_base"))


@query("rft_rows", f"""
WITH {_SELECT_CTE}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || qid)) AS rn FROM chosen),
h AS (SELECT rn, sum(CASE WHEN selected THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS hits FROM r)
SELECT qid AS query, md5({_WRAP.format(t='think')}) AS completion, 3::BIGINT AS n_messages FROM r
WHERE selected AND rn <= coalesce((SELECT ceil(min(rn) / 48.0) * 48 FROM h WHERE hits >= 200), 9e18)""")
def _(spark, sf):
    results = stored(_selected(spark, sf), "selected")  # read several times by the early stop
    rows = training_rows.sft_rows(training_rows.until_target(results, DEFAULTS.targets.rft), "best_think")
    return rows.select("query", F.md5(F.element_at("messages", -1)["content"]).alias("completion"),
                       big(F.size("messages")).alias("n_messages"))


_UNTIL = """r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || qid)) AS rn FROM {rows}),
h AS (SELECT rn, sum(CASE WHEN selected THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS hits FROM r),
u AS (SELECT * FROM r WHERE selected AND rn <= coalesce((SELECT ceil(min(rn) / 48.0) * 48 FROM h WHERE hits >= {target}), 9e18))"""


@query("preference_pairs_until_target", f"""
WITH {_SELECT_CTE}, {_UNTIL.format(rows='chosen', target=900)} SELECT qid AS query, md5({_WRAP.format(t='think')}) AS chosen,
  md5({_WRAP.format(t='b_think')}) AS rejected FROM u""")
def _(spark, sf):
    results = stored(_selected(spark, sf), "selected")
    pairs = training_rows.pair_rows(training_rows.until_target(results, DEFAULTS.targets.dpo))
    return pairs.select("query", F.md5(F.element_at("messages", -1)["content"]).alias("chosen"), F.md5("rejected_response").alias("rejected"))


@query("judge_requests", f"""
WITH {_SELECT_CTE} SELECT DISTINCT {o.key(_REF, 'think', 2)} AS key,
  md5('R' || {_REF} || 'T' || think || 'E') AS prompt, 2 AS k FROM alive""")
def _(spark, sf):
    kept = training_rows.long_survivors(*_selection_inputs(spark, sf))
    short = replies.PromptPack(judge_template="R{reference}T{think}E")
    asked = training_rows.judge_requests(kept, "screen_key", "think", 2, short)
    return asked.select("key", F.md5("user").alias("prompt"), "k")


def _rewrites(spark, sf):
    rollouts, base, pooled = _selection_inputs(spark, sf)
    lines = numbered(order_lines(spark, sf, dealt=False))
    last = worded(flagged(dedup.last_per_key(lines, "qid", "cand_idx")))
    written = last.filter("q % 7 <> 0").select("qid", F.concat("think", F.lit("，"), "answer").alias("natural"))
    return training_rows.rewrite_gates(base, pooled, written)


def _rewrite_results(spark, sf) -> DataFrame:
    gated = _rewrites(spark, sf)  # written by the gates
    quick = _scores_for(gated.select(F.explode(F.array("screen_key", "screen_base_key")).alias("key")))
    full = _scores_for(gated.select(F.explode(F.array("select_key", "base_key")).alias("key")))
    return training_rows.rewrite_results(gated, quick, full)


_REWRITE_CTE = f"""{CANDIDATES_CTE}, {POOL_CTE},
base AS (SELECT qid, min_by(answer, cand_idx) AS b_answer, '资料显示' || min_by(think, cand_idx) AS b_think FROM cand GROUP BY qid),
written AS (SELECT qid, trim(max_by(think, cand_idx) || '，' || max_by(answer, cand_idx)) AS nat, max_by(q, cand_idx) AS q FROM cand GROUP BY qid),
g0 AS (SELECT base.*, CASE WHEN q % 7 <> 0 THEN nat END AS nat, coalesce(array_to_string(pool_answers, '#'), '') AS pooled
  FROM base JOIN written USING (qid) LEFT JOIN pool USING (qid)),
g1 AS (SELECT *, nat IS NOT NULL AND NOT {o.style("coalesce(nat, '')")} AS rule_ok FROM g0),
g2 AS (SELECT *, {o.terms("(b_answer || '#' || b_think || '#' || pooled)", o.TERMS)} AS allowed, {o.terms('nat', o.TERMS)} AS wrote FROM g1),
g3 AS (SELECT *, rule_ok AND (len(allowed) = 0 OR len(list_filter(wrote, lambda x: NOT list_contains(allowed, x))) = 0) AS facts_ok FROM g2),
g4 AS (SELECT *, {sql_score_of_key(o.key(_REF, 'nat', 2))} AS qc, {sql_score_of_key(o.key(_REF, 'b_think', 2))} AS qb,
  {sql_score_of_key(o.key(_REF, 'nat', 16))} AS fc, {sql_score_of_key(o.key(_REF, 'b_think', 16))} AS fb FROM g3),
g5 AS (SELECT *, CASE WHEN facts_ok AND qc > qb THEN fc END AS sc, CASE WHEN facts_ok AND qc > qb THEN fb END AS sb FROM g4),
g6 AS (SELECT *, {o.clearly('sc', 'sb', 2.0)} AS selected FROM g5)"""


@query("rewrite_selection", f"""
WITH {_REWRITE_CTE} SELECT qid, rule_ok, facts_ok, round(sc, 4)::DOUBLE AS score_clean, round(sb, 4)::DOUBLE AS score_base, selected FROM g6""")
def _(spark, sf):
    r = _rewrite_results(spark, sf)
    return r.select("qid", "rule_ok", "facts_ok", F.round("score_clean", 4).alias("score_clean"),
                    F.round("score_base", 4).alias("score_base"), "selected")


@query("selection_funnel", f"""
WITH {_REWRITE_CTE} SELECT count(*) FILTER (nat <> '') AS n_rewritten, count(*) FILTER (nat <> '' AND NOT rule_ok) AS n_rule_blocked,
  count(*) FILTER (rule_ok AND NOT facts_ok) AS n_facts_blocked, count(*) FILTER (facts_ok AND sc IS NULL) AS n_screened,
  count(*) FILTER (selected) AS n_eligible FROM g6""")
def _(spark, sf):
    return training_rows.selection_funnel(_rewrite_results(spark, sf))


@query("sft_rows_in_waves", f"""
WITH {_REWRITE_CTE}, {_UNTIL.format(rows='g6', target=700)}, e AS (SELECT *, (row_number() OVER (ORDER BY qid) - 1) % 10 = 0 AS held_out FROM u)
SELECT qid AS query, held_out FROM e""")
def _(spark, sf):
    """``sft_rows_until_target`` without gating and scoring the questions beyond the target."""
    rollouts, base, pooled = _selection_inputs(spark, sf)
    pooled = stored(pooled, "pooled")
    last = worded(flagged(dedup.last_per_key(numbered(order_lines(spark, sf, dealt=False)), "qid", "cand_idx")))
    written = stored(last.filter("q % 7 <> 0").select("qid", F.concat("think", F.lit("，"), "answer").alias("natural")), "written")

    def work(part: DataFrame) -> DataFrame:
        mine = part.select("qid")
        gated = training_rows.rewrite_gates(part, pooled.join(mine, "qid", "left_semi"), written.join(mine, "qid", "left_semi"))
        quick = _scores_for(gated.select(F.explode(F.array("screen_key", "screen_base_key")).alias("key")))
        full = _scores_for(gated.select(F.explode(F.array("select_key", "base_key")).alias("key")))
        return training_rows.rewrite_results(gated, quick, full)

    split = DEFAULTS.split
    made = waves.gather_in_waves(stored(base, "base-rows"), work, "qid", "selected", DEFAULTS.targets.sft, split.gather_chunk, split.gather_seed, first_chunks=16)
    train, held = training_rows.sft_train_and_eval(made.rows)
    return train.select("query", F.lit(False).alias("held_out")).unionByName(held.select("query", F.lit(True).alias("held_out")))


@query("sft_rows", f"""
WITH {_REWRITE_CTE}, e AS (SELECT *, (row_number() OVER (ORDER BY qid) - 1) % 10 = 0 AS held_out FROM g6 WHERE selected)
SELECT qid AS query, md5('<think>' || chr(10) || nat || chr(10) || '</think>' || chr(10) || chr(10) || '<answer>' || chr(10)
  || trim(b_answer) || chr(10) || '</answer>') AS completion, held_out FROM e""")
def _(spark, sf):
    train, held = training_rows.sft_train_and_eval(_rewrite_results(spark, sf))
    both = train.withColumn("held_out", F.lit(False)).unionByName(held.withColumn("held_out", F.lit(True)))
    return both.select("query", F.md5(F.element_at("messages", -1)["content"]).alias("completion"), "held_out")


@query("sft_rows_until_target", f"""
WITH {_REWRITE_CTE}, {_UNTIL.format(rows='g6', target=700)}, e AS (SELECT *, (row_number() OVER (ORDER BY qid) - 1) % 10 = 0 AS held_out FROM u)
SELECT qid AS query, held_out FROM e""")
def _(spark, sf):
    results = stored(_rewrite_results(spark, sf), "rewrites")
    train, held = training_rows.sft_train_and_eval(training_rows.until_target(results, DEFAULTS.targets.sft))
    return train.select("query", F.lit(False).alias("held_out")).unionByName(held.select("query", F.lit(True).alias("held_out")))


@query("rewrite_requests", f"""
WITH {CANDIDATES_CTE}, {POOL_CTE}, pf AS (SELECT qid, {o.facts("array_to_string(pool_answers, '#')", 'p')} FROM pool),
base AS (SELECT qid, min_by(answer, cand_idx) AS b_answer FROM cand GROUP BY qid),
a AS (SELECT qid, b_answer, {_ANCHOR_SQL} AS anchor FROM base LEFT JOIN pf USING (qid))
SELECT qid, md5('Q' || qid || 'R第' || qid || '题的依据A' || coalesce(nullif(anchor, ''), trim(b_answer))) AS prompt FROM a""")
def _(spark, sf):
    _, base, pooled = _selection_inputs(spark, sf)
    short = replies.PromptPack(rewrite_template="Q{query}R{reference}A{anchor}")
    return training_rows.rewrite_requests(base, pooled, DEFAULTS, short).select("qid", F.md5("user").alias("prompt"))


@query("online_prompts", f"""
WITH {CANDIDATES_CTE}, {POOL_CTE}, usable AS (SELECT qid FROM pool WHERE len(list_filter(pool_answers, lambda x: trim(x) <> '')) > 0),
merged AS (SELECT qid, list_filter(list_transform(pool_answers, lambda x: trim(x)), lambda x: x <> '') AS s FROM pool JOIN usable USING (qid)),
firsts AS (SELECT qid, x, min(i) AS i FROM (SELECT qid, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM merged) GROUP BY 1, 2),
d AS (SELECT qid, list(x ORDER BY i) AS answers FROM firsts GROUP BY qid)
SELECT qid, answers[1] AS gold_answer, md5(array_to_string(answers, '|')) AS answers_digest, len(answers)::INTEGER AS pool_size
FROM (SELECT *, {o.facts("array_to_string(answers, '#')", 'p')} FROM d) WHERE len(p_pol) + len(p_val) + len(p_date) > 0""")
def _(spark, sf):
    _, base, _ = _selection_inputs(spark, sf)
    usable = pools(candidates(spark, sf)).filter(F.exists("pool_answers", lambda a: ~text.is_blank(a)))
    # The canonical answer is the first sampled one that is not blank, so it merges with it.
    named = usable.select(
        "qid", F.filter("pool_answers", lambda a: ~text.is_blank(a))[0].alias("canonical_answer"),
        F.lit(None).cast("string").alias("gold_answer"), "pool_answers")
    asked = base.select("qid", "query", "user_prompt", "split").join(usable.select("qid"), "qid", "left_semi")
    nobody = asked.limit(0).select("qid", "query")
    rows = training_rows.online_prompts(asked, named, nobody)
    answers = rewards.decoded_pool("v1_answers_json")
    return rows.select("qid", "gold_answer", F.md5(joined(answers)).alias("answers_digest"), "pool_size")


@query("prompt_checks", f"""
WITH {CANDIDATES_CTE}, {POOL_CTE}, flat AS (SELECT qid, unnest(pool_answers) AS x FROM pool), n AS (SELECT qid, trim(x) AS x FROM flat),
d AS (SELECT qid, string_agg(x, '#') AS answers FROM n WHERE x <> '' GROUP BY qid),
f AS (SELECT qid, len(p_pol) + len(p_val) + len(p_date) > 0 AS trainable FROM (SELECT *, {o.facts("answers", 'p')} FROM d)),
q AS (SELECT qid, substring(qid, 1, 1) = '0' AS leaked, f.qid IS NULL AS missing, coalesce(trainable, false) AS kept
  FROM (SELECT DISTINCT qid FROM cand) LEFT JOIN f USING (qid)),
c AS (SELECT count(*) AS n_asked, count(*) FILTER (leaked) AS n_leaked, count(*) FILTER (missing) AS n_missing, count(*) FILTER (kept) AS n_kept FROM q)
SELECT c.*, n_leaked AS seen_leaked, n_missing AS seen_missing, n_kept AS seen_kept FROM c""")
def _(spark, sf):
    """Flags of all prompts: as the written rows hold them, and as the writing job counted them."""
    cand = candidates(spark, sf)
    asked = cand.select("qid", F.lit("train").alias("split"), F.lit("").alias("query"), F.lit("").alias("user_prompt")).distinct()
    none = F.lit(None).cast("string")
    named = pools(cand).select("qid", none.alias("canonical_answer"), none.alias("gold_answer"), "pool_answers")
    held = asked.filter(F.col("qid").startswith("0")).select("qid", none.alias("query"))
    marked = training_rows.marked_prompts(asked, named, held)
    rows, seen = observed.stored_with_counts(marked, leaked="leaked", missing="missing", kept="kept")
    flags = ("leaked", "missing", "kept")
    return rows.agg(F.count("*").alias("n_asked"), *[F.count_if(f).alias(f"n_{f}") for f in flags]).select(
        "*", *[F.lit(seen[f]).cast("bigint").alias(f"seen_{f}") for f in flags])


@query("message_rows", """
SELECT conv_id, turn, md5(text) AS user_content, role AS query, '["' || role || '"]' AS pool_json FROM conversations""")
def _(spark, sf):
    turns = t(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("qid"), F.col("role").alias("query"), F.col("text").alias("user_prompt"),
        F.lit("g").alias("gold_answer"), F.array("role").alias("answers"))
    rows = training_rows.prompt_rows(turns)
    where = F.split("qid", ":")
    return rows.select(where[0].cast("bigint").alias("conv_id"), where[1].cast("bigint").alias("turn"),
                       F.md5(F.element_at("messages", -1)["content"]).alias("user_content"), "query",
                       F.col("v1_answers_json").alias("pool_json"))


@query("pool_from_replies", f"""
WITH {CANDIDATES_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cand_idx) - 1 AS i, {o.parsed('text')},
  FROM cand), p AS (SELECT *, CASE WHEN q % 10 = 0 THEN trim(text) ELSE p_answer END AS a FROM r)
SELECT qid, max(CASE WHEN i = 0 THEN a END) AS canonical_answer, coalesce(string_agg(a, '|' ORDER BY i) FILTER (i > 0), '') AS samples FROM p GROUP BY qid""")
def _(spark, sf):
    cand = candidates(spark, sf)
    nested = cands.nest_in_order(cand, ["qid"], "cand_idx", "text", "texts")
    answers = nested.select("qid", F.posexplode("texts").alias("sample_idx", "reply"))
    asked = nested.select("qid", F.lit("train").alias("split"), F.col("qid").alias("query"),
                          F.lit("p").alias("user_prompt"), F.lit("g").alias("gold_answer"))
    pool = upstream.answer_pool(asked, answers)
    return pool.select("qid", "canonical_answer", joined(F.col("pool_answers")).alias("samples"))


# ---------------------------------------------------------------- evaluation


def _inference(lines: DataFrame) -> DataFrame:
    """The first candidate of each question, parsed diagnostically, as inference rows.

    The first line is picked before its texts are made, and kept with what was parsed: scores and rows
    are made from it.
    """
    picked = flagged(dedup.first_per_key(numbered(lines), "qid", "cand_idx"))
    parsed = with_texts(picked).withColumn("p", tags.parse_diagnostic("text"))
    first = with_texts(stored(parsed.select(*picked.columns, "p"), "firsts"))
    return first.select("qid", F.col("qid").alias("query"), F.expr(PROMPT).alias("user_prompt"), F.lit("").alias("gold_answer"),
                        F.col("text").alias("gen_text"), "p.think", "p.answer", "p.format_ok", "p.format_reason")


def _eval_scores(inference: DataFrame, k: int = 3) -> DataFrame:
    key = replies.score_key(DEFAULTS.spend.cache_version, tags.references_of("user_prompt"), F.col("think"), k)
    s = inference.select("qid", key.alias("key")).withColumn("clean_score", score_of_key("key"))
    failed = F.col("clean_score") < 1.0
    return s.select("qid", F.when(~failed, F.col("clean_score")).alias("clean_score"), F.when(failed, 0).otherwise(k).alias("n"))


def _scored(spark, sf) -> DataFrame:
    lines = order_lines(spark, sf, dealt=False)  # the short answers are made and merged before they are shuffled
    inference = _inference(lines)
    return scorecard.score_rows(inference, sampled_answers(worded(lines)), _eval_scores(inference))


_EVAL_CTE = f"""{CANDIDATES_CTE}, {POOL_CTE},
firsts AS (SELECT cand.*, {o.parsed('text')} FROM cand JOIN (SELECT qid, min(cand_idx) AS cand_idx FROM cand GROUP BY qid) USING (qid, cand_idx)),
pf AS (SELECT qid, {o.facts("array_to_string(pool_answers, '#')", 'p')} FROM pool),
e0 AS (SELECT f.* EXCLUDE (answer), {o.facts('p_answer', 'm')}, coalesce(p_pol, {o.NO_FACTS}) AS p_pol, coalesce(p_val, {o.NO_FACTS}) AS p_val,
  coalesce(p_date, {o.NO_FACTS}) AS p_date, pf.qid IS NULL AS no_pool FROM firsts f LEFT JOIN pf USING (qid)),
e1 AS (SELECT *, {o.verdict('p_answer')}, {sql_score_of_key(o.key(_REF, 'p_think', 3))} AS raw_score FROM e0),
scored AS (SELECT qid, CASE WHEN raw_score >= 1 THEN raw_score END AS clean_score, CASE WHEN raw_score >= 1 THEN 3 ELSE 0 END AS clean_n,
  {o.style('p_think')} AS has_rag_style, p_reason = 'ok' AND p_think <> '' AND NOT {o.style('p_think')} AS rule_pass, p_reason = 'ok' AS format_ok,
  p_reason AS format_reason, CASE WHEN NOT no_pool THEN in_pool END AS in_pool, NOT no_pool AND comparable AS answer_comparable,
  CASE WHEN no_pool THEN 'no_pool' ELSE reason END AS answer_reason, CASE WHEN no_pool THEN '' ELSE array_to_string(drift, '|') END AS drift, no_pool,
  CASE WHEN contains(p_think, '根据参考资料') OR contains(p_think, '您可以参考下图') THEN 2 WHEN contains(p_think, '《') THEN 3
       WHEN {o.style('p_think')} THEN 1 ELSE 0 END AS n_traces FROM e1)"""
_CARD = """count(*) AS n, count(clean_score) AS n_valid_judge, count(*) FILTER (NOT no_pool) AS n_pool, count(*) FILTER (no_pool) AS n_no_pool,
  count(*) FILTER (answer_comparable) AS n_answer_comparable, count(*) FILTER (answer_reason = 'empty_answer') AS n_empty_answer,
  count(*) FILTER (NOT format_ok) AS n_format_failure, round(count(*) FILTER (format_ok) / greatest(count(*), 1), 4) AS format_pass_rate,
  round(avg(clean_score), 4) AS clean_mean, round(count(*) FILTER (rule_pass) / greatest(count(*), 1), 4) AS rule_pass_rate,
  round(count(*) FILTER (in_pool) / greatest(count(*) FILTER (NOT no_pool), 1), 4) AS in_pool_rate,
  round(count(*) FILTER (in_pool AND answer_comparable) / greatest(count(*) FILTER (answer_comparable), 1), 4) AS in_pool_comparable_rate"""
_CARD_COLUMNS = ["n", "n_valid_judge", "n_pool", "n_no_pool", "n_answer_comparable", "n_empty_answer", "n_format_failure",
                 "format_pass_rate", "clean_mean", "rule_pass_rate", "in_pool_rate", "in_pool_comparable_rate"]


_SCORE_OUT = """SELECT qid, round(clean_score, 4)::DOUBLE AS clean_score, clean_n::BIGINT AS clean_n, has_rag_style, n_traces::BIGINT AS n_traces,
  rule_pass, format_ok, format_reason, in_pool, answer_comparable, answer_reason, drift, no_pool FROM scored"""


def _score_columns(scored: DataFrame) -> DataFrame:
    return scored.select(
        "qid", F.round("clean_score", 4).alias("clean_score"), big(F.col("clean_n")).alias("clean_n"), "has_rag_style",
        big(F.col("n_traces")).alias("n_traces"), "rule_pass", "format_ok", "format_reason", "in_pool", "answer_comparable",
        "answer_reason", joined(F.col("drift_facts")).alias("drift"), "no_pool")


@query("score_rows", f"WITH {_EVAL_CTE} {_SCORE_OUT}")
def _(spark, sf):
    return _score_columns(_scored(spark, sf))


@query("streamed_scores", f"WITH {_EVAL_CTE} {_SCORE_OUT}")
def _(spark, sf):
    """The same rows scored by the incremental stream, file by file."""
    import uuid

    from quillgate.streaming.incremental import score_stream

    work = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = order_lines(spark, sf, dealt=False)  # short answers are merged before a shuffle
    inference = _inference(lines)
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a compressed file is read by one task
    pool_table, score_table = f"{work}/pool", f"{work}/scores"
    with shuffles_cleaned(spark):
        inference.repartition(files, "qid").write.option("compression", "gzip").json(f"{work}/inbox")
        sampled_answers(worded(lines)).write.parquet(pool_table)
        _eval_scores(inference).write.parquet(score_table)
    stream = score_stream(spark, f"{work}/inbox", spark.read.parquet(pool_table), spark.read.parquet(score_table),
                          f"{work}/sink", f"{work}/ckpt", "run", files_per_trigger=-(-files // 2))
    stream.awaitTermination()
    return _score_columns(spark.read.parquet(f"{work}/sink"))


@query("scorecard", f"WITH {_EVAL_CTE} SELECT {_CARD}, round({o.error('count(*)')}, 4) AS se FROM scored")
def _(spark, sf):
    card = scorecard.scorecard(_scored(spark, sf), "run", DEFAULTS.gates, N)
    return card.select(*_CARD_COLUMNS, "se")


@query("scorecard_format_ok", f"WITH {_EVAL_CTE} SELECT {_CARD} FROM scored WHERE format_ok")
def _(spark, sf):
    card = scorecard.scorecard_without_format_failures(_scored(spark, sf), "run", DEFAULTS.gates, N)
    return card.select(*_CARD_COLUMNS)


@query("failure_reasons", f"WITH {_EVAL_CTE} SELECT format_reason AS reason, count(*) AS n FROM scored WHERE NOT format_ok GROUP BY format_reason")
def _(spark, sf):
    card = scorecard.scorecard(_scored(spark, sf), "run", DEFAULTS.gates, N)
    return card.select(F.explode("format_failure_reasons").alias("reason", "n"))


@query("scorecard_report", f"WITH {_EVAL_CTE}, card AS (SELECT {_CARD} FROM scored) SELECT n::BIGINT AS n, clean_mean, rule_pass_rate, TRUE AS complete FROM card")
def _(spark, sf):
    """Scores, summary and report of a run as files; the summary is read back, and the report tested for completeness."""
    import uuid

    from quillgate.plans.evaluation import read_summary, report_is_complete, run_evaluation
    from quillgate.sources.layout import Layout

    cand, inference = candidates(spark, sf), _inference(order_lines(spark, sf, dealt=False))
    paths = Layout(f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}").evaluation("run")
    run_evaluation(inference, sampled_answers(cand), _eval_scores(inference), "run", paths)
    card = read_summary(spark, paths["summary"])
    return card.select(big(F.col("n")).alias("n"), "clean_mean", "rule_pass_rate", F.lit(report_is_complete(spark, paths)).alias("complete"))


_HALVES = "substring(qid, 1, 1) < '8'"


@query("compare_runs", f"""
WITH {_EVAL_CTE}, a AS (SELECT {_CARD} FROM scored WHERE {_HALVES}), b AS (SELECT {_CARD} FROM scored WHERE NOT {_HALVES})
SELECT b.n AS n, round(b.clean_mean - a.clean_mean, 4) AS clean_delta, round(3 * ({o.error('b.n')}), 4) AS threshold,
  CASE WHEN b.clean_mean - a.clean_mean > 3 * ({o.error('b.n')}) THEN 'up' WHEN b.clean_mean - a.clean_mean < -3 * ({o.error('b.n')}) THEN 'down' ELSE 'tie' END AS verdict,
  round(b.rule_pass_rate - a.rule_pass_rate, 4) AS rule_pass_delta, round(b.in_pool_rate - a.in_pool_rate, 4) AS in_pool_delta
FROM a, b""")
def _(spark, sf):
    scored = stored(_scored(spark, sf), "scored")  # both halves read it
    cards = scorecard.scorecard(scored.filter(_HALVES), "before", DEFAULTS.gates, N).unionByName(
        scorecard.scorecard(scored.filter(f"not ({_HALVES})"), "after", DEFAULTS.gates, N))
    made = scorecard.compare_runs(cards, "before", "after", N)
    return made.select("n", "clean_delta", "threshold", "verdict", "rule_pass_delta", "in_pool_delta")


# ---------------------------------------------------------------- upstream tables


@query("base_outputs", f"""
WITH {CANDIDATES_CTE}, r AS (SELECT *, {o.parsed('text')} FROM cand)
SELECT query, md5(raw) AS raw, md5(CASE WHEN q % 10 = 0 THEN trim(raw) ELSE p_answer END) AS answer,
  md5(CASE WHEN q % 10 = 0 THEN '' ELSE p_think END) AS reasoning
FROM (SELECT qid || ':' || cast(cand_idx as string) AS query, text AS raw, q, p_answer, p_think FROM r)""")
def _(spark, sf):
    cand = candidates(spark, sf).withColumn("query", F.concat_ws(":", "qid", "cand_idx"))
    corpus = cand.select("query", F.expr(PROMPT).alias("user_prompt"))
    made = upstream.base_outputs(corpus, cand.select("query", F.col("text").alias("raw")))
    return made.select("query", F.md5("raw").alias("raw"), F.md5("answer").alias("answer"), F.md5("reasoning").alias("reasoning"))


@query("rollout_table", f"""
WITH {CANDIDATES_CTE} SELECT qid, count(*) AS n, md5(string_agg(text, '|' ORDER BY cand_idx)) AS digest FROM cand GROUP BY qid""")
def _(spark, sf):
    cand = candidates(spark, sf)
    asked = cand.select("qid", F.col("qid").alias("query"), F.expr(PROMPT).alias("user_prompt"), F.lit("g").alias("gold_answer")).distinct()
    made = upstream.rollouts(asked, cand.select("qid", F.col("cand_idx").alias("sample_idx"), F.col("text").alias("reply")))
    return made.select("qid", big(F.size("candidates")).alias("n"), F.md5(joined(F.col("candidates"))).alias("digest"))


@query("inference_table", f"""
WITH {CANDIDATES_CTE}, f AS (SELECT cand.*, {o.parsed('text')} FROM cand JOIN (SELECT qid, min(cand_idx) AS cand_idx FROM cand GROUP BY qid) USING (qid, cand_idx))
SELECT qid, md5(p_think) AS think, md5(p_answer) AS answer, p_reason = 'ok' AS format_ok, p_reason AS format_reason FROM f""")
def _(spark, sf):
    first = dedup.first_per_key(candidates(spark, sf), "qid", "cand_idx")
    asked = first.select("qid", F.col("qid").alias("query"), F.expr(PROMPT).alias("user_prompt"), F.lit("").alias("answer"))
    made = upstream.inference_rows(asked, first.select("qid", F.col("text").alias("reply")))
    return made.select("qid", F.md5("think").alias("think"), F.md5("answer").alias("answer"), "format_ok", "format_reason")


@query("generation_requests", """
SELECT substring(sha1(c_name), 1, 12) AS qid, c_mktsegment AS user, 0.8::DOUBLE AS temperature, 8 AS n, 1536 AS max_tokens FROM customer""")
def _(spark, sf):
    asked = t(spark, sf, "customer").select(F.col("c_name").alias("query"), F.col("c_mktsegment").alias("user_prompt"))
    made = upstream.generation_requests(asked, F.lit("s"), 0.8, 0.9, 1536, 8)
    return made.select("qid", "user", "temperature", "n", "max_tokens")


@query("done_keys", "SELECT DISTINCT source AS query FROM documents")
def _(spark, sf):
    import uuid

    from quillgate.sources.jsonl import append_jsonl, done_keys

    path = f"{checkpoint_dir(spark)}/done-{uuid.uuid4().hex}"
    append_jsonl(t(spark, sf, "documents").select(F.col("source").alias("query"), "doc_id"), path)
    return done_keys(spark, path)


@query("output_markers", """
SELECT c_mktsegment AS segment, true AS complete, true AS nonempty, false AS missing FROM customer GROUP BY c_mktsegment""")
def _(spark, sf):
    """Every segment is told whether the table it was written to is complete."""
    import uuid

    from quillgate.sources.jsonl import is_complete, nonempty, write_jsonl

    path = f"{checkpoint_dir(spark)}/marked-{uuid.uuid4().hex}"
    segments = t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    write_jsonl(segments, path)
    return segments.select("segment", F.lit(is_complete(spark, path)).alias("complete"), F.lit(nonempty(spark, path)).alias("nonempty"),
                           F.lit(is_complete(spark, f"{path}-none")).alias("missing"))


@query("stage_gate", f"WITH {_EVAL_CTE}, c AS (SELECT {_CARD} FROM scored) SELECT in_pool_rate, in_pool_rate >= 0.5 AS passes FROM c")
def _(spark, sf):
    card = settled(scorecard.scorecard(_scored(spark, sf), "run", DEFAULTS.gates, N))
    try:
        scorecard.check_stage_gate(card, GateSettings(in_pool_floor=0.5))
        passes = True
    except ValueError:
        passes = False
    return card.select("in_pool_rate", F.lit(passes).alias("passes"))


# ---------------------------------------------------------------- spend

PRICES = SpendSettings(budget=20.0)
_USAGE = ["event_id as seq", "ts", "event_type as stage", "cast(floor(value * 100) as bigint) as in_tokens",
          "user_id * 10 as out_tokens", "event_id % 9 = 0 as cache_hit"]
_USAGE_CTE = f"usage AS (SELECT {', '.join(_USAGE)} FROM events)"
# Exact decimals, like the ledger's.
_COST = "(({i})::DECIMAL(18,0) * 6.5 + ({o})::DECIMAL(18,0) * 27) * 0.000001"


def _usage(spark, sf) -> DataFrame:
    return t(spark, sf, "events").selectExpr(*_USAGE)


@query("usage_totals", f"""
WITH {_USAGE_CTE} SELECT stage, count(*) FILTER (NOT cache_hit) AS calls, sum(in_tokens)::BIGINT AS in_tokens, sum(out_tokens)::BIGINT AS out_tokens,
  count(*) FILTER (cache_hit) AS cache_hits, round({_COST.format(i='sum(in_tokens)', o='sum(out_tokens)')}, 4)::DOUBLE AS yuan FROM usage GROUP BY stage""")
def _(spark, sf):
    made = ledger.usage_totals(_usage(spark, sf), PRICES, ["stage"])
    return made.select("stage", "calls", "in_tokens", "out_tokens", "cache_hits", "yuan")


_RUN_CTE = f"""{_USAGE_CTE}, r AS (SELECT seq, round({_COST.format(
    i='sum(in_tokens) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)',
    o='sum(out_tokens) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)')}, 4)::DOUBLE AS yuan_so_far, ts FROM usage),
f AS (SELECT *, yuan_so_far >= 16.0 AS warn, yuan_so_far >= 20.0 AS over_budget FROM r)"""


@query("running_spend", f"WITH {_RUN_CTE} SELECT seq, yuan_so_far, warn, over_budget FROM f")
def _(spark, sf):
    made = ledger.running_spend(_usage(spark, sf), ["ts", "seq"], PRICES)
    return made.select("seq", "yuan_so_far", "warn", F.col("over").alias("over_budget"))


@query("budget_crossing", f"WITH {_RUN_CTE} SELECT seq, yuan_so_far FROM f WHERE warn ORDER BY ts, seq LIMIT 1")
def _(spark, sf):
    made = ledger.running_spend(_usage(spark, sf), ["ts", "seq"], PRICES)
    return ledger.crossing_row(made, ["ts", "seq"], "warn").select("seq", "yuan_so_far")


@query("windowed_spend", f"""
WITH {_USAGE_CTE} SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS window_start, stage, count(*) AS calls, sum(in_tokens)::BIGINT AS in_tokens,
  round({_COST.format(i='sum(in_tokens)', o='sum(out_tokens)')}, 4)::DOUBLE AS yuan FROM usage GROUP BY 1, 2""")
def _(spark, sf):
    from quillgate.streaming.spend import windowed_spend

    made = windowed_spend(_usage(spark, sf), PRICES, "1 hour")
    return made.select(F.unix_timestamp("window_start").alias("window_start"), "stage", "calls", "in_tokens", "yuan")


def _usage_stream(spark, sf):
    """The usage log as it grows: three appends in the order of time, then the mark of its end.

    Yields the stream, the folder and the stored log after the second append and after the last,
    so that whoever follows it is stopped in between and starts again.
    """
    import uuid

    work = f"{checkpoint_dir(spark)}/usage-{uuid.uuid4().hex}"
    usage = _usage(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    cuts = usage.select(F.percentile_approx("ts", F.array(F.lit(0.4), F.lit(0.7)))).first()[0]
    ends = usage.agg(F.max("ts")).first()[0]
    bounds = [None, *cuts, None]
    for k in range(3):
        rows = usage
        if bounds[k] is not None:
            rows = rows.filter(F.col("ts") > F.lit(bounds[k]))
        if bounds[k + 1] is not None:
            rows = rows.filter(F.col("ts") <= F.lit(bounds[k + 1]))
        rows.write.mode("append").parquet(f"{work}/log")
        if k == 2:  # a row without tokens, far enough ahead to close every window of the log
            mark = usage.limit(1).select(F.lit(-1).cast("bigint").alias("seq"), (F.lit(ends) + F.expr("interval 2 days")).cast(usage.schema["ts"].dataType).alias("ts"), F.lit("end of log").alias("stage"),
                                         F.lit(0).cast("bigint").alias("in_tokens"), F.lit(0).cast(usage.schema["out_tokens"].dataType).alias("out_tokens"), F.lit(False).alias("cache_hit"))
            mark.write.mode("append").parquet(f"{work}/log")
        if k:
            stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 64).parquet(f"{work}/log")
            yield stream, work, spark.read.schema(usage.schema).parquet(f"{work}/log")


@query("streamed_spend", ORACLES["windowed_spend"])
def _(spark, sf):
    """``windowed_spend`` by a stream that closes windows and is started again in mid-log."""
    from quillgate.streaming.spend import spend_stream

    for stream, work, _ in _usage_stream(spark, sf):
        spend_stream(stream, PRICES, f"{work}/windows", f"{work}/ckpt", "1 hour", "1 hour").awaitTermination()
    made = spark.read.parquet(f"{work}/windows")
    return made.select(F.unix_timestamp("window_start").alias("window_start"), "stage", "calls", "in_tokens", "yuan")


@query("streamed_crossing", ORACLES["budget_crossing"])
def _(spark, sf):
    """``budget_crossing`` by a stream that is started again in mid-log."""
    from quillgate.streaming.spend import crossing_stream

    for stream, work, log in _usage_stream(spark, sf):
        crossing_stream(stream, log, ["ts", "seq"], PRICES, "warn", f"{work}/spend", f"{work}/ckpt", "1 hour", "1 hour").awaitTermination()
    return spark.read.schema("seq bigint, yuan_so_far double").parquet(f"{work}/spend/crossing").select("seq", "yuan_so_far")


# ---------------------------------------------------------------- files


@query("jsonl_round_trip", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def _(spark, sf):
    import uuid

    from quillgate.sources.jsonl import read_jsonl, write_jsonl

    turns = t(spark, sf, "conversations")
    path = f"{checkpoint_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(turns, path)
    return read_jsonl(spark, path, turns.schema).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("progress_last_wins", """
SELECT source, arg_max(doc_id, (doc_id % 3) * 1000000000000 + doc_id) AS doc_id FROM documents GROUP BY source""")
def _(spark, sf):
    import uuid

    from quillgate.sources.jsonl import append_jsonl, read_progress, write_jsonl

    docs = t(spark, sf, "documents").select("source", "doc_id")
    path = f"{checkpoint_dir(spark)}/progress-{uuid.uuid4().hex}"
    # Three appends of several files each: the last append decides, and in it the larger document.
    write_jsonl(docs.limit(0), path)
    for part in range(3):
        rows = docs.filter(F.col("doc_id") % 3 == part)
        append_jsonl(rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), path)
    return read_progress(spark, path, docs.schema, "source")
