"""Pool facts from answers in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.functions.facts import KINDS, FactPack, ZH_FACTS, facts_of_list, listed_facts


def facts_by_key(answers: DataFrame, key: str, text: str, pack: FactPack = ZH_FACTS,
                 kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``key, facts``: the union of the facts of all answers of a key, one answer per row.

    Facts are collected as sets before the shuffle, so a key with any number of answers
    sends each of its facts once per partition, and what is collected per key is its set of
    distinct facts only.  Keys whose answers hold no fact are kept.  ``kinds`` are those that
    the caller compares.
    """
    read = answers.select(key, listed_facts(text, pack, kinds).alias("_f"))
    long = read.select(key, F.explode_outer("_f").alias("_x"))
    sets = long.groupBy(key).agg(F.sort_array(F.collect_set("_x")).alias("_f"))
    return sets.select(key, facts_of_list(F.col("_f"), kinds).alias("facts"))


def pool_targets(pool: DataFrame, pack: FactPack = ZH_FACTS, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``qid, facts`` of answer pools.

    A pool is in long form ``(qid, answer)``, nested ``(qid, pool_answers)``, or already
    read ``(qid, facts)``.  Questions whose pool has no answer get no row.
    """
    if "facts" in pool.columns:
        return pool.select("qid", "facts")
    long = pool if "answer" in pool.columns else pool.select("qid", F.explode("pool_answers").alias("answer"))
    return facts_by_key(long, "qid", "answer", pack, kinds)
