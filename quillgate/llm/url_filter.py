"""URL filters: a tree of path templates for each host, judged by smoothed labelled purity.

1. Urls are cut into host and path; rules give some of them a verdict, which is their label.
2. Path segments are generalised: digits become ``{n}``; where a node has more than
   ``most_children`` different segments below it, they become ``*``.
3. Sibling branches whose labelled shares do not differ by a two-proportion test are merged
   and share their counts; a branch that differs stands alone.
4. From the root down, a node's purity is its labelled block share, smoothed towards its
   parent's.  A template with a purity of at least ``reject`` blocks its urls.

Urls collapse to distinct (host, generalised path) counts by partial sums before anything
else, so a host with a third of all pages is a few rows; the verdicts return by a join that
can be split.  The tree has any depth: levels are built until no path has segments left, and
only paths that some other path still follows go on to the next level.  The number of jobs
grows with the longest common beginning of two paths.

Defined results: a null url or one without ``://`` has an empty host and path and fits no
rule; all of them are one template.  Rows that repeat a url get the same verdict.  Without
any labelled url, nothing is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgate.llm.shared import ascii_lower, table, written

#: (rule, verdict): host, then the path's beginning.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class Settings:
    rules: tuple[tuple[str, str], ...] = RULES
    most_children: int = 16
    z: float = 2.0  #: siblings differ beyond so many standard errors
    prior_weight: float = 4.0  #: labelled urls that the parent's purity counts for
    reject: float = 0.5


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):  # a later, longer one wins
        of, at = text.split("/", 1)
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{at}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "{n}")


def parsed(pages: DataFrame, settings: Settings) -> DataFrame:
    """``page_id, host, path, rule, said, shape``."""
    urls = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), settings.rules)
    return urls.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), shape_of(F.col("path")).alias("shape"))


def children_of(alive: DataFrame, settings: Settings) -> DataFrame:
    """One level of the tree: ``alive`` with each row's ``child`` node and whether it is a ``leaf``.

    A path that ends is a leaf of its own node.  A node with a single shape has one leaf, the
    whole rest of the path; no deeper node could tell it from anything.
    """
    below = alive.groupBy("host", "node", F.get("rest", F.lit(0)).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    fan = written(
        below.groupBy("host", "node").agg(F.count("segment").alias("children"), F.sum("n").alias("shapes")), "url-fan"
    )
    ended, lone = F.size("rest") == 0, F.col("shapes") == 1
    segment = F.when(F.col("children") > settings.most_children, F.lit("*")).otherwise(F.get("rest", F.lit(0)))
    child = (
        F.when(ended, F.col("node"))
        .when(lone, F.concat_ws("/", "node", F.array_join("rest", "/")))
        .otherwise(F.concat_ws("/", "node", segment))
    )
    rest = F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))
    return alive.join(fan, ["host", "node"]).select(
        "host", "shape", "node", child.alias("child"), rest.alias("rest"), (ended | lone).alias("leaf"), "b", "l"
    )


def child_purities(rows: DataFrame, above: DataFrame, settings: Settings) -> DataFrame:
    """``(host, node, purity)`` of the children in ``rows``, from their parents' purities.

    A node has at most ``most_children`` children and its own end, so a window over it is small.
    """
    m = settings.prior_weight
    siblings = Window.partitionBy("host", "node")
    nodes = rows.groupBy("host", "node", "child").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
    both = nodes.withColumn("all_b", F.sum("b").over(siblings)).withColumn("all_l", F.sum("l").over(siblings))
    rest = F.col("all_l") - F.col("l")
    p = F.try_divide("all_b", "all_l")
    apart = F.abs(F.try_divide("b", "l") - F.try_divide(F.col("all_b") - F.col("b"), rest))
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), F.col("l")) + F.try_divide(F.lit(1), rest)))
    marked = both.withColumn("alone", F.coalesce(apart > settings.z * error, F.lit(False)))  # null where one side has no label
    for name in ("b", "l"):
        shared = F.sum(F.when(~F.col("alone"), F.col(name))).over(siblings)
        marked = marked.withColumn(f"m{name}", F.when(F.col("alone"), F.col(name)).otherwise(shared))
    return marked.join(above, ["host", "node"]).select(
        "host", F.col("child").alias("node"), ((F.col("mb") + m * F.col("purity")) / (F.col("ml") + m)).alias("purity")
    )


def templates(shapes: DataFrame, settings: Settings) -> DataFrame:
    """``(host, shape, template, purity)``: level by level, until every path has reached its leaf."""
    m = settings.prior_weight
    total = shapes.agg(F.sum("b"), F.sum("l")).first()
    share = (total[0] or 0) / total[1] if total[1] else 0.0
    above = shapes.groupBy("host").agg(F.sum("b").alias("b"), F.sum("l").alias("l")).select(
        "host", F.lit("").alias("node"), ((F.col("b") + m * share) / (F.col("l") + m)).alias("purity")
    )
    segments = F.split(F.regexp_replace("shape", "^/", ""), "/", -1)
    alive = shapes.select("host", "shape", F.lit("").alias("node"), segments.alias("rest"), "b", "l")
    found, names = None, ["host", "shape", "template", "purity"]
    while True:
        rows = written(children_of(alive, settings), "url-tree")
        above = written(child_purities(rows, above, settings), "url-level")
        leaves = rows.where("leaf").select("host", "shape", F.col("child").alias("node")).join(above, ["host", "node"])
        leaves = leaves.withColumnRenamed("node", "template").select(names)
        found = leaves if found is None else found.union(leaves)
        alive = rows.where("NOT leaf").select("host", "shape", F.col("child").alias("node"), "rest", "b", "l")
        if alive.isEmpty():
            return written(found, "url-templates")


def judged(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity``: one row for each row of ``pages``."""
    urls = parsed(pages, settings)
    shapes = urls.groupBy("host", "shape").agg(
        F.sum(F.when(F.col("said") == "block", 1).otherwise(0)).alias("b"), F.count("said").alias("l")
    )
    known = templates(written(shapes, "url-shapes"), settings)
    by_method = F.when(F.col("purity") >= settings.reject, "block").otherwise("allow")
    return urls.join(known, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("said", by_method).alias("verdict"), "template", "purity"
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
