"""Merkle manifest of a table: ranks from merged bitmaps place the leaves, slot arrays reduce the levels.

1. Every row is a leaf, the SHA-256 of its columns.  Rows shrink to group, id and digest.
2. The ids of a group are a bitmap: 64-bit words, and only those with a bit, merged by partial
   ``bit_or``.  Word counts add up, 512 at a time, to a popcount directory; going down again
   every word learns how many leaves stand before it.
3. A rank query (the word's offset and the bits below the id) gives a leaf its place.  Leaves
   are never sorted.
4. A run of ``fan`` nodes becomes one node.  A slot array, keyed by group and block, holds the
   nodes of ``depth`` levels of runs and reduces them in one shuffle.
5. The group roots, ranked by name, are the leaves of one more tree.  Proofs come back down the
   same blocks: a node's siblings are its run's and those of its parents.

Defined results: null columns are hashed as ``-``; a null group comes first and a null id first
in its group.  Rows that repeat an id in a group are leaves of their own, in the order of their
digests (ids whose word count exceeds its bits are ranked by running counts over ranges
instead).  Equal rows are as many leaves.  An empty table has no row and no root.  A tree of one
leaf has that leaf as its root and an empty proof.  A row with a null id is never tampered with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.llm.shared import ascii_lower, bound, table, written
from quillgate.operators.ranking import running_totals

_NO_ID = -(2**60)  #: word of the null ids, before any word of an id
_STEP = 9  #: a directory entry counts 2**9 entries below it
_TOP = 6  #: six steps over 58 bits of word number leave at most 2**5 entries at the top


@dataclass(frozen=True)
class Settings:
    fan: int = 8  #: nodes that become one
    depth: int = 3  #: levels that one slot array reduces

    @property
    def block(self) -> int:
        return self.fan**self.depth


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def tampered(docs: DataFrame) -> Column:
    """Which rows the check tampers with."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


def leaves_of(docs: DataFrame) -> DataFrame:
    """``group, doc_id, word, leaf, other``: the digests as bytes; ``other`` is the tampered row's, if any."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    leaf, other = digest(*rest, text), F.when(tampered(docs), digest(*rest, ascii_lower(text)))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("group"),
        doc_id.alias("doc_id"), F.coalesce(F.shiftright(doc_id, 6), F.lit(_NO_ID)).alias("word"),
        F.unhex(leaf).alias("leaf"), F.unhex(other).alias("other"),
    )


# --- bitmaps and their popcount directory ---


def _low(doc_id: Column) -> Column:
    return doc_id.bitwiseAND(F.lit(63)).cast("int")


def bitmaps(leaves: DataFrame) -> DataFrame:
    """``group, word, bits, n``: the non-zero words of each group's bitmap, and its rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _low(F.col("doc_id")))
    return leaves.groupBy("group", "word").agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))


def _before(parent: list[str]):
    return F.coalesce(F.sum("n").over(W.partitionBy(*parent).orderBy("word").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def directory(words: DataFrame) -> DataFrame:
    """``words`` with ``before``, the leaves of the group before the word, and ``total``, all its leaves.

    Windows hold 512 entries at most: counts are summed up by steps until a group is one entry
    of the top, and the sums before are handed down again.
    """
    levels = [words]
    while len(levels) <= _TOP:
        ends = levels[-1].agg(F.min("word").alias("lo"), F.max("word").alias("hi")).first()
        if ends.lo is None or ends.lo >> _STEP == ends.hi >> _STEP:
            break
        above = levels[-1].groupBy("group", F.shiftright("word", _STEP).alias("word")).agg(F.sum("n").alias("n"))
        levels.append(written(above, "popcounts"))
    top = levels.pop()
    ranked = top.withColumn("before", _before(["group"])).withColumn("total", F.sum("n").over(W.partitionBy("group")))
    while levels:
        parent = ranked.select("group", F.col("word").alias("parent"), F.col("before").alias("base"), "total")
        here = levels.pop().withColumn("parent", F.shiftright("word", _STEP))
        ranked = here.withColumn("inside", _before(["group", "parent"])).join(parent, ["group", "parent"])
        ranked = ranked.withColumn("before", F.col("inside") + F.col("base")).drop("parent", "inside", "base")
    return ranked


def placed(leaves: DataFrame) -> DataFrame:
    """``group, n, place, doc_id, leaf, other``: every leaf's place in its group of ``n``, from 0."""
    words = written(bitmaps(leaves), "bitmaps")
    ranks = written(directory(words), "directory").withColumn("plain", F.col("n") == F.bit_count(F.coalesce("bits", F.lit(0))))
    once = ranks.where("plain").select("group", "word", "bits", "before", "total")
    under = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), _low(F.col("doc_id"))))
    out = leaves.join(once, ["group", "word"]).select(
        "group", F.col("total").alias("n"), (F.col("before") + F.bit_count(F.col("bits").bitwiseAND(under))).alias("place"), "doc_id", "leaf", "other"
    )
    repeated = ranks.where("NOT plain").select("group", "word", "before", "total")
    if repeated.isEmpty():
        return out
    return out.unionByName(_placed_ties(leaves, written(repeated, "repeated-words")))


def _placed_ties(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """Leaves of words that hold an id twice, or null ids: running counts of (id, digest) within the word.

    Equal rows are counted for each part of the scan, so that one digest with a third of all rows
    is neither one sort key nor one task.
    """
    many = leaves.withColumn("part", F.spark_partition_id()).join(words, ["group", "word"])
    counted = many.groupBy("group", "word", "doc_id", "leaf", "other", "before", "total", "part").agg(F.count(F.lit(1)).alias("copies"))
    ran = written(running_totals(counted, ["group", "word", "doc_id", "leaf", "part"], {"upto": "copies"}), "ties")
    start = written(ran.groupBy("group", "word").agg(F.min(F.col("upto") - F.col("copies")).alias("start")), "tie-starts")
    first = F.col("before") + F.col("upto") - F.col("copies") - F.col("start")
    return ran.join(start, ["group", "word"]).select(
        "group", F.col("total").alias("n"), F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("place"), "doc_id", "leaf", "other"
    )


# --- levels ---


def _reduced(nodes: Column, fan: int) -> Column:
    """The next level: every run of ``fan`` digests as one."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * fan + 1, fan), ""), 256))


def _beside(nodes: Column, at: Column, fan: int) -> Column:
    """The siblings of node ``at``, left and right, each joined."""
    slot, run = at % fan, at - at % fan
    return F.struct(
        F.array_join(F.slice(nodes, run + 1, slot), "").alias("l"), F.array_join(F.slice(nodes, at + 2, F.lit(fan - 1) - slot), "").alias("r")
    )


@dataclass
class Tree:
    """Blocks of slot arrays from the leaves up, and ``roots (group, root)``."""

    rounds: list[DataFrame]
    roots: DataFrame
    settings: Settings


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def grown(nodes: DataFrame, most: int, settings: Settings = Settings(), name: str = "tree") -> Tree:
    """Reduce ``nodes (group, n, place, hash, carry)``; no group has more than ``most`` nodes.

    Each round is one shuffle and cuts the nodes to a ``block``-th.
    """
    fan, block = settings.fan, settings.block
    rounds, roots = [], []
    while True:
        slots = nodes.select(
            "group", "n", F.floor(F.col("place") / block).alias("block"),
            F.struct((F.col("place") % block).cast("int").alias("slot"), "hash", "carry").alias("node"),
        )
        arrays = slots.groupBy("group", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("node")).alias("nodes"))
        levels = arrays.withColumn("l0", F.transform("nodes", lambda node: _hex(node["hash"])))
        for k in range(settings.depth):
            more = F.col("n") > fan**k  # a group with one node left has reached its root
            levels = levels.withColumn(f"l{k + 1}", F.when(more, bound(F.col(f"l{k}"), lambda a: _reduced(a, fan))))
        tops = [F.element_at(f"l{k}", 1) for k in range(settings.depth, -1, -1)]
        done = written(levels.withColumn("top", F.coalesce(*tops)), f"{name}-blocks")
        rounds.append(done)
        roots.append(done.where(F.col("n") <= block).select("group", F.col("top").alias("root")))
        if most <= block:
            return Tree(rounds, _union(roots), settings)
        nodes = done.where(F.col("n") > block).select(
            "group", F.ceil(F.col("n") / block).alias("n"), F.col("block").alias("place"), F.unhex("top").alias("hash"),
            F.lit(None).cast(nodes.schema["carry"].dataType).alias("carry"),
        )
        most = -(-most // block)


def proven(tree: Tree, above: DataFrame, name: str = "tree") -> DataFrame:
    """``hash``, ``carry``, ``path`` and the columns of ``above`` for every leaf.

    ``above (group, path, ...)`` is what lies over each group's root; it comes down with the
    path, block by block, so that the leaves of a hot group are never joined by their group.
    """
    fan, block, depth = tree.settings.fan, tree.settings.block, tree.settings.depth
    more = [c for c in above.columns if c not in ("group", "path")]

    def own(node: Column) -> Column:
        sides = [
            F.when(F.col(f"l{j + 1}").isNotNull(), _beside(F.col(f"l{j}"), F.floor(node["slot"] / fan**j).cast("int"), fan)) for j in range(depth)
        ]
        return F.filter(F.array(*sides), lambda side: side.isNotNull())

    coming = None
    for k in range(len(tree.rounds) - 1, -1, -1):
        here = tree.rounds[k]
        roots = here.where(F.col("n") <= block).select("group", "block").join(above, "group")
        coming = roots if coming is None else coming.unionByName(roots)
        nodes = F.transform(
            "nodes", lambda node: F.struct(node["slot"].alias("slot"), _hex(node["hash"]).alias("hash"), node["carry"].alias("carry"), own(node).alias("own"))
        )
        listed = here.join(coming, ["group", "block"]).select("group", "block", "path", *more, F.explode(nodes).alias("node"))
        out = listed.select(
            "group", (F.col("block") * block + F.col("node.slot")).alias("block"), "node.hash", "node.carry", F.concat("node.own", "path").alias("path"), *more
        )
        coming = written(out.drop("hash", "carry"), f"{name}-paths") if k else out
    return coming.drop("group", "block")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, side: F.sha2(F.concat(side["l"], node, side["r"]), 256))


def manifest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, other``: one row for each row of ``docs``.

    ``path`` holds the siblings ``l`` and ``r`` of every level from the leaf to the root;
    ``other`` is the leaf of the tampered row, null where nothing is tampered with.
    """
    leaves = placed(written(leaves_of(docs), "leaves"))
    nodes = written(leaves.select("group", "n", "place", F.col("leaf").alias("hash"), F.struct("doc_id", "other").alias("carry")), "nodes")
    tree = grown(nodes, nodes.agg(F.max("n")).first()[0] or 0, settings, "rows")
    names = running_totals(tree.roots.withColumn("one", F.lit(1).cast("bigint")), ["group"], {"upto": "one"})
    n = names.count()
    subroots = names.select(
        F.lit("").alias("group"), F.lit(n).cast("bigint").alias("n"), (F.col("upto") - 1).alias("place"),
        F.unhex("root").alias("hash"), F.struct(F.col("group").alias("of")).alias("carry"),
    )
    crown = grown(subroots, n, settings, "groups")
    top = crown.roots.first()
    root = F.lit(top.root if top else None).cast("string")
    side = "array<struct<l:string,r:string>>"
    bare = docs.sparkSession.createDataFrame([("", [])], f"group string, path {side}")
    above = proven(crown, bare, "groups").select(F.col("carry.of").alias("group"), "path", F.col("hash").alias("subroot"))
    return proven(tree, written(above, "group-paths"), "rows").select(
        "carry.doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "path", _hex(F.col("carry.other")).alias("other")
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = manifest(table(spark, sf_dir, "documents"))
    told = proofs.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    proof = F.array_join(F.transform("path", lambda side: F.concat(side["l"], side["r"])), "")
    return told.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


OP13_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text,
         concat(coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
                coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-')) AS front
  FROM documents
), crc AS (
  SELECT r, doc_id::VARCHAR AS s, 1 AS p, 0 AS bit, 4294967295::BIGINT AS c FROM fields WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, s, CASE WHEN bit = 7 THEN p + 1 ELSE p END, (bit + 1) % 8,
         CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT r, s, p, bit, CASE WHEN bit = 0 THEN xor(c, ascii(substr(s, p, 1))::BIGINT) ELSE c END AS x
        FROM crc WHERE p <= length(s))
), leaves AS (
  SELECT f.r, doc_id, lang, sha256(concat(front, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
         CASE WHEN xor(k.c, 4294967295) % 3 = 0 THEN
              sha256(concat(front, coalesce(concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-'))) END AS other
  FROM fields f LEFT JOIN (SELECT r, c FROM crc WHERE p > length(s)) k ON f.r = k.r
), nodes AS (
  SELECT 0 AS level, lang, row_number() OVER w - 1 AS p, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r)
  UNION ALL
  SELECT level + 1, lang, p // 8, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY level, lang, p // 8
), crown AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, lang, h, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, p // 8, NULL, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 7) // 8 FROM crown WHERE n > 1 GROUP BY level, p // 8
), sides AS (
  SELECT a.level, a.lang, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.lang IS NOT DISTINCT FROM b.lang AND a.p // 8 = b.p // 8 WHERE a.n > 1 GROUP BY ALL
), tops AS (
  SELECT a.level, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
  FROM crown a JOIN crown b ON a.level = b.level AND a.p // 8 = b.p // 8 WHERE a.n > 1 GROUP BY ALL
), climb AS (
  SELECT r, lang, 0 AS level, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS p,
         coalesce(other, leaf) AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT c.r, c.lang, c.level + 1, c.p // 8, sha256(concat(s.l, node, s.r)), concat(proof, s.l, s.r)
  FROM climb c JOIN sides s ON c.level = s.level AND c.lang IS NOT DISTINCT FROM s.lang AND c.p = s.p
), arrived AS (
  SELECT r, c.lang, node, proof, k.p AS place, k.h AS subroot
  FROM climb c JOIN (SELECT lang, level FROM nodes WHERE n = 1) e ON c.lang IS NOT DISTINCT FROM e.lang AND c.level = e.level
  JOIN (SELECT lang, p, h FROM crown WHERE level = 0) k ON c.lang IS NOT DISTINCT FROM k.lang
), ascent AS (
  SELECT r, subroot, 0 AS level, place AS p, node, proof FROM arrived
  UNION ALL
  SELECT a.r, subroot, a.level + 1, a.p // 8, sha256(concat(t.l, node, t.r)), concat(proof, t.l, t.r) FROM ascent a JOIN tops t ON a.level = t.level AND a.p = t.p
), summit AS (SELECT level, h AS root FROM crown WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM ascent JOIN summit USING (level) JOIN leaves USING (r)
"""
