"""Merkle manifest of a table: leaf digests, one tree per group, one tree over the groups' roots, proofs.

A leaf is the SHA-256 of a row's fields. Within a group leaves ascend by id; every ``ARITY`` consecutive nodes (the last
run may have fewer) become the digest of their hex strings, until one node is left. The groups' roots, in order of the
group (null first, by UTF-8 bytes), make the root in the same way.

Method: concatenated-level strings. Each aligned block of ``ARITY ** height`` nodes is one row that holds every level
below its top as one string of hex digests. Fixed-width substrings of a level are the inputs of its parents; the
substrings on both sides of a node within its run are its siblings. The tops of the blocks are the nodes of the next
round, until every group has one. On the way down a block's row is joined with its own top's siblings before its
rows are written out, so joins are between blocks, never between rows.

Rows are numbered in their group by a range sort of all leaves (group, id, leaf, row), so a group with a third of all
rows, an id that many rows share and repeated rows are cut across tasks; positions come from counts per (task, group).
All functions are Spark expressions; the tables of leaves, of numbered leaves and of blocks are stored in the shared
folder. The driver sees one number, the size of the largest group.

Null fields are told from empty ones (``-`` and ``0:``). Rows with a null id come first in their group, rows of one id
go by leaf; repeated rows are leaves of their own. A null group is a group. An empty table gives an empty manifest.
Columns that are no field are ignored; a field the table lacks is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.llm.common import stored

ARITY = 3
HEIGHT = 5
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"
_ROW_BITS = 33  # of monotonically_increasing_id: the row's number within its task


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    def told(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return digest(F.concat(*map(told, fields)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, 2 ... in its group by ``order``, nulls first) and ``n``, the group's size."""
    row = F.monotonically_increasing_id()
    ranged = rows.withColumn("__copy", row).repartitionByRange(group, *order, "__copy")
    at = stored(ranged.sortWithinPartitions(group, *order, "__copy").drop("__copy").withColumn("__at", row))
    at = at.withColumn("__task", F.shiftright("__at", _ROW_BITS))
    parts = at.groupBy(group, "__task").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    own = Window.partitionBy(group)
    before = own.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "__task", (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__move"),
                         F.sum("__rows").over(own).alias("n"))
    return at.join(parts, [group, "__task"]).withColumn("pos", F.col("__at") + F.col("__move")).drop(
        "__at", "__task", "__move")


def _heights(n: Column) -> Column:
    """Levels between ``n`` nodes and one."""
    powers = F.array(*[F.lit(ARITY ** k) for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def _parents(level: Column) -> Column:
    runs = F.floor((F.octet_length(level) - 1) / (ARITY * WIDTH)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs), lambda i: F.sha2(
        F.substring(level, i * (ARITY * WIDTH) + 1, F.lit(ARITY * WIDTH)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Aligned blocks of ``group, pos, n, node`` and whatever else (as ``carry``): the block's nodes in order, its levels
    and its top."""
    size = ARITY ** height
    carry = [c for c in nodes.columns if c not in ("group", "pos", "n", "node")]
    item = F.struct((F.col("pos") % size).cast("int").alias("slot"), "node", F.struct(*carry, F.lit(0).alias("__")).alias("carry"))
    out = nodes.groupBy("group", F.floor(F.col("pos") / size).alias("block"), "n").agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = out.withColumn("up", F.least(F.lit(height), _heights(F.col("n"))))
    out = out.withColumn("l0", F.array_join(F.transform("items", lambda x: x["node"]), "").cast("binary"))
    for j in range(height):
        out = out.withColumn(f"l{j + 1}", F.when(F.col("up") > j, _parents(F.col(f"l{j}"))))
    top = F.coalesce(*[F.col(f"l{j}") for j in range(height, -1, -1)]).cast("string")
    return out.select("group", "block", "n", "up", "items", *[f"l{j}" for j in range(height)], top.alias("top"))


def _ascend(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The blocks of every round, lowest first; the last round has one block a group."""
    size, rounds = ARITY ** height, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = stored(_blocks(nodes, height))
        rounds.append(blocks)
        if most <= size:
            return rounds
        most = -(-most // size)
        nodes = blocks.select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))


def _descend(rounds: list[DataFrame], height: int, above: DataFrame) -> DataFrame:
    """The nodes of the lowest round with ``above``'s columns and ``path``. ``above``: group, path and more."""
    def flanks(slot: Column, j: int) -> Column:
        place = F.floor(slot / ARITY ** j).cast("int")
        level, inside = F.col(f"l{j}"), place % ARITY
        before = F.substring(level, (place - inside) * WIDTH + 1, inside * WIDTH)
        after = F.substring(level, (place + 1) * WIDTH + 1, (ARITY - 1 - inside) * WIDTH)
        return F.struct(before.cast("string").alias("before"), after.cast("string").alias("after"))

    known, size = above.withColumn("pos", F.lit(0).cast("long")), ARITY ** height
    for blocks in reversed(rounds):
        told = blocks.join(known.withColumnRenamed("pos", "block"), ["group", "block"])
        more = [c for c in above.columns if c not in ("group", "path")]
        out = F.transform("items", lambda x: F.struct(
            (F.col("block") * size + x["slot"]).alias("pos"), x["node"].alias("node"), x["carry"].alias("carry"),
            F.concat(F.slice(F.array(*[flanks(x["slot"], j) for j in range(height)]), F.lit(1), F.col("up")), F.col("path")).alias("path")))
        lowest = told.select("group", *more, F.inline(out))
        known = lowest.select("group", "pos", "path", *more)
    return lowest


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id",
             carry: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """``key, group, pos, leaf, subroot, root, path`` and the columns ``carry`` for every row of ``docs``. ``path`` has
    per level the digests before and after the node in its run, from the leaf to the root."""
    carry = carry or {}
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # keeps null, first, and the order
    leaves = stored(docs.select(named.alias("group"), F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("node"),
                                F.struct(F.lit(0).alias("__"), *[c.alias(name) for name, c in carry.items()]).alias("own")))
    rounds = _ascend(numbered(leaves, "group", ["key", "node"]), height)
    tops = rounds[-1].select(F.lit("").alias("all"), F.col("group").alias("name"), F.col("top").alias("node"))
    over = _ascend(numbered(tops, "all", ["name"]).withColumnRenamed("all", "group"), height)
    root = over[-1].select("group", F.col("top").alias("root"), F.lit(None).cast(_PATH).alias("path"))
    root = root.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    groups = _descend(over, height, root).select(F.col("carry.name").alias("group"), F.col("node").alias("subroot"), "root", "path")
    out = _descend(rounds, height, groups)
    return out.select(F.col("carry.key").alias(key), F.when(F.col("group") != "", F.substring("group", 2, 1 << 30)).alias(group), "pos",
                      F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(f"carry.own.`{c}`").alias(c) for c in carry])
