"""Prefix trie of conversations with totals per node.

A conversation is the sequence of its turns (role, text); a node is a distinct sequence of first turns, from the empty
one (the root) on; the conversations that start with it are its members.

Method: splitter-skeleton. Conversations are sorted by (path, conv_id) over shards cut at sampled splitter paths. A node
that is no prefix of a splitter lies in one shard; the prefixes of the splitters, the skeleton, may lie in several. The
skeleton is broadcast; each task walks its sorted shard with a stack of open nodes, finishes every node outside the
skeleton, and writes partial totals for skeleton nodes, which one small aggregation adds up. A conversation that many
share is cut by conv_id, so a group with a third of all rows spans many shards. A task holds the open path and the
finished children of open nodes. A turn is known by 16 bytes of its SHA-256, a path by its turns' bytes; texts are read
once and never shuffled.

Bounds: the skeleton has at most ``SKELETON_TURNS`` nodes (splitters are thinned until it fits; a path of more than
``LONGEST`` turns is no splitter) and the sample about ``SAMPLE_TURNS`` turns. Both only place the cuts; they never
change the result. A conversation is one row, so its length is bounded by what a row may hold. SHA-256 goes through its
input in order: the ids of a node that many conversations end at come as strings of about ``CHUNK`` bytes, in order, and one
task hashes those.

Null role and text are empty; turns go by ``turn``, null first, then by their SHA-256; repeated rows are turns of their
own. Rows with a null conv_id are no conversation. An empty table has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.llm.common import stored

SHARD_TURNS = 100_000
SKELETON_TURNS = 100_000
SAMPLE_TURNS = 400_000
LONGEST = 1024
CHUNK = 8_000
ROWS = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()
#: What a shard writes: nodes (kind 0), partial totals of skeleton nodes (1), strings of ids that end at skeleton nodes (2).
SHARD_ROWS = """kind int, skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,
                n_leaves long, saved_tokens long, told string"""


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of a turn."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(told.cast("binary"), 256), 1, 32))


def keyed_turns(turns: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    return turns.where("conv_id is not null").select("conv_id", F.struct(
        "turn", turn_key(F.col("role"), F.col("text")).alias("key"), words.alias("words")).alias("t"))


def _as_path(conv_id: str, ts: Column) -> list[Column]:
    return [F.col(conv_id), F.transform(ts, lambda t: t["key"]).alias("path"), F.transform(ts, lambda t: t["words"]).alias("words")]


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path, words``: one row per conversation of ``conv_id, turn, role, text``."""
    convs = keyed_turns(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return convs.select(*_as_path("conv_id", F.col("ts")))


def forked_paths(turns: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """As ``paths``, with forks: conversation c begins with the first h turns of the first of its family of
    ``family`` numbers and goes on with its own after its first h; h is crc32 of its decimal number modulo ``shared``."""
    first = F.col("conv_id") - F.col("conv_id") % family
    rows = keyed_turns(turns).withColumn("first", first).repartition("first")
    convs = rows.groupBy("first", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = F.max(F.when(F.col("conv_id") == F.col("first"), F.slice("ts", 1, shared - 1))).over(Window.partitionBy("first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    convs = convs.select("conv_id", "ts", head.alias("head"), h.alias("h"))
    own = F.slice("ts", F.col("h") + 1, F.greatest(F.size("ts"), F.lit(1)))
    rebuilt = F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own))
    return convs.select("conv_id", rebuilt.alias("ts")).select(*_as_path("conv_id", F.col("ts")))


class Skeleton:
    """The trie of the splitters' paths; node 0 is the root."""

    def __init__(self, splitters: list[tuple]):
        self.cuts = [(path, conv_id) for path, conv_id, _ in splitters]
        self.children: list[dict[bytes, int]] = [{}]
        self.rows = [[0, None, 0, 0, 0, 0]]  # node, parent, depth, words, children, words of its subtree
        self.ends: set[int] = set()
        for path, _, words in splitters:
            at = 0
            for key, n in zip(path, words, strict=True):
                if key not in self.children[at]:
                    new = len(self.rows)
                    self.children[at][key] = new
                    self.children.append({})
                    self.rows.append([new, at, self.rows[at][2] + 1, n, 0, n])
                    self.rows[at][4] += 1
                at = self.children[at][key]
            self.ends.add(at)
        for row in reversed(self.rows[1:]):
            self.rows[row[1]][5] += row[5]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows],
                                     "skeleton int, parent int, depth long, words long, n_inner long, words_below long")

    def ancestors(self, spark) -> DataFrame:
        """(tip, skeleton): the childless skeleton nodes with each of their ancestors and themselves."""
        pairs = []
        for tip in self.ends | {0}:
            if not self.children[tip]:
                at = tip
                while at is not None:
                    pairs.append((tip, at))
                    at = self.rows[at][1]
        return spark.createDataFrame(pairs, "tip int, skeleton int")


def choose_splitters(convs: DataFrame, shards: int, turns: int, count: int) -> list[tuple]:
    """Up to ``shards - 1`` (path, conv_id, words), evenly spaced in a sorted sample."""
    step = max(1, count // (16 * shards), turns // SAMPLE_TURNS)
    sample = convs.where((F.pmod(F.xxhash64("conv_id", F.lit("sample")), F.lit(step)) == 0) & (F.size("path") <= LONGEST))
    found = sorted((tuple(bytes(k) for k in r.path), r.conv_id, tuple(r.words)) for r in sample.toLocalIterator())
    cuts = [found[len(found) * i // shards] for i in range(1, shards)] if found else []
    cuts = sorted(set(cuts))
    while sum(len(c[0]) for c in cuts) >= SKELETON_TURNS:
        cuts = cuts[1::2]
    return cuts


class Walk:
    """A task's way through its sorted conversations."""

    def __init__(self, children: list[dict[bytes, int]]):
        self.inner, self.out, self.path = children, [], []
        self.stack = [self._node(0, 0)]

    @staticmethod
    def _node(skeleton: int, words: int) -> dict:
        return {"skeleton": skeleton, "words": words, "n": 0, "least": None, "children": 0, "leaves": 0, "saved": 0, "ends": None,
                "waiting": []}

    def add(self, path: list[bytes], words: list[int], conv_id: int) -> None:
        same, most = 0, min(len(path), len(self.path))
        while same < most and path[same] == self.path[same]:
            same += 1
        while len(self.stack) > same + 1:
            self._close()
        for key, n in zip(path[same:], words[same:], strict=True):
            up = self.stack[-1]["skeleton"]
            self.stack.append(self._node(self.inner[up].get(key, -1) if up >= 0 else -1, n))
        self.path = path
        top = self.stack[-1]
        top["n"] += 1
        top["least"] = conv_id if top["least"] is None else min(top["least"], conv_id)
        if top["skeleton"] >= 0:
            ends = top["ends"] = top["ends"] or []
            ends.append(str(conv_id))
            if len(ends) * 8 >= CHUNK:
                self._write_ends(top)
        elif top["ends"] is None:
            top["ends"] = hashlib.sha256(str(conv_id).encode())
        else:
            top["ends"].update(b",%d" % conv_id)

    def _write_ends(self, node: dict) -> None:
        if node["ends"]:
            self.out.append((2, node["skeleton"], int(node["ends"][0]), None, None, None, None, None, None, ",".join(node["ends"])))
            node["ends"] = None

    def _close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        up = self.stack[-1] if self.stack else None
        if node["skeleton"] >= 0:
            self._write_ends(node)
            saved = node["saved"] + node["n"] * node["words"]  # less the words once, when all shards are added up
            leaves = node["leaves"]
            self.out.append((1, node["skeleton"], node["least"], None, None, node["n"], node["children"], leaves, saved, None))
        else:
            saved, leaves = node["saved"] + (node["n"] - 1) * node["words"], node["leaves"] or 1
            self.out.extend(r[:4] + (node["least"],) + r[5:] for r in node["waiting"])
            ends = node["ends"].hexdigest() if node["ends"] else EMPTY
            row = (0, None, node["least"], depth, None, node["n"], node["children"], leaves, saved, ends)
            if up["skeleton"] >= 0:
                self.out.append((0, up["skeleton"]) + row[2:])
            else:
                up["waiting"].append(row)
            up["children"] += 1
        if up:
            up["n"] += node["n"]
            up["least"] = node["least"] if up["least"] is None else min(up["least"], node["least"])
            up["leaves"] += leaves
            up["saved"] += saved

    def finish(self) -> None:
        if self.stack[0]["n"] or len(self.stack) > 1:
            while self.stack:
                self._close()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in SHARD_ROWS.split(",")]
    types = {"told": object}
    return pd.DataFrame({n: pd.array(v, dtype=types.get(n, "Int64")) for n, v in zip(names, zip(*rows), strict=True)})


def trie_nodes(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per
    node of ``conv_id`` (unique), ``path, words``. ``saved_tokens`` sums over the node's subtree (members - 1) times the words of
    a node's last turn; ``ends_sha256`` is the digest of the ids that end at the node, ascending."""
    spark = convs.sparkSession
    convs = stored(convs)
    count, turns = convs.agg(F.count("*"), F.coalesce(F.sum(F.size("path").cast("long")), F.lit(0))).first()
    shards = shards or max(2 * spark.sparkContext.defaultParallelism, -(-turns // SHARD_TURNS))
    skeleton = Skeleton(choose_splitters(convs, shards, turns, count))
    sent = spark.sparkContext.broadcast((skeleton.cuts, skeleton.children))  # at most SKELETON_TURNS nodes

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv_id: pd.Series) -> pd.Series:
        cuts = sent.value[0]
        return pd.Series([bisect_right(cuts, (tuple(p), c)) for p, c in zip(path, conv_id.tolist(), strict=True)], dtype="int32")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Walk(sent.value[1])
        for batch in batches:
            for path, words, conv_id in zip(batch["path"], batch["words"], batch["conv_id"].tolist(), strict=True):
                own.add(list(path), list(words), conv_id)
                if len(own.out) >= ROWS:
                    yield _frame(own.out)
                    own.out = []
        own.finish()
        if own.out:
            yield _frame(own.out)

    placed = convs.withColumn("shard", shard_of("path", "conv_id")).repartitionById(shards, F.col("shard"))
    done = stored(placed.sortWithinPartitions("path", "conv_id").drop("shard").mapInPandas(walk, SHARD_ROWS))
    totals = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = _skeleton_nodes(done, skeleton, totals)
    above = F.broadcast(inner.select("skeleton", F.col("conv_id").alias("above")))  # at most SKELETON_TURNS rows
    nodes = done.where("kind = 0").join(above, "skeleton", "left").select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), *totals, F.col("told").alias("ends_sha256"))
    top = inner.join(above.withColumnRenamed("skeleton", "parent"), "parent", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), *totals, "ends_sha256")
    return nodes.unionByName(top)


def _skeleton_nodes(done: DataFrame, skeleton: Skeleton, totals: list[str]) -> DataFrame:
    """The skeleton's nodes from the shards' partial totals, stored."""
    spark = done.sparkSession
    added = done.where("kind = 1").groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in totals])
    added = added.join(F.broadcast(skeleton.table(spark)), "skeleton").withColumn("n_children", F.col("n_children") + F.col("n_inner"))
    childless = added.where("n_children = 0").select(F.col("skeleton").alias("tip"))
    tips = F.broadcast(skeleton.ancestors(spark)).join(childless, "tip").groupBy("skeleton").agg(F.count("*").alias("tips"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            for node, told in zip(batch["skeleton"].tolist(), batch["told"], strict=True):
                if node != at:
                    if state:
                        yield pd.DataFrame({"skeleton": [at], "ends_sha256": [state.hexdigest()]})
                    at, state = node, hashlib.sha256(told.encode())
                else:
                    state.update(b"," + told.encode())
        if state:
            yield pd.DataFrame({"skeleton": [at], "ends_sha256": [state.hexdigest()]})

    strings = done.where("kind = 2").select("skeleton", "conv_id", "told").repartition("skeleton")
    ends = strings.sortWithinPartitions("skeleton", "conv_id").mapInPandas(hashed, "skeleton int, ends_sha256 string")
    out = added.join(tips, "skeleton", "left").join(ends, "skeleton", "left")
    return stored(out.select("skeleton", "parent", "conv_id", "depth", "n_convs", "n_children",
                             (F.col("n_leaves") + F.coalesce("tips", F.lit(0))).alias("n_leaves"),
                             (F.col("saved_tokens") - F.col("words_below")).alias("saved_tokens"),
                             F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
