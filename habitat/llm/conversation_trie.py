"""A prefix trie of conversations as balanced parentheses, one sequence for each shard.

1. Turns are numbered by range partitions of (conversation, turn): counts of the partitions give the offset where a
   conversation goes on in the next one, so a long one is not gathered. Each prefix gets a 128-bit print, the running exclusive-or of
   hashes of (depth, turn), taken in chunks for the same reason. Nodes are the distinct prints; two different prefixes
   share one with a chance of about n * n / 2^129.
2. Nodes with the same members form a chain, named by its smallest member and its number of members. A turn of only one conversation and all behind it
   are one chain. Only the tops of chains enter the trie, so a path is at most about the square root of twice all turns long.
3. Distinct sequences, sorted by their paths, are cut into shards. A shard is a balanced-parentheses sequence with the excess
   at each place and the least excess of blocks. ``find_close`` delimits subtrees, the rank of leaf pairs counts leaves, and cumulative sums give the savings.
4. Chains that two shards share (the spines at their edges) appear in both. What belongs to a chain itself is counted
   only where its smallest member is, so the parts of all shards add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitat.llm.common import WORD, cut

#: Turns in a chunk of the running prints, parentheses in a block, chains of a shard.
CHUNK, BLOCK, SHARD = 4096, 256, 1 << 18
NODE = ["d", "a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with range min-max blocks over its excess."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK) -> None:
        self.bits, self.block = bits.astype(np.int8), block
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        blocks = max(1, -(-len(bits) // block))
        # Padded with an excess that no search looks for.
        padded = np.full(blocks * block, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(blocks, block)
        #: Least excess of each block, of pairs of blocks, of fours and so on.
        self.least = [self.rows.min(axis=1)]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.least.append(np.minimum(low[::2], low[1::2]))

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The place that closes each opening one: the first behind it with an excess one lower than its own."""
        out = np.empty(len(opens), dtype=np.int64)
        step = 1 << 12
        for at in range(0, len(opens), step):
            out[at : at + step] = self._close(opens[at : at + step])
        return out

    def _close(self, opens: np.ndarray) -> np.ndarray:
        goal = self.excess[opens] - 1
        home = opens // self.block
        own = (self.rows[home] <= goal[:, None]) & (np.arange(self.block) > (opens % self.block)[:, None])
        found, inside = own.any(axis=1), own.argmax(axis=1)
        # Up to the first later block that goes low enough, then down to its leftmost one.
        node, level = home + 1, np.zeros(len(opens), dtype=np.int64)
        active = ~found
        for depth, low in enumerate(self.least):
            here = active & (level == depth)
            safe = np.minimum(node, len(low) - 1)
            good = here & (node < len(low)) & (low[safe] <= goal)
            active &= ~good
            up = here & ~good
            # An even node's pair holds it and its right neighbour; an odd one goes on behind its pair.
            node[up] = np.where(node[up] % 2 == 0, node[up] // 2, node[up] // 2 + 1)
            level[up] = depth + 1
        for depth in range(len(self.least) - 1, 0, -1):
            here = ~found & (level == depth)
            left = np.minimum(2 * node, len(self.least[depth - 1]) - 1)
            first = self.least[depth - 1][left] <= goal
            node[here] = np.where(first[here], 2 * node[here], 2 * node[here] + 1)
            level[here] = depth - 1
        block = np.where(found, home, node)
        far = (self.rows[np.minimum(block, len(self.rows) - 1)] <= goal[:, None]).argmax(axis=1)
        return block * self.block + np.where(found, inside, far)

    def leaf_rank(self) -> np.ndarray:
        """Leaf pairs that open up to each place."""
        pair = np.zeros(len(self.bits), dtype=np.int64)
        pair[:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        return np.cumsum(pair)


def shard_sums(root: tuple[int, int, int], reps: list[int], leaves: list[bool], paths: list[list[tuple[int, int, int]]]) -> list[tuple]:
    """(member, members, leaves, saved, children) of each chain in a run of sorted sequences.

    A path holds (smallest member, members, own saving) of the chains below the root, and ``reps`` the sequences' smallest members.
    """
    bits, names, gains, children, opens = [1], [root[:2]], [0], [0], [0]
    stack, path = [0], []
    for rep, own in zip(reps, paths):
        same = 0
        while same < len(path) and same < len(own) and path[same][:2] == own[same][:2]:
            same += 1
        bits.extend([0] * (len(path) - same))
        del stack[same + 1 :]
        for chain in own[same:]:
            stack.append(len(names))
            opens.append(len(bits))
            bits.append(1)
            names.append(chain[:2])
            gains.append(0)
            children.append(0)
        path = own
        if rep == root[0]:
            gains[0] += root[2]
        for k, (member, _, gain) in enumerate(own):
            if member == rep:
                gains[stack[k + 1]] += gain
                children[stack[k]] += 1
    last = len(bits) - 1
    bits.extend([0] * (len(path) + 1))
    sequence = Parentheses(np.array(bits))
    at = np.array(opens)
    end = sequence.find_close(at)
    rank = sequence.leaf_rank()
    # Only the last sequence may end in a chain whose children are in the next shard.
    if not leaves[-1]:
        rank[last:] -= 1
    saved = np.zeros(len(bits), dtype=np.int64)
    saved[at] = gains
    saved = np.cumsum(saved)
    before = np.maximum(at - 1, 0)
    n_leaves = rank[end] - np.where(at > 0, rank[before], 0)
    total = saved[end] - np.where(at > 0, saved[before], 0)
    return [(*name, *rest) for name, *rest in zip(names, n_leaves.tolist(), total.tolist(), children)]


def numbered(table: DataFrame) -> DataFrame:
    """(conv_id, pos, sha, words): turns of each conversation from 1 on; no conversation is gathered in one task."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = table.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("sha")]
    dealt = cut(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition edge inside of a conversation.
    offsets = dealt.groupBy("conv_id", "part").count().withColumn("offset", F.sum("count").over(before)).filter("offset > 0").drop("count")
    local = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    out = local.join(offsets, ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("pos") + F.coalesce("offset", F.lit(0))).cast("long").alias("pos"), "sha", "words")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, d, sha, words): the first h turns of conversation c - c % group, then c's own behind its first h; h = crc32(c) % heads.

    Each conversation also has a row of depth 0.
    """
    ids = turns.select("conv_id").distinct()
    ids = ids.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % heads, "base": F.col("conv_id") - F.col("conv_id") % group})
    starts = turns.filter((F.col("pos") < heads) & (F.col("conv_id") % group == 0))
    starts = starts.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "sha", "words"))).alias("head"))
    plan = ids.join(starts, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")))
    taken = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("d"), "t.sha", "t.words")
    own = turns.join(plan.select("conv_id", "h", F.size("head").alias("n")), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).cast("long").alias("d"), "sha", "words")
    root = ids.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit("").alias("sha"), F.lit(0).cast("long").alias("words"))
    return taken.unionByName(own).unionByName(root)


def _prints(rows: DataFrame) -> DataFrame:
    """(conv_id, d, a, b, w, words, pa, pb): print of each prefix, words up to it, and the print of the prefix before it."""
    plain = F.col("d") == 0
    rows = rows.withColumns({
        "xa": F.when(plain, F.lit(0)).otherwise(F.xxhash64("d", "sha")).cast("long"),
        "xb": F.when(plain, F.lit(0)).otherwise(F.xxhash64(F.lit("other"), "sha", "d")).cast("long"),
        "chunk": F.floor(F.col("d") / CHUNK),
    })
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"a": F.expr("bit_xor(xa)"), "b": F.expr("bit_xor(xb)"), "w": F.sum("words")}
    chunks = rows.groupBy("conv_id", "chunk").agg(*[v.alias(k) for k, v in sums.items()])
    chunks = chunks.select("conv_id", "chunk", F.bit_xor("a").over(before).alias("oa"), F.bit_xor("b").over(before).alias("ob"), F.sum("w").over(before).alias("ow"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"ia": F.bit_xor("xa").over(inside), "ib": F.bit_xor("xb").over(inside), "iw": F.sum("words").over(inside)})
    rows = rows.join(chunks.filter("chunk > 0"), ["conv_id", "chunk"], "left")

    def plus(own: str, earlier: str) -> Column:
        return F.col(own).bitwiseXOR(F.coalesce(earlier, F.lit(0).cast("long")))

    rows = rows.withColumns({"a": plus("ia", "oa"), "b": plus("ib", "ob"), "w": F.col("iw") + F.coalesce("ow", F.lit(0))})
    return rows.select("conv_id", "d", "a", "b", "w", "words", F.col("a").bitwiseXOR(F.col("xa")).alias("pa"), F.col("b").bitwiseXOR(F.col("xb")).alias("pb"))


def _digests(ends: DataFrame) -> DataFrame:
    """(d, a, b, ends_sha256): members that end at a node, hashed as a stream in the order of their ids."""
    sorted_ends = ends.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in NODE])
            ids = batch.column("conv_id").to_pylist()
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
            done = []
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                key = tuple(keys[:, x].tolist())
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids[x:y])).encode())
            yield _batch(done)
        if now is not None:
            yield _batch([(*now, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*NODE, "ends_sha256"])

    return sorted_ends.mapInArrow(run, "d long, a long, b long, ends_sha256 string")


def _chain_sums(paths: DataFrame, root: tuple[int, int, int]) -> DataFrame:
    """(m, n, leaves, saved, children) of every chain: the sums of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, leaves, own, size = [], [], [], 0
        for batch in batches:
            for rep, leaf, path in zip(*(batch.column(c).to_pylist() for c in ("rep", "leaf", "path"))):
                reps.append(rep)
                leaves.append(leaf)
                own.append([(c["m"], c["n"], c["gain"]) for c in path])
                size += 1 + len(path)
                if size >= SHARD:
                    yield _sums(reps, leaves, own)
                    reps, leaves, own, size = [], [], [], 0
        if reps:
            yield _sums(reps, leaves, own)

    def _sums(reps: list, leaves: list, own: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*shard_sums(root, reps, leaves, own))], ["m", "n", "leaves", "saved", "children"])

    key = F.transform("path", lambda c: F.struct(c["m"], c["n"]))
    ordered = paths.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key").select("rep", "leaf", "path")
    parts = ordered.mapInArrow(run, "m long, n long, leaves long, saved long, children long")
    return parts.groupBy("m", "n").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, d, sha, words; depths from 0, the root's row, without gaps).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = cut(_prints(rows))
    nodes = rows.groupBy(*NODE).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("m"), *[F.max(c).alias(c) for c in ("w", "words", "pa", "pb")]
    )
    nodes = cut(nodes)
    top = nodes.filter("d = 0").first()
    if top is None:
        schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return rows.sparkSession.createDataFrame([], schema)
    # The root is every first turn's parent and needs no join.
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("m").alias("pm"), F.col("n").alias("pn"))
    first = nodes.filter("d <= 1").withColumns({
        "pm": F.when(F.col("d") == 1, F.lit(top.m)).cast("long"), "pn": F.when(F.col("d") == 1, F.lit(top.n)).cast("long")})
    nodes = cut(nodes.filter("d > 1").join(above, ["d", "pa", "pb"]).unionByName(first))
    chains = nodes.groupBy("m", "n").agg(F.max("d").alias("bottom"), F.max("w").alias("last"), F.min(F.col("w") - F.col("words")).alias("first"))
    chains = cut(chains.withColumn("gain", (F.col("n") - 1) * (F.col("last") - F.col("first"))))
    ends = cut(rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("e")).select("conv_id", "e.*"))

    reps = ends.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count("*").alias("ending"))
    reps = cut(reps.join(nodes.select(*NODE, "n"), NODE).select("rep", (F.col("ending") == F.col("n")).alias("leaf")))
    tops = nodes.filter("d > 0 and n <> pn").select(*NODE, "m", "n").join(chains.select("m", "n", "gain"), ["m", "n"])
    steps = rows.filter("d > 0").join(reps.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").join(tops, NODE)
    paths = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("d", "m", "n", "gain"))).alias("path"))
    paths = reps.join(paths, F.col("rep") == F.col("conv_id"), "left").select("rep", "leaf", F.coalesce("path", F.array()).alias("path"))
    own = chains.filter((F.col("m") == top.m) & (F.col("n") == top.n)).first()
    sums = _chain_sums(cut(paths), (top.m, top.n, own.gain))

    out = nodes.join(chains, ["m", "n"]).join(sums, ["m", "n"]).join(_digests(ends), NODE, "left")
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("pm").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("d") < F.col("bottom"), F.lit(1)).otherwise(F.col("children")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("w") - F.col("words") - F.col("first"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(table: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of ``table`` (conv_id, turn, role, text); other columns are not read.

    A null role or text is empty; rows without conv_id take no part. The remainder of an id below 0 has its sign, as in SQL. Turns go by turn, null first, and equal ones by a digest of role
    and text; rows that repeat are turns of their own. An empty table gives no nodes. Members that end at one node are hashed
    in one stream of bounded memory, as SHA-256 asks for.
    """
    return trie(rebuilt(cut(numbered(table))))
