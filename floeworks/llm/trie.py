"""A trie over the prefixes of conversations: Z-fast tries in the tasks, merged by node, and sums over subtrees.

A turn is a digest of role and text; a prefix of d turns has a key that chains their digests (128 bits). Each task reads its
conversations in order and inserts them, a batch at a time, into a compacted trie. Its nodes are found by a hash table
from the key of a node's handle: the prefix as long as the two-fattest number of the node's edge, that is the number of
turns on the edge divisible by the highest power of two. A fat binary search over the length of a conversation meets the node at
which it leaves the trie after as many look-ups as the length has bits; there a leaf is hung on or an edge is split. When
the task ends, or its trie has grown to KEPT nodes, edges are expanded into a row for each prefix, with the number of its
members and the smallest: what tasks found of a prefix is then one sum by key, so a prefix that all conversations
share moves one row a task.

All prefixes whose smallest member is c form one stretch of the path of c: a chain. Sums over subtrees are sums over chains:
the totals of chains go up the tree of chains by doubling (as many rounds as its depth has bits), then one running sum along
each chain gives every prefix its own.

A conversation is ordered by turn, null first, then by role and by a digest of the text; its turns are numbered in one sorted stream
that holds one turn at a time, and enter the tries in stretches of STRETCH turns, so its length isn't bounded by memory. Null roles and
texts count as empty; rows without conv_id belong to no conversation and are left out. Repeated rows are turns of their own.
Conversations without turns are members of the root. Members that end at a node are hashed from joined pieces, never held as a list.
An empty table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, written

ROOT = bytes(16)
KEPT = 200_000
STRETCH = 1024
#: Characters of one joined piece of conv_ids.
PIECE = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & -1 << ((a ^ b).bit_length() - 1)


class Node:
    """An edge of the compacted trie with its lower end: the turns start + 1 to end of a path."""

    __slots__ = ("parent", "path", "words", "start", "end", "n", "low", "below")

    def __init__(self, parent: Node | None, path: list[bytes], words: list[int], start: int, end: int):
        self.parent, self.path, self.words, self.start, self.end = parent, path, words, start, end
        self.n, self.low = 0, None
        self.below: dict[bytes, Node] = {}

    def handle(self) -> bytes:
        return self.path[two_fattest(self.start, self.end) - 1]

    def add(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)


class ZFastTrie:
    """A compacted trie of sequences of prefix keys, below a prefix of its own."""

    def __init__(self, key: bytes = ROOT, depth: int = 0):
        self.key, self.depth, self.size = key, depth, 1
        self.root = Node(None, [], [], 0, 0)
        self.handles: dict[bytes, Node] = {}
        self.nodes = [self.root]

    def locate(self, path: list[bytes]) -> tuple[Node, int]:
        """The node at which path leaves the trie, and how many turns they share."""
        node, a, b = self.root, 0, len(path)
        while a < b:
            f = two_fattest(a, b)
            met = self.handles.get(path[f - 1])
            if met is None:
                b = f - 1
            elif met.end <= len(path) and met.path[met.end - 1] == path[met.end - 1]:
                node, a = met, met.end
            else:
                return met, self._shared(met, path, f)
        if node.end < len(path) and (below := node.below.get(path[node.end])):
            return below, self._shared(below, path, node.end + 1)
        return node, node.end

    @staticmethod
    def _shared(node: Node, path: list[bytes], least: int) -> int:
        most = min(node.end, len(path))
        while least < most:
            middle = (least + most + 1) // 2
            if node.path[middle - 1] == path[middle - 1]:
                least = middle
            else:
                most = middle - 1
        return least

    def insert(self, path: list[bytes], words: list[int], n: int, low: int) -> None:
        node, shared = self.locate(path)
        if shared < node.end:
            node = self._split(node, shared)
        if shared < len(path):
            leaf = Node(node, path, words, shared, len(path))
            node.below[path[shared]] = leaf
            self.handles[leaf.handle()] = leaf
            self.nodes.append(leaf)
            self.size += len(path) - shared
            node = leaf
        node.add(n, low)

    def _split(self, node: Node, at: int) -> Node:
        upper = Node(node.parent, node.path, node.words, node.start, at)
        del self.handles[node.handle()]
        node.parent.below[node.path[node.start]] = upper
        upper.below[node.path[at]] = node
        node.parent, node.start = upper, at
        for x in (upper, node):
            self.handles[x.handle()] = x
        self.nodes.append(upper)
        return upper

    def expanded(self) -> Iterator[tuple[bytes, bytes, int, int, int, int]]:
        """key, parent's key, depth, members, smallest member and words of each prefix; the trie's own prefix only if it is the root."""
        for node in sorted(self.nodes, key=lambda x: -x.end):
            if node.parent is None:
                if self.depth == 0:
                    yield self.key, None, 0, node.n, node.low, 0
                continue
            node.parent.add(node.n, node.low)
            for t in range(node.start, node.end):
                yield node.path[t], node.path[t - 1] if t else self.key, self.depth + t + 1, node.n, node.low, node.words[t]


class Tries:
    """The tries of a task: one below the root, and one below each prefix at which a long conversation is continued."""

    def __init__(self, stretch: int = STRETCH):
        self.stretch, self.tries, self.waiting = stretch, {}, {}

    def insert(self, key: bytes, depth: int, path: list[bytes], words: list[int], conv: int) -> None:
        """Kept until the batch ends; equal paths are inserted once."""
        x = self.waiting.setdefault((key, depth, path[-1] if path else key), [path, words, 0, conv])
        x[2] += 1
        x[3] = min(x[3], conv)

    def settle(self) -> None:
        for (key, depth, _), (path, words, n, low) in self.waiting.items():
            if (key, depth) not in self.tries:
                self.tries[key, depth] = ZFastTrie(key, depth)
            self.tries[key, depth].insert(path, words, n, low)
        self.waiting = {}

    def size(self) -> int:
        return sum(t.size for t in self.tries.values())

    def empty(self) -> Iterator[tuple]:
        for t in self.tries.values():
            yield from t.expanded()
        self.tries = {}


RAW = "key binary, parent binary, depth int, n long, conv_id long, words long"
_RAW = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("n", pa.int64()), ("conv_id", pa.int64()), ("words", pa.int64())])


def _insert(batches: Iterator[pa.RecordBatch], kept: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """conv_id, pos, digest, words in order (pos 0 begins a conversation) -> RAW; rows without n say where a conversation ends."""
    tries, conv, key, at, path, words = Tries(stretch), None, ROOT, 0, [], []
    ends: list[tuple] = []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RAW)], schema=_RAW)

    def over() -> None:
        if path or not at:
            tries.insert(path_key, at, path, words, conv)
        ends.append((key, None, at + len(path), None, conv, None))

    path_key = ROOT
    for b in batches:
        for c, pos, digest, n in zip(*(b.column(k).to_pylist() for k in ("conv_id", "pos", "digest", "words"))):
            if not pos:
                if conv is not None:
                    over()
                conv, key, path_key, at, path, words = c, ROOT, ROOT, 0, [], []
                continue
            if len(path) == stretch:
                tries.insert(path_key, at, path, words, conv)
                path_key, at, path, words = key, at + stretch, [], []
            key = hashlib.blake2b(key + digest, digest_size=16).digest()
            path.append(key)
            words.append(n)
        tries.settle()
        if ends:
            yield batch(ends)
            ends = []
        if tries.size() > kept:
            yield batch(list(tries.empty()))
    if conv is not None:
        over()
        tries.settle()
        yield batch(ends)
        yield batch(list(tries.empty()))


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest of the text, digest of both and words: what the trie needs of each row, texts left behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("text_digest"), F.unhex(F.md5(both)).alias("digest"), words.alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """digested() turns with their place in the conversation, from 1."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text_digest")
    return turns.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "digest", "words")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ids (joined) in order -> key, ends_sha256."""
    now, sha = None, None
    for b in batches:
        done = []
        for key, ids in zip(*(b.column(k).to_pylist() for k in ("key", "ids"))):
            if key != now:
                if sha:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["key", "ends_sha256"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, conv_id in order -> key, first (conv_id), ids: pieces of at most about PIECE characters."""
    now, first, ids, size = None, None, [], 0
    for b in batches:
        out: list[tuple] = []
        for key, conv in zip(*(b.column(k).to_pylist() for k in ("key", "conv_id"))):
            if ids and (key != now or size > PIECE):
                out.append((now, first, ",".join(ids)))
                ids = []
            if not ids:
                now, first, size = key, conv, 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], ["key", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["key", "first", "ids"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """key and SHA-256 of the conv_ids, ascending and joined by commas. Joining is dealt by ranges, so a crowded node is many tasks."""
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = ends.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_joined, "key binary, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digest, "key binary, ends_sha256 string")


def _chain_totals(chains: DataFrame) -> DataFrame:
    """chain, up (the chain it hangs on), leaves, saved -> chain, leaves, saved of it and all that hang below it.

    After k rounds a chain has the sums of all less than 2**k steps below it and knows the chain 2**k steps above it.
    """
    now = written(chains)
    while not now.where("up IS NOT NULL").isEmpty():
        gain = now.where("up IS NOT NULL").groupBy(F.col("up").alias("chain")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = now.select(F.col("chain").alias("up"), F.col("up").alias("next"))
        now = now.join(gain, "chain", "left").join(above, "up", "left").select(
            "chain", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
        )
        now = written(now)
        release(now.sparkSession)
    return now.select("chain", "leaves", "saved")


def nodes(turns: DataFrame, members: DataFrame, kept: int = KEPT, stretch: int = STRETCH) -> DataFrame:
    """The nodes of the trie of turns (conv_id, pos from 1 without gaps, digest, words); members: the conv_ids of all conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    begins = members.select("conv_id").distinct().select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("words"))
    rows = turns.select("conv_id", "pos", "digest", "words").unionByName(begins)
    raw = written(rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(lambda b: _insert(b, kept, stretch), RAW))
    found = raw.where("n IS NOT NULL").groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"))
    chain = Window.partitionBy("conv_id").orderBy("depth")
    found = written(found.withColumn("top", F.lag("depth").over(chain).isNull()).withColumn("goes_on", F.lead("depth").over(chain).isNotNull()))
    # where chains hang: the parents of their first nodes
    parents = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"), F.col("depth").alias("up_depth"))
    hung = written(found.where("top AND depth > 0").select("parent", F.col("conv_id").alias("chain")).join(parents, "parent").select("chain", "up", "up_depth"))
    at = ["conv_id", "depth"]
    named = {"up": "conv_id", "up_depth": "depth"}
    tops = hung.groupBy("up", "up_depth").agg(F.count(F.lit(1)).alias("tops")).withColumnsRenamed(named)
    own = found.join(tops, at, "left").withColumn("n_children", F.coalesce("tops", F.lit(0)) + F.col("goes_on").cast("long"))
    own = own.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n") - 1) * F.col("words"))
    own = written(own.select("key", *at, "n", "top", "n_children", "leaf", "own"))
    sums = own.groupBy(F.col("conv_id").alias("chain")).agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    totals = _chain_totals(sums.join(hung, "chain", "left").select("chain", "up", "leaves", "saved"))
    below = totals.join(hung, "chain").groupBy("up", "up_depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumnsRenamed(named)
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(below, at, "left").join(hung.select(F.col("chain").alias("conv_id"), "up"), "conv_id", "left").join(ends_digests(raw.where("n IS NULL").select("key", "conv_id")), "key", "left")
    return out.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.when(F.col("top"), F.col("up")).otherwise(F.col("conv_id"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.sum(F.col("leaf") + F.coalesce("leaves", F.lit(0))).over(up).alias("n_leaves"),
        F.sum(F.col("own") + F.coalesce("saved", F.lit(0))).over(up).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, step: int = 20, most: int = 4) -> DataFrame:
    """numbered() turns of every conversation c behind the first h turns of conversation c - c % step, in place of its own first h.

    h is crc32 of the decimal c modulo most, so at most most - 1 turns of a conversation are copied, to step conversations at most.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    own = turns.where(F.col("pos") > h)
    base = turns.where((F.col("pos") < most) & (F.col("conv_id") % step == 0)).withColumnRenamed("conv_id", "base")
    taken = turns.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % step).join(base, "base").where("pos <= h")
    shifted = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("copied"))
    # own turns close up to the copied ones, where the base has fewer than h
    own = own.join(shifted, "conv_id", "left").withColumn("pos", F.col("pos") - h + F.coalesce("copied", F.lit(0)))
    return own.select("conv_id", F.col("pos").cast("int").alias("pos"), "digest", "words").unionByName(taken.select("conv_id", "pos", "digest", "words"))
