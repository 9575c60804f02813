"""Prefix trie of conversations by adaptive radix trees over turn ids.

Every turn becomes a big-endian id of fixed width: 128 bits of the SHA-256 of its
role and text, then its number of words in 32 bits. A conversation's key is its
turn ids in a row, so a conversation is one row of 20 bytes a turn; texts end there.

Keys are range-partitioned in their order. A task builds an adaptive radix tree of a
block of keys at a time (nodes of 4, 16, 48 and 256 children, paths of single
children compressed) and emits a row for every turn-aligned depth of its paths; other
byte depths emit nothing. Only prefixes of a block's first and last key can go on in
another block: they leave as partial sums, which are added up by prefix. What two
neighbouring blocks share is counted in both, and a small job over the blocks' first
and last keys takes it off again. No group of copies needs a task of its own.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parallelism

WIDTH = 20  # bytes of a turn id
WORD_BYTES = 4  # its last bytes, the number of words
BLOCK_BYTES = 32 << 20  # keys of a tree
BLOCK_ROWS = 1 << 15
SALTS = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame, near, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, near, turns): the turn ids, in hexadecimal, of every conversation in the
    order of turn (null first), role and text. Null roles and texts are empty ones;
    rows without a conversation id belong to none. ``near`` is an expression of ``id``
    whose rows shall lie together."""
    t = rows.select(F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("id").isNotNull())
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    tid = F.concat(F.upper(F.substring(digest, 1, 2 * (WIDTH - WORD_BYTES))), F.lpad(F.hex(words), 2 * WORD_BYTES, "0"))
    t = t.withColumn("tid", tid).withColumn("near", near).repartition(parallelism(rows.sparkSession), "near")
    order = Window.partitionBy("near", "id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = t.select("near", "id", "tid", F.row_number().over(order).alias("pos"))
    both = F.sort_array(F.collect_list(F.struct("pos", "tid")))
    return placed.groupBy("near", "id").agg(F.transform(both, lambda x: x["tid"]).alias("turns"))


def rebuilt(rows: DataFrame, every: int, heads: int) -> DataFrame:
    """(id, turns) of conversations that share their beginnings: conversation c takes the
    first h turns of conversation c - c % every, then its own after its first h, with
    h = crc32(c in decimal) % heads."""
    own = sequences(rows, F.col("id") - F.col("id") % F.lit(every))
    head = F.max(F.when(F.col("id") == F.col("near"), F.slice("turns", 1, heads - 1))).over(Window.partitionBy("near"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % heads).cast("int")
    all_turns = F.concat(F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), F.col("_h")),
                         F.slice("turns", F.col("_h") + 1, F.size("turns")))
    return own.withColumn("_head", head).withColumn("_h", h).select("id", all_turns.alias("turns"))


class Node:
    """A node of the radix tree: all keys below begin with ``key[:depth]``."""

    __slots__ = ("key", "depth", "room", "labels", "kids", "ends", "n", "least", "leaves", "saved", "tops")

    def __init__(self, key: bytes, depth: int):
        self.key, self.depth, self.room = key, depth, 4
        self.labels, self.kids, self.ends = bytearray(), [], []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            i = self.labels.find(byte)
            return self.kids[i] if i >= 0 else None
        if self.room == 48:
            i = self.labels[byte]
            return self.kids[i] if i != 255 else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """A new child, or another in the place of one."""
        if self.room <= 16:
            i = self.labels.find(byte)
            if i >= 0:
                self.kids[i] = kid
                return
            if len(self.kids) < self.room:
                self.labels.append(byte)
                self.kids.append(kid)
                return
        elif self.room == 48:
            i = self.labels[byte]
            if i != 255:
                self.kids[i] = kid
                return
            if len(self.kids) < 48:
                self.labels[byte] = len(self.kids)
                self.kids.append(kid)
                return
        else:
            self.kids[byte] = kid
            return
        self.grow()
        self.put(byte, kid)

    def grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:  # from here on a table of places by byte
            places = bytearray(b"\xff" * 256)
            for i, b in enumerate(self.labels):
                places[b] = i
            self.room, self.labels = 48, places
        else:
            self.room, self.kids = 256, [self.kids[i] if i != 255 else None for i in self.labels]

    def children(self) -> list[Node]:
        return self.kids if self.room < 256 else [k for k in self.kids if k is not None]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differs.bit_length() + 7) // 8


def insert(root: Node, key: bytes) -> Node:
    """The node in which ``key`` ends."""
    node = root
    while len(key) > node.depth:
        byte = key[node.depth]
        kid = node.child(byte)
        if kid is None:
            kid = Node(key, len(key))
            node.put(byte, kid)
            return kid
        stop = min(kid.depth, len(key))
        if key[node.depth: stop] != kid.key[node.depth: stop] or stop < kid.depth:
            at = node.depth + shared(key[node.depth: stop], kid.key[node.depth: stop])
            fork = Node(kid.key, at)  # the compressed path splits here
            fork.put(kid.key[at], kid)
            node.put(byte, fork)
            kid = fork
        node = kid
    return node


def path(root: Node, key: bytes) -> set[int]:
    """Identities of the nodes on the way to ``key``."""
    node, out = root, {id(root)}
    while node.depth < len(key):
        node = node.child(key[node.depth])
        out.add(id(node))
    return out


def words(key: bytes, depth: int) -> int:
    """Words of the turn that ends at a turn depth."""
    return int.from_bytes(key[depth * WIDTH - WORD_BYTES: depth * WIDTH], "big") if depth else 0


def prefixes(key: bytes) -> list[str]:
    """Digests of the turn-aligned prefixes, from the empty one on."""
    h, out = hashlib.sha256(), [NO_ENDS]
    for at in range(0, len(key), WIDTH):
        h.update(key[at: at + WIDTH])
        out.append(h.hexdigest())
    return out


_ROW = ("kind int, part long, depth long, id long, parent_id long, node string, parent string, n_convs long, n_children long, "
        "n_leaves long, saved long, ends string, first binary, last binary")
_FIELDS = [f.split()[0] for f in _ROW.split(", ")]
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t])
                    for n, t in (f.split() for f in _ROW.split(", "))])
CLOSED, OPEN, EDGE, ENDS = range(4)


def block_rows(part: int, keys: list[tuple[bytes, list[int]]]) -> Iterator[tuple]:
    """Rows of a block of sorted distinct keys with the sorted ids that end there."""
    root = Node(b"", 0)
    for key, ids in keys:
        insert(root, key).ends = ids
    first, last = keys[0][0], keys[-1][0]
    yield (EDGE, part, *[None] * 10, first, last)
    on_first, on_last = path(root, first), path(root, last)
    names_first, names_last = prefixes(first), prefixes(last)
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(x.children())
    top = {id(k): x for x in order for k in x.children()}
    below: dict[int, int] = {}  # turn-level children under the end of a node's path
    for x in reversed(order):
        kids = x.children()
        x.n = len(x.ends) + sum(k.n for k in kids)
        x.least = min([*x.ends[:1], *(k.least for k in kids)])
        x.leaves = sum(k.leaves for k in kids) if kids else 1
        x.saved = sum(k.saved for k in kids)
        below[id(x)] = sum(k.tops for k in kids)
        start = 0 if x is root else top[id(x)].depth // WIDTH + 1
        turns = range(start, x.depth // WIDTH + 1)
        x.saved += sum((x.n - 1) * words(x.key, d) for d in turns)
        x.tops = 1 if len(turns) else below[id(x)]
    over: dict[int, tuple[int | None, str | None]] = {}  # (id, name if open) of the turn-level node at or above a node's end
    for x in order:
        parent_id, parent = (None, None) if x is root else over[id(top[id(x)])]
        start = 0 if x is root else top[id(x)].depth // WIDTH + 1
        stop = x.depth // WIDTH
        names = names_first if id(x) in on_first else names_last if id(x) in on_last else None
        saved = x.saved
        for d in range(start, stop + 1):
            children = below[id(x)] if d == stop else 1
            ends = x.ends if d * WIDTH == x.depth else []
            if names is None:
                digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else NO_ENDS
                yield (CLOSED, part, d, x.least, None if parent else parent_id, None, parent, x.n, children, x.leaves, saved, digest, None, None)
            else:
                yield (OPEN, part, d, x.least, None, names[d], parent, x.n, children, x.leaves, saved, None, None, None)
                if ends:
                    yield (ENDS, part, d, None, None, names[d], None, None, None, None, None, ",".join(map(str, ends)), None, None)
            parent_id, parent = x.least, names[d] if names else None
            saved -= (x.n - 1) * words(x.key, d)
        over[id(x)] = (parent_id, parent)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bytes, list[int]]]]]:
    keys: list[tuple[bytes, list[int]]] = []
    size = rows = number = 0
    part = 0
    for b in batches:
        for part, key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if size > BLOCK_BYTES or rows >= BLOCK_ROWS:
                yield (part << 32) + number, keys
                keys, size, rows, number = [], 0, 0, number + 1
            if keys and keys[-1][0] == key:
                keys[-1][1].append(i)
            else:
                keys.append((key, [i]))
                size += len(key)
            rows += 1
    if keys:
        yield (part << 32) + number, keys


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, keys in _blocks(batches):
        held = []
        for row in block_rows(part, keys):
            held.append(row)
            if len(held) == 1 << 14:
                yield _batch(held)
                held = []
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What neighbouring blocks have both counted, for every prefix that they share."""
    for b in batches:
        for last, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            most = shared(last, first) // WIDTH
            ends = -1 if most * WIDTH == len(last) else 0  # the last key is no leaf, or the next block's as well
            names, back, out = prefixes(last[: most * WIDTH]), 0, []
            for d in range(most, -1, -1):
                back += words(last, d)
                out.append((names[d], -1 if d < most else 0, ends, back))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                             ["node", "n_children", "n_leaves", "saved"])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends) from a node's lists in order, one after the other."""
    node, h = None, None
    for b in batches:
        for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if name == node:
                h.update(b",")
            else:
                if node is not None:
                    yield pa.RecordBatch.from_pydict({"node": [node], "ends": [h.hexdigest()]})
                node, h = name, hashlib.sha256()
            h.update(ids.encode())
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends": [h.hexdigest()]})


def trie(seqs: DataFrame) -> DataFrame:
    """The trie's nodes over (id, turns): (id, depth, parent_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).

    ``id`` is the smallest member (members begin with the node's turns), ``parent_id``
    the parent's (the root's is null), ``n_leaves`` counts nodes without children in the
    subtree with its top, ``saved_tokens`` sums (members - 1) x words of the last turn
    over it, ``ends_sha256`` hashes the ids that end in the node, ascending and joined by
    commas. A conversation without turns ends in the root; an empty table has no nodes.
    A repeated id counts as often as it comes.
    """
    spark = seqs.sparkSession
    keyed = seqs.select("id", F.unhex(F.array_join("turns", "")).alias("key"))
    sorted_keys = (keyed.repartitionByRange(parallelism(spark), "key", "id").sortWithinPartitions("key", "id")
                   .select(F.spark_partition_id().alias("part"), "key", "id"))
    found = cut(sorted_keys.mapInArrow(_trees, _ROW), "trie-blocks")
    sums = ["n_convs", "n_children", "n_leaves", "saved"]
    none = F.lit(None)
    nexts = found.where(F.col("kind") == EDGE).select("last", F.lead("first").over(Window.orderBy("part")).alias("next"))  # a row for each block
    twice = nexts.where("next is not null").mapInArrow(_twice, "node string, n_children long, n_leaves long, saved long")
    parts = found.where(F.col("kind") == OPEN).select("node", "depth", "id", "parent", *sums).unionByName(
        twice.select("node", none.cast("long").alias("depth"), none.cast("long").alias("id"), none.cast("string").alias("parent"),
                     none.cast("long").alias("n_convs"), "n_children", "n_leaves", "saved"))
    merged = cut(parts.groupBy("node").agg(F.max("depth").alias("depth"), F.min("id").alias("id"), F.max("parent").alias("parent"),
                                           *[F.sum(c).alias(c) for c in sums]), "trie-shared")
    lists = found.where(F.col("kind") == ENDS).select("node", "part", "ends").repartition(parallelism(spark), "node").sortWithinPartitions("node", "part")
    ends = lists.select("node", "ends").mapInArrow(_hash_ends, "node string, ends string")
    opened = merged.join(ends, "node", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))).drop("node")
    closed = found.where(F.col("kind") == CLOSED)
    # the few shared nodes have most of the children: their rows are spread over salted copies
    salt = F.pmod(F.xxhash64("id", "depth"), F.lit(SALTS)).cast("int")
    names = merged.select(F.col("node").alias("parent"), F.col("id").alias("parent_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    cols = ["id", "depth", *sums, "ends"]
    hanging = opened.select(*cols, "parent").unionByName(closed.where("parent is not null").select(*cols, "parent"))
    hung = hanging.withColumn("_salt", salt).join(names, ["parent", "_salt"], "left").select(*cols, "parent_id")
    every = closed.where("parent is null").select(*cols, "parent_id").unionByName(hung)
    return every.select("id", "depth", "parent_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
