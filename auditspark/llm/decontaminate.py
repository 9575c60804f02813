"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: a shard holds the postings of some MB of
text, as sorted term blocks with delta-coded word positions, and a directory of
its rows. It is written to the shared folder once. Test items are read in blocks
of bounded size; each shard intersects the offset-adjusted position lists of a
test phrase from its rarest term on, for exact phrases (slop 0) or for terms
near their places (slop > 0). Shards never exchange postings.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, deal, ordered_prefix
from .words import ALNUM, LOWER, buffer, hashes, pieces, spans

SHARD_BYTES = 16 << 20       # text of a shard
TERM_BLOCKS = 64             # blocks of terms in a shard
ROW_GAP = 64                 # unused positions between rows, so that no phrase crosses them
QUERY_BLOCK_BYTES = 4 << 20  # test text that is sent to the shards at a time
WINDOW = 10

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER_BYTES = bytes(LOWER.tolist())
_INDEX = "shard long, block int, terms binary, counts binary, positions binary, ids array<long>, n_words array<long>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index: term rows (block >= 0) and directory rows (block -1).

    Words are maximal runs of digits, letters a to z and characters beyond ASCII
    after lower-casing A to Z; null texts have none.
    """
    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId() << 32
        for b in (p for batch in batches for p in pieces(batch, 1, shard_bytes)):
            yield from _shard_rows(shard, b)
            shard += 1

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut(src.mapInArrow(run, _INDEX), "positions")


def _shard_rows(shard: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    term, place, n_words = [], [], []
    at = 0
    for p in pieces(b, 1):
        data, off = buffer(p.column(1))
        low = LOWER[data]
        starts, lens, row = spans(low, off, ALNUM)
        n = np.bincount(row, minlength=p.num_rows)
        term.append(hashes(low, starts, lens))
        base = at + np.concatenate([[0], np.cumsum(n + ROW_GAP)[:-1]])
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        place.append((np.arange(len(row)) - first[row] + base[row]).astype(np.int64))
        n_words.append(n)
        at = int(base[-1] + n[-1] + ROW_GAP)
    term, place, n_words = np.concatenate(term), np.concatenate(place), np.concatenate(n_words)
    order = np.argsort(term, kind="stable")  # positions ascend within a term
    term, place = term[order], place[order]
    new = np.ones(len(term), bool)
    new[1:] = term[1:] != term[:-1]
    heads = np.flatnonzero(new)
    delta = np.diff(place, prepend=0)
    delta[heads] = place[heads]
    counts = np.diff(np.append(heads, len(term)))
    names = ["shard", "block", "terms", "counts", "positions", "ids", "n_words"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    cols = [[shard], [-1], [None], [None], [None], [b.column(0).to_pylist()], [n_words.tolist()]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    ids = term[heads]
    edges = np.searchsorted(ids, np.arange(1, TERM_BLOCKS, dtype=np.uint64) << np.uint64(64 - (TERM_BLOCKS - 1).bit_length()))
    edges = [0, *edges.tolist(), len(ids)]
    ends = np.append(heads, len(term))
    for k, (i, j) in enumerate(zip(edges, edges[1:])):
        if i == j:
            continue
        wide = delta[ends[i]: ends[j]]
        cols = [[shard], [k], [ids[i:j].tobytes()], [counts[i:j].astype("<u4").tobytes()],
                [wide.astype("<u4" if wide.max() < 1 << 32 else "<u8").tobytes()], [None], [None]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


class Queries:
    """A block of test items: their distinct terms and windows of terms."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        texts = [_WORD.findall((t or "").encode().translate(_LOWER_BYTES)) for _, t in items]
        flat = [w for t in texts for w in t]
        lens = np.array([len(w) for w in flat], np.int64)
        h = hashes(np.frombuffer(b"".join(flat), np.uint8), np.cumsum(lens) - lens, lens)
        self.terms, place = np.unique(h, return_inverse=True)
        self.items = [i for i, _ in items]
        self.windows: list[tuple[int, list[int]]] = []  # (item, term numbers)
        at = 0
        for k, t in enumerate(texts):
            n = len(t)
            seq = place[at: at + n].tolist()
            at += n
            size = min(window, n)
            self.windows += [(k, seq[i: i + size]) for i in range(n - size + 1)] if n else []


def _intersect(post: list[np.ndarray], seq: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts s such that every term i has a posting within ``slop`` of s + i, and
    for each the position of a posting."""
    order = sorted(range(len(seq)), key=lambda i: len(post[seq[i]]))
    first = order[0]
    starts = post[seq[first]] - first
    if slop:
        starts = np.unique((starts[:, None] + np.arange(-slop, slop + 1)).ravel())
    for i in order[1:]:
        if not len(starts):
            break
        p = post[seq[i]]
        at = np.searchsorted(p, starts + (i - slop))
        near = np.full(len(starts), np.iinfo(np.int64).max)
        inside = at < len(p)
        near[inside] = p[at[inside]]
        starts = starts[near <= starts + (i + slop)]
    p = post[seq[first]]
    return starts, p[np.searchsorted(p, starts + (first - slop))]


def _shard_hits(shard: int, n_words: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, q: Queries,
                slop: int):
    post: list[np.ndarray] = [positions[:0]] * len(q.terms)
    ends = np.cumsum(counts)
    for k, i, j in zip(np.searchsorted(q.terms, terms).tolist(), (ends - counts).tolist(), ends.tolist()):
        post[k] = np.cumsum(positions[i:j])
    base = np.concatenate([[0], np.cumsum(n_words + ROW_GAP)])
    mark = np.zeros(int(base[-1]) + 1, np.int32)
    found: dict[int, set[int]] = {}
    for item, seq in q.windows:
        if any(not len(post[t]) for t in seq):
            continue
        starts, at = _intersect(post, seq, slop)
        if not len(starts):
            continue
        inside = np.searchsorted(base, at, "right") - 1
        lo, hi = np.maximum(starts - slop, base[inside]), np.minimum(starts + len(seq) + slop, base[inside] + n_words[inside])
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi, -1)
        for r in set(inside.tolist()):
            found.setdefault(r, set()).add(item)
    if not found:
        return None
    on = np.cumsum(mark) > 0
    rows = sorted(found)
    runs, names = [], []
    for r in rows:
        edge = np.diff(on[base[r]: base[r] + n_words[r]].astype(np.int8), prepend=0, append=0)
        runs.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).astype("<i8").tobytes())
        names.append([q.items[i] for i in sorted(found[r]) if q.items[i] is not None])
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.array(runs, pa.binary()),
         pa.array(names, pa.list_(pa.string()))], names=["shard", "row", "runs", "items"])


def _matches(index: DataFrame, q: Queries, slop: int) -> DataFrame:
    """(shard, row, runs, items) of the rows that hold a window of the block."""
    def select(batches):  # postings of the block's terms only
        for b in batches:
            out = []
            for shard, n_words, terms, counts, pos in zip(*(b.column(c).to_pylist() for c in
                                                            ("shard", "n_words", "terms", "counts", "positions"))):
                if terms is None:
                    out.append((shard, n_words, b"", b"", b""))
                    continue
                t, c = np.frombuffer(terms, np.uint64), np.frombuffer(counts, "<u4").astype(np.int64)
                on = np.isin(t, q.terms, assume_unique=True)
                if not on.any():
                    continue
                p = np.frombuffer(pos, "<u4" if len(pos) == 4 * c.sum() else "<u8")[np.repeat(on, c)]
                out.append((shard, None, t[on].tobytes(), c[on].astype("<u4").tobytes(), p.astype("<u4" if p.max() < 1 << 32 else "<u8").tobytes()))
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["shard", "n_words", "terms", "counts", "positions"])

    def match(batches):
        def done(shard, held):
            n_words = next(np.array(h[0], np.int64) for h in held if h[0] is not None)
            rows = [h for h in held if h[0] is None]
            if not rows:
                return None
            counts = [np.frombuffer(h[2], "<u4").astype(np.int64) for h in rows]
            pos = [np.frombuffer(h[3], "<u4" if len(h[3]) == 4 * c.sum() else "<u8").astype(np.int64) for h, c in zip(rows, counts)]
            return _shard_hits(shard, n_words, np.concatenate([np.frombuffer(h[1], np.uint64) for h in rows]),
                               np.concatenate(counts), np.concatenate(pos), q, slop)

        shard, held = None, []
        for b in batches:
            for s, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and s != shard:
                    out = done(shard, held)
                    held = []
                    if out is not None:
                        yield out
                shard = s
                held.append(row)
        if held:
            out = done(shard, held)
            if out is not None:
                yield out

    picked = index.mapInArrow(select, "shard long, n_words array<long>, terms binary, counts binary, positions binary")
    return deal(picked, ["shard"]).mapInArrow(match, "shard long, row long, runs binary, items array<string>")


def _query_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Queries]:
    """The test items, collected block by block: about QUERY_BLOCK_BYTES of text
    at a time, whatever the size of the benchmark."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where("text is not null").distinct().withColumn("_len", F.octet_length("text").cast("long"))
    sized = ordered_prefix(items, ["text", "item"], {"_at": "_len"}, "test-items")
    blocks = cut(sized.withColumn("_block", F.floor(F.col("_at") / QUERY_BLOCK_BYTES)), "test-blocks")
    for k in [r[0] for r in blocks.select("_block").distinct().orderBy("_block").collect()]:
        yield Queries([(r.item, r.text) for r in blocks.where(F.col("_block") == k).collect()], window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(id, n_words, runs, n_hit, items): one row per row of ``docs``.

    ``runs`` holds the word ranges [from, to) that some window of a test item
    covers; ``n_hit`` counts their words; ``items`` are the test items found, as
    sorted strings. An item of fewer words than ``window`` is one window; an item
    without words, or null, matches nothing. Rows of an item id count once; an
    item with a null id marks words but is not listed. Rows with the same or a
    null document id keep rows of their own. With ``slop`` every word of a window
    may lie up to that many words off its place (2 * slop + 1 < ROW_GAP).
    """
    if 2 * slop + 1 >= ROW_GAP or slop < 0 or window < 1:
        raise ValueError(f"need 0 <= slop < {(ROW_GAP - 1) // 2} and window >= 1")
    index = build_index(docs, id_col, text_col)
    found = None
    for q in _query_blocks(benchmark, item_col, item_text_col, window):
        if not len(q.terms):
            continue
        part = _matches(index, q, slop)
        found = part if found is None else found.union(part)
    rows = index.where("block = -1").select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("row", "r"))
    rows = rows.select("shard", F.col("row").cast("long").alias("row"), F.col("r.ids").alias("id"), F.col("r.n_words").alias("n_words"))
    none = F.array().cast("array<array<long>>"), F.array().cast("array<string>")
    if found is None:
        return rows.select("id", "n_words", none[0].alias("runs"), F.lit(0).cast("long").alias("n_hit"), none[1].alias("items"))
    merged = found.groupBy("shard", "row").agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))
    merged = merged.withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))

    def join_runs(batches):
        for b in batches:
            out = []
            for parts in b.column("runs").to_pylist():
                iv = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts])
                iv = iv[np.argsort(iv[:, 0], kind="stable")]
                top = np.maximum.accumulate(iv[:, 1])
                new = np.ones(len(iv), bool)
                new[1:] = iv[1:, 0] > top[:-1]
                last = np.append(np.flatnonzero(new)[1:] - 1, len(iv) - 1)
                out.append(np.stack([iv[new, 0], top[last]], axis=1).tolist())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("row"), pa.array(out, pa.list_(pa.list_(pa.int64()))),
                                              b.column("items")], names=["shard", "row", "runs", "items"])

    hits = merged.mapInArrow(join_runs, "shard long, row long, runs array<array<long>>, items array<string>")
    out = rows.join(hits, ["shard", "row"], "left")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return out.select("id", "n_words", F.coalesce("runs", none[0]).alias("runs"),
                      F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none[1]).alias("items"))
