"""Suffix-array dedup: bytes covered by a string of 100 bytes that occurs earlier.

A sparse suffix array over content-defined anchors. In every string of ``length``
bytes the smallest hash of its byte grams is its anchor, so equal strings hold
equal anchors at equal places, and strings meet where their anchors meet. Only
anchors that occur twice go on, each with the bytes of its strings around it.
Texts lie in shards of some MB, anchors in buckets by hash:

1. documents -> shards (compressed text) and their anchors' hashes by bucket;
2. buckets: which hashes occur again, and which so often that they must be split;
3. shards: the places of those anchors with digests of their contexts, by bucket;
4. buckets: all but the first of equal contexts are covered as a whole; anchors
   with different contexts are in doubt, and one context of each kind is called for;
5. shards: the bytes of those contexts, by bucket;
6. buckets: the suffixes from the anchors on, and the reversed prefixes before
   them, are put in order by deep-shallow sorting; strings are equal where both
   parts fall in one class of the order, and all but the first are covered;
7. shards: covered bytes are cut out.

Deep-shallow sorting: multikey quicksort to a shallow depth, eight bytes a step
and all groups at once, then blind tries order what still agrees.
"""
from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_by, deal, parallelism
from .words import buffer, mix, pieces

LENGTH = 100           # bytes of a string that must not repeat
GRAM = 24              # bytes of an anchor
SHALLOW = 48           # depth at which blind tries take over
SHARD_BYTES = 2 << 20  # text of a shard
CHUNK = 1 << 20        # string starts whose anchors are found at a time
BUCKETS = 4            # buckets of anchors for each shuffle partition
HOT = 1024             # occurrences beyond which an anchor's strings are dealt by their digests
_LAST = np.int64((1 << 63) - 1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


# --- anchors -----------------------------------------------------------------

def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes of all byte grams, put together from halves."""
    out, done = None, 0
    h, size, power = x.astype(np.uint64) + np.uint64(1), 1, _BASE
    n = len(x) - gram + 1
    while True:
        if gram & size:  # this part of the gram lies `done` bytes into it
            part = h[done: done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += size
        if size * 2 > gram:
            return mix(out)
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, v
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(v) - width + 1
    return np.minimum(m[:n], m[width - size: width - size + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Runs of string starts that share an anchor, within rows: arrays of the
    anchor's hash, the row, the first start, the number of starts, and the
    anchor's place in the first string."""
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    total = len(data) - length + 1
    for c in range(0, total, CHUNK):
        n = min(CHUNK, total - c)
        h = _gram_hashes(data[c: c + n + length - 1], gram)
        v = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(v, length - gram + 1) & _PLACE).astype(np.int64)
        lo, hi = np.clip(off[:-1] - c, 0, n), np.clip(off[1:] - length + 1 - c, 0, n)
        on = hi > lo
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, lo[on], 1)
        np.add.at(mark, hi[on], -1)
        valid = np.cumsum(mark[:-1]) > 0
        head = valid.copy()
        head[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        first = np.flatnonzero(head)
        number = np.add.reduceat(valid, first, dtype=np.int64) if len(first) else first
        chosen = mix(h[at[first]] ^ np.uint64(_BASE))  # the smallest hashes of many are all small: spread them again
        for col, x in zip(cols, (chosen, np.searchsorted(off, first + c, "right") - 1, first + c, number, at[first] - first)):
            col.append(x)
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(col) if col else (empty.view(np.uint64) if k == 0 else empty) for k, col in enumerate(cols))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of an ascending array."""
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), a, b


# --- deep-shallow sorting ----------------------------------------------------

def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """``members`` in the order of their strings, and the common prefixes of
    neighbours. The trie keeps branching places and bytes only; each insertion
    compares one string."""
    root: list = [None, [members[0]]]  # leaf: [None, members]; branch: [place, {byte: child}]
    for m in members[1:]:
        s = strings[m]
        x = root
        while x[0] is not None:
            x = x[1].get(s[x[0]] if x[0] < len(s) else -1) or next(iter(x[1].values()))
        t = strings[x[1][0]]
        n = _common(s, t)
        if n == len(s) == len(t):
            x[1].append(m)
            continue
        above, x = None, root
        while x[0] is not None and x[0] < n:
            above, x = x, x[1][s[x[0]]]
        end = s[n] if n < len(s) else -1
        if x[0] == n:
            x[1][end] = [None, [m]]
            continue
        branch = [n, {t[n] if n < len(t) else -1: x, end: [None, [m]]}]
        if above is None:
            root = branch
        else:
            above[1][s[above[0]]] = branch
    order: list[int] = []
    lcp: list[int] = []
    stack = [(root, -1)]
    while stack:
        x, before = stack.pop()
        if x[0] is None:
            order += x[1]
            lcp += [before] + [len(strings[x[1][0]])] * (len(x[1]) - 1)
        else:
            kids = sorted(x[1].items())
            stack += [(k, x[0]) for _, k in reversed(kids[1:])]
            stack.append((kids[0][1], before))
    return order, lcp


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the strings in order within ascending groups; ``lcp`` is the
    common prefix with the string before, -1 where a group begins."""
    n = len(strings)
    width = max(8, -(-max(map(len, strings), default=0) // 8) * 8)
    words = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), ">u8").astype(np.uint64).reshape(n, width // 8)
    lens = np.array([len(s) for s in strings], np.int64)
    order = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = group[1:] != group[:-1]
    lcp = np.where(head, -1, 0)
    for level in range(min(shallow, width) // 8):  # multikey quicksort, a word a step, all open groups at once
        run = np.cumsum(head) - 1
        at = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(at):
            break
        key, r = words[order[at], level], run[at]
        by = np.lexsort((key, r))
        order[at] = order[at][by]
        key = key[by]
        new = np.flatnonzero((r[1:] == r[:-1]) & (key[1:] != key[:-1])) + 1
        x = key[new] ^ key[new - 1]
        same = 8 * level + sum((x < np.uint64(1 << 8 * b)).astype(np.int64) for b in range(1, 8))
        p = at[new]
        head[p] = True
        lcp[p] = same
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], n)
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        o, common = blind_trie(strings, order[a:b].tolist())
        order[a:b] = o
        lcp[a + 1: b] = common[1:]
    sorted_lens = lens[order]  # a short string's padding agrees with zero bytes
    lcp[1:] = np.minimum(lcp[1:], np.minimum(sorted_lens[1:], sorted_lens[:-1]))
    return order, lcp


# --- covered strings ---------------------------------------------------------

def _merge(row: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Maximal runs of the ranges [lo, hi) of each row."""
    o = np.lexsort((lo, row))
    row, lo, hi = row[o], lo[o], hi[o]
    if not len(row):
        return row, lo, hi
    span = int(hi.max()) + 1
    top = np.maximum.accumulate(hi + row * span)  # rows don't reach into each other
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] + row[1:] * span > top[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], lo[new], top[last] - row[new] * span


def covered(hashes, place, number, context: list[bytes], rank, length: int, shallow: int):
    """(row, window) of the strings that a row of lower rank holds too. Rows are
    contexts of one bucket's anchors, no two equal."""
    o = np.argsort(hashes, kind="stable")
    new = np.diff(hashes[o], prepend=hashes[o][:1] ^ np.uint64(1)) != 0
    size = np.bincount(np.cumsum(new) - 1)
    rows = o[(size > 1)[np.cumsum(new) - 1]]
    if not len(rows):
        return rows, rows
    group = np.cumsum(np.diff(hashes[rows], prepend=hashes[rows][:1] ^ np.uint64(1)) != 0)
    part = list(zip(rows.tolist(), place[rows].tolist()))
    right, r_lcp = deep_shallow([context[r][p:] for r, p in part], group, shallow)
    left, l_lcp = deep_shallow([context[r][:p][::-1] for r, p in part], group, shallow)
    p, n, k = place[rows], number[rows], rank[rows]
    r_class, l_class = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    out_row, out_window = [], []
    for i in range(int(p.max()) + 1):  # strings that begin i bytes before their anchor
        live = np.flatnonzero((p >= i) & (p - n < i))
        if len(live) < 2:
            continue
        r_class[right] = np.cumsum(r_lcp < length - i)
        l_class[left] = np.cumsum(l_lcp < i)
        key = r_class[live] << 32 | l_class[live]
        by = np.lexsort((k[live], key))
        again = np.flatnonzero(key[by][1:] == key[by][:-1]) + 1
        hit = live[by[again]]
        out_row.append(rows[hit])
        out_window.append(p[hit] - i)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_row]), np.concatenate([none, *out_window])


def _first_of(keys: list) -> np.ndarray:
    """For each key the position of the first equal one."""
    seen: dict = {}
    return np.array([seen.setdefault(k, i) for i, k in enumerate(keys)], np.int64)


def _ranges(bucket: int, shard: int, row, lo, hi) -> list[tuple]:
    row, lo, hi = _merge(row, lo, hi)
    return [(bucket, shard, _pack("ranges", row, lo, hi))] if len(row) else []


def _small(a: np.ndarray) -> tuple[int, np.ndarray]:
    """An array of integers as its least value and the rest in as few bytes as hold it."""
    base = int(a.min()) if len(a) else 0
    rest = (a - base).astype(np.uint64)
    most = int(rest.max()) if len(a) else 0
    return base, rest.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def _large(packed: tuple[int, np.ndarray]) -> np.ndarray:
    return packed[1].astype(np.int64) + packed[0]


_MESSAGE = "bucket int, shard long, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    types = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["bucket", "shard", "payload"])


def _by_bucket(batches) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(bucket, shards, payloads) of rows that arrive sorted by bucket."""
    held, shards, data = None, [], []
    for b in batches:
        for k, s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if k != held and shards:
                yield held, shards, data
                shards, data = [], []
            held = k
            shards.append(s)
            data.append(p.as_py())
    if shards:
        yield held, shards, data


# --- the steps ---------------------------------------------------------------

_SHARD = "shard long, bucket int, payload binary, text binary, offsets binary, ids array<long>"


def _to_shards(docs: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId() << 32
        names = ["shard", "bucket", "payload", "text", "offsets", "ids"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for b in (p for batch in batches for p in pieces(batch, 1, SHARD_BYTES)):
            data, off = buffer(b.column(1))
            packed = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
            cols = [[shard], [-1], [None], [packed], [off.astype("<i8").tobytes()], [b.column(0).to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            u, n = np.unique(anchors(data, off, length, gram)[0], return_counts=True)
            # the lower half of a hash tells the hashes of a bucket apart, but for a few that go on for nothing
            low, n = _low(u), np.minimum(n, 0xFFFF).astype(np.uint16)
            out = [(shard, k, _pack(low[i:j], n[i:j])) for k, i, j in _parts(_bucket(u, n_buckets))]
            if out:
                s, k, p = zip(*out)
                none = [None] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((s, k, p, none, none, none), types)], names=names)
            shard += 1

    return docs.mapInArrow(run, _SHARD)


def _repeated(batches):
    """Buckets of hashes and counts -> for each shard, whether a hash is unique (0),
    repeated (1) or hot (2)."""
    for k, shards, data in _by_bucket(batches):
        parts = [_unpack(d) for d in data]
        h = np.concatenate([p[0] for p in parts])
        _, inv = np.unique(h, return_inverse=True)
        n = np.bincount(inv, np.concatenate([p[1] for p in parts]))[inv]
        code = (n > 1).astype(np.uint8) + (n > HOT)
        ends = np.cumsum([len(p[0]) for p in parts])
        yield _batch([(k, s, _pack(code[e - len(p[0]): e])) for s, p, e in zip(shards, parts, ends)])


def _text(row: dict) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(row["offsets"], "<i8")
    data = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, int(off[-1])))
    return np.frombuffer(data, np.uint8), off


def _claims(n_buckets: int, length: int, gram: int):
    """Shards with their codes -> places of repeated anchors, with digests of their contexts."""
    def one(row: dict) -> list[tuple]:
        data, off = _text(row)
        h, doc, start, number, place = anchors(data, off, length, gram)
        u, inv = np.unique(h, return_inverse=True)
        code = np.concatenate([_unpack(c["payload"])[0] for c in sorted(row["codes"], key=lambda c: c["bucket"])])[inv]
        ids = np.array([_LAST if i is None else i for i in row["ids"]], np.int64)
        on = np.flatnonzero(code)
        on = on[np.lexsort((start[on], doc[on], ids[doc[on]]))]  # earlier documents first
        raw = data.tobytes()
        spans = zip(start[on].tolist(), (start[on] + number[on] + length - 1).tolist(), place[on].tolist())
        keys = [(raw[i:j], p) for i, j, p in spans]
        lead = _first_of(keys) == np.arange(len(keys))
        gone = on[~lead]  # equal contexts of this shard: covered as a whole
        row_, lo, hi = doc[gone], start[gone], start[gone] + number[gone] + length - 1
        kept, texts = on[lead], [keys[i] for i in np.flatnonzero(lead)]
        out = []
        plain = np.flatnonzero(code[kept] == 1)
        plain = plain[np.argsort(h[kept[plain]], kind="stable")]
        # 64 bits beside the lower half of the anchor's hash and its bucket
        digest = np.frombuffer(b"".join([hashlib.blake2b(texts[x][0] + bytes([texts[x][1]]), digest_size=8).digest() for x in plain.tolist()]), "<u8")
        for k, i, j in _parts(_bucket(h[kept[plain]], n_buckets)):
            part = kept[plain[i:j]]
            out.append((k, row["shard"], _pack("claim", _low(h[part]), digest[i:j], place[part].astype(np.uint8), number[part].astype(np.uint8),
                                               _small(ids[doc[part]]), _small(doc[part]), _small(start[part] - off[doc[part]]))))
        hot = np.flatnonzero(code[kept] == 2)
        if len(hot):  # a hot anchor's strings, by their own digests
            each = number[kept[hot]]
            which = np.repeat(hot, each)
            shift = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            digest = [hashlib.blake2b(texts[x][0][s: s + length], digest_size=16).digest() for x, s in zip(which.tolist(), shift.tolist())]
            first = _first_of(digest) == np.arange(len(digest))
            d, at = doc[kept[which]], start[kept[which]] + shift
            row_, lo, hi = (np.concatenate(x) for x in ((row_, d[~first]), (lo, at[~first]), (hi, at[~first] + length)))
            pairs = np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2)[first]
            d, at = d[first], at[first]
            bucket = _bucket(pairs[:, 0], n_buckets)
            o = np.argsort(bucket, kind="stable")
            for k, i, j in _parts(bucket[o]):
                x = o[i:j]
                out.append((k, row["shard"], _pack("string", pairs[x], _small(ids[d[x]]), _small(d[x]), _small(at[x] - off[d[x]]))))
        # ranges covered within the shard pass through one of the buckets
        return out + _ranges(row["shard"] % n_buckets, row["shard"], row_, lo - off[row_], hi - off[row_])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                if row["codes"]:
                    yield _batch(one(row))

    return run


def _together(parts: list[tuple[int, tuple]], plain: int) -> tuple[np.ndarray, ...]:
    """(shard, columns) of messages whose first ``plain`` columns are arrays and whose others are ``_small``."""
    shard = np.repeat([s for s, _ in parts], [len(p[0]) for _, p in parts]).astype(np.int64)
    cols = range(len(parts[0][1]))
    return shard, *(np.concatenate([p[k] if k < plain else _large(p[k]) for _, p in parts]) for k in cols)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    o = np.argsort(shard, kind="stable")
    u, first = np.unique(shard[o], return_index=True)
    yield from zip(u.tolist(), np.split(o, first[1:])) if len(u) else ()


def _doubts(length: int):
    """Buckets of claims -> ranges that equal contexts cover, and calls for the contexts in doubt."""
    def one(bucket: int, shards: list[int], data: list[bytes]) -> list[tuple]:
        parts = [(s, _unpack(d)) for s, d in zip(shards, data)]
        # shard, row, from, to
        res = [(np.full(len(p[1]), s), *p[1:]) for s, p in parts if p[0] == "ranges"]
        out = []
        claims = [(s, p[1:]) for s, p in parts if p[0] == "claim"]
        if claims:
            shard, h, digest, place, number, ids, doc, start = _together(claims, 4)
            by = np.lexsort((start, doc, shard, ids, digest, h))
            new = np.ones(len(by), bool)
            new[1:] = (h[by][1:] != h[by][:-1]) | (digest[by][1:] != digest[by][:-1])
            gone, lead = by[~new], by[new]
            end = start + number.astype(np.int64) + length - 1
            res.append((shard[gone], doc[gone], start[gone], end[gone]))
            same = h[lead][1:] == h[lead][:-1]
            ask = lead[np.append(same, False) | np.insert(same, 0, False)]
            for s, x in _by_shard(shard[ask]):
                x = ask[x]
                out.append((bucket, s, 1, _pack(h[x], place[x], number[x], _small(ids[x]), _small(doc[x]), _small(start[x]))))
        strings = [(s, p[1:]) for s, p in parts if p[0] == "string"]
        if strings:
            shard, pairs, ids, doc, at = _together(strings, 1)
            o = np.lexsort((at, doc, shard, ids, pairs[:, 1], pairs[:, 0]))
            again = o[1:][(pairs[o][1:] == pairs[o][:-1]).all(axis=1)]
            res.append((shard[again], doc[again], at[again], at[again] + length))
        return out + [(k, s, 0, p) for k, s, p in _for_shards(bucket, res)]

    def run(batches):
        for bucket, shards, data in _by_bucket(batches):
            rows = one(bucket, shards, data)
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                                             names=["bucket", "shard", "called", "payload"])

    return run


def _for_shards(bucket: int, res: list[tuple]) -> list[tuple]:
    """Ranges (shard, row, from, to) as a message for each shard."""
    if not res:
        return []
    shard, doc, lo, hi = (np.concatenate([r[k] for r in res]).astype(np.int64) for k in range(4))
    return [m for s, x in _by_shard(shard) for m in _ranges(bucket, s, doc[x], lo[x], hi[x])]


def _contexts(length: int):
    """Shards with calls -> the bytes called for."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                if not row["calls"]:
                    continue
                data, off = _text(row)
                raw, out = data.tobytes(), []
                for call in row["calls"]:
                    h, place, number, ids, doc, start = _unpack(call["payload"])
                    at = off[_large(doc)] + _large(start)
                    text = b"".join([raw[i:j] for i, j in zip(at.tolist(), (at + number + length - 1).tolist())])
                    out.append((call["bucket"], row["shard"], _pack(h, place, number, ids, doc, start, text)))
                yield _batch(out)

    return run


def _sorted_out(length: int, shallow: int):
    """Buckets of contexts -> covered ranges for the shards."""
    def one(bucket: int, shards: list[int], data: list[bytes]) -> list[tuple]:
        parts = [(s, _unpack(d)) for s, d in zip(shards, data)]
        shard, h, place, number, ids, doc, start = _together([(s, p[:6]) for s, p in parts], 3)
        place, number = place.astype(np.int64), number.astype(np.int64)
        texts = []
        for _, p in parts:
            ends = np.cumsum(p[2].astype(np.int64) + length - 1)
            texts += [p[6][i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
        by = np.lexsort((start, doc, shard, ids))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        r, w = covered(h.astype(np.uint64), place, number, texts, rank, length, shallow)
        return _for_shards(bucket, [(shard[r], doc[r], start[r] + w, start[r] + w + length)])

    def run(batches):
        for bucket, shards, data in _by_bucket(batches):
            yield _batch(one(bucket, shards, data))

    return run


def _cut_out(batches):
    """Shards with their covered ranges -> a row for each document."""
    for b in batches:
        for row in b.to_pylist():
            data, off = _text(row)
            parts = [_unpack(p)[1:] for p in row["ranges"] or []]
            n = len(off) - 1
            none = np.zeros(0, np.int64)
            doc, lo, hi = _merge(*(np.concatenate([none, *[p[k] for p in parts]]) for k in range(3)))
            gone = np.bincount(doc, hi - lo, minlength=n).astype(np.int64)
            spans = np.bincount(doc, minlength=n)
            at = np.searchsorted(doc, np.arange(n + 1))
            kept = []
            for d in range(n):
                t = data[off[d]: off[d + 1]]
                if spans[d]:
                    mask = np.ones(len(t), bool)
                    for i, j in zip(lo[at[d]: at[d + 1]].tolist(), hi[at[d]: at[d + 1]].tolist()):
                        mask[i:j] = False
                    t = t[mask]
                kept.append(t.tobytes())
            for a in range(0, n, 512):  # some documents at a time
                z = min(n, a + 512)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"][a:z], pa.int64()), pa.array(np.diff(off[a: z + 1])), pa.array(gone[a:z]),
                     pa.array(spans[a:z].astype(np.int64)), pa.array(kept[a:z], pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   shallow: int = SHALLOW) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): one row per row of ``docs``.

    Every byte that lies in a string of ``length`` bytes of its document which
    also starts earlier (in a document of smaller id, or before in the same one)
    is removed; ``kept`` holds the bytes that are left, which may cut characters.
    Strings are judged on the input, may overlap, and never cross documents. A
    null text is an empty one. Null ids come last; rows of equal or null ids come
    in the order in which the table holds them. Texts shorter than ``length``
    stay whole. An empty table gives an empty one.
    """
    if not 1 <= gram <= length <= 255:
        raise ValueError("need 1 <= gram <= length <= 255")
    n = BUCKETS * parallelism(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # by shard, so that the texts are joined twice without being shuffled
    shards = cut_by(_to_shards(src, n, length, gram), "shard", "suffix-shards")
    texts = shards.where("bucket = -1").select("shard", "text", "offsets", "ids")
    hashed = shards.where("bucket >= 0").select("bucket", "shard", "payload")

    def to_shards(messages, name, *cols):
        got = messages.groupBy("shard").agg(F.collect_list(cols[0] if len(cols) == 1 else F.struct(*cols)).alias(name))
        return texts.join(got, "shard", "left")  # what belongs to one shard

    codes = deal(hashed, ["bucket"]).mapInArrow(_repeated, _MESSAGE)
    claims = to_shards(codes, "codes", "bucket", "payload").mapInArrow(_claims(n, length, gram), _MESSAGE)
    judged = cut(deal(claims, ["bucket"]).mapInArrow(_doubts(length), "bucket int, shard long, called int, payload binary"), "suffix-doubts")
    called = to_shards(judged.where("called = 1"), "calls", "bucket", "payload").mapInArrow(_contexts(length), _MESSAGE)
    ranges = deal(called, ["bucket"]).mapInArrow(_sorted_out(length, shallow), _MESSAGE)
    every = judged.where("called = 0").select("shard", "payload").unionByName(ranges.select("shard", "payload"))
    return to_shards(every, "ranges", "payload").mapInArrow(_cut_out, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
