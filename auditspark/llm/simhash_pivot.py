"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to many reference
fingerprints, kept apart for each of ``max_bits + 2`` blocks of bits. Two
fingerprints within ``max_bits`` bits differ in at most ``max_bits`` blocks, so
in at least two blocks all their distances are equal: rows meet in a bucket for
each pair of blocks, keyed by the blocks' distances. Within a bucket, pairs
whose distances to any reference differ by more than ``max_bits`` are discarded
(triangle inequality), and the rest are verified bit by bit. No link is lost.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, deal, tiles, whole_groups
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
REFERENCES = 16        # whole-fingerprint coordinates of the table
BLOCK_REFERENCES = 12  # references whose block distances make a bucket key
TILE = 4096            # distinct fingerprints of a bucket that one tile takes
_CHUNK = 1 << 18       # shingles hashed at a time


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """64-bit fingerprint of a UTF-8 text: ASCII lower case, words between ASCII
    white space, ``shingle``-word shingles with repeats, XXH64 with seed 42, a bit
    set when over half the hashes have it. No words (or null): 0."""
    words = (text or b"").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    buf = b" ".join(words)
    k = min(shingle, n)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - k + 1]
    ends = ends[k - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at: at + _CHUNK].tolist(), ends[at: at + _CHUNK].tolist())
        h = np.array([digest(buf[i:j], SEED) for i, j in spans], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp as a signed long."""
    def run(batches):
        for b in batches:
            text = b.column(1).cast(pa.binary())
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def _references(n: int, salt: int) -> list[int]:
    """``n`` fixed pseudo-random reference fingerprints (signed longs)."""
    return [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), salt) - (1 << 63) for i in range(n)]


def _blocks(n: int) -> list[int]:
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def pivot_table(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, t0, t1, key): the packed distances to the references, and a row for
    each bucket of a distinct fingerprint."""
    def dist(ref, mask=-1):
        return F.bit_count(F.col("fp").bitwiseXOR(F.lit(ref).cast("long")).bitwiseAND(F.lit(mask).cast("long")))

    def packed(refs):
        word = F.lit(0).cast("long")
        for i, r in enumerate(refs):
            word = word.bitwiseOR(F.shiftleft(dist(r).cast("long"), 8 * i))
        return word

    refs, near = _references(REFERENCES, 1), _references(BLOCK_REFERENCES, 2)
    masks = _blocks(max_bits + 2)
    coords = fps.select("fp", packed(refs[:8]).alias("t0"), packed(refs[8:]).alias("t1"),
                        *[F.xxhash64(*[dist(r, m) for r in near]).alias(f"k{i}") for i, m in enumerate(masks)])
    keys = [F.xxhash64(F.lit(i), F.lit(j), f"k{i}", f"k{j}") for i, j in combinations(range(len(masks)), 2)]
    return coords.select("fp", "t0", "t1", F.explode(F.array(*keys)).alias("key"))


def _spanning(fp: np.ndarray, coord: np.ndarray, group: np.ndarray, max_bits: int):
    """Edges that span each group's linked fingerprints, as positions (i, j)."""
    n = len(fp)
    lab = np.arange(n)
    out_i, out_j = [], []

    def root(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for k in range(1, n):
        i = np.flatnonzero(group[:-k] == group[k:])
        if not len(i):
            break
        for c in range(coord.shape[1]):  # the pivot filter: maximum coordinate difference
            i = i[np.abs(coord[i, c] - coord[i + k, c]) <= max_bits]
            if not len(i):
                break
        if not len(i):
            continue
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= max_bits]  # verification
        i = i[lab[i] != lab[i + k]]
        for x in i.tolist():
            p, q = root(x), root(x + k)
            if p != q:
                lab[max(p, q)] = min(p, q)
                out_i.append(x)
                out_j.append(x + k)
        if len(i):
            while True:
                nxt = lab[lab]
                if (nxt == lab).all():
                    break
                lab = nxt
    return out_i, out_j


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``max_bits`` bits: enough
    of them that whatever a chain of links joins stays joined."""
    rows = tiles(pivot_table(fps.select("fp").distinct(), max_bits), ["key"], "fp", TILE).drop("_block")

    def run(batches):
        for t in whole_groups(batches, ["key", "_tile"]):
            get = lambda c: t.column(c).to_numpy()
            key, tile, fp = get("key"), get("_tile"), get("fp").view(np.uint64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
            coord = np.stack([get("t0"), get("t1")], axis=1).astype("<i8").view(np.uint8).astype(np.int16)
            i, j = _spanning(fp, coord, np.cumsum(new), max_bits)
            f = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f[i]), pa.array(f[j])], names=["a", "b"])

    return deal(rows, ["key", "_tile"]).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(id, fp, component): one row per row of ``docs``; ``component`` is the
    smallest id reachable over fingerprints that differ in at most ``max_bits`` bits.

    Null and empty texts have fingerprint 0 and link like any other. A null id
    stays null and never names a component unless all ids of it are null.
    Repeated rows are rows of their own with the same result. Other columns of
    ``docs`` are not read. An empty table gives an empty table.
    """
    fp = cut(fingerprints(docs, id_col, text_col, shingle), "simhash")
    first = cut(fp.groupBy("fp").agg(F.min("id").alias("lo")), "simhash-classes")
    roots = components(links(first, max_bits))
    named = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    least = named.groupBy("root").agg(F.min("lo").alias("component"))
    moved = named.select("fp", "root").join(least, "root").select("fp", "component")
    classes = first.join(moved, "fp", "left").select("fp", F.coalesce("component", "lo").alias("component"))
    return fp.join(classes, "fp").select("id", "fp", "component")
