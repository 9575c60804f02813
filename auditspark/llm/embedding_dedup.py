"""Embedding near-duplicates: random-hyperplane sign hashing in several tables,
exact cosine verification and distributed connected components.

Equal vectors of a label are one class. Each class gets a sign signature in every
table; classes that share a signature meet in a bucket, where the cosine of every
pair is computed in double precision. A pair that meets in several tables counts
in the first of them only. Buckets of one class are dropped before the vectors are
joined; a vector travels once for each bucket that it shares.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, deal, tiles, whole_groups
from .components import components

THRESHOLD = 0.98
MISS = 5e-5       # chance, at most, that a pair at the threshold shares no table's signature
BITS = 14         # hyperplanes of a table at least
BUCKET = 512      # vectors of the largest label for a signature on average; more hyperplanes beyond
TILE = 1024       # classes of a bucket that one tile takes
_ROWS = 256       # rows of a tile whose pairs are looked at together


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a non-null list column of equal lengths as float64."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _signatures(vec: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng(seed).standard_normal((vec.shape[1], tables * bits))
    on = (vec @ planes > 0).reshape(len(vec), tables, bits)
    return (on * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def tables_for(threshold: float, bits: int) -> int:
    """Tables so that a pair at the threshold is missed with probability MISS at most."""
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISS) / math.log1p(-p))) if p < 1 else 1


def _usable() -> Column:
    """Whether a row can link: a label, and a non-zero vector of finite components."""
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    some = F.exists("vec", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))


def _scaled(rows: DataFrame) -> DataFrame:
    """Vectors by a power of two that brings the largest component near 1: cosines stay the
    same to the last bit, and squares neither overflow nor vanish."""
    exponent = F.floor(F.log2(F.array_max(F.transform("vec", lambda x: F.abs(x)))))
    half = F.floor(exponent / 2)
    two = F.lit(2.0)  # 2 ** exponent itself may have no double
    out = rows.withColumn("_a", F.pow(two, half)).withColumn("_b", F.pow(two, exponent - half))
    return out.withColumn("vec", F.transform("vec", lambda x: x / F.col("_a") / F.col("_b"))).drop("_a", "_b")


def _link(t: pa.Table, threshold: float):
    """Links of each row within the buckets' tiles, and row pairs that join all linked ones."""
    get = lambda c: t.column(c).to_numpy()
    key, tile, table, n, block = get("key"), get("_tile"), get("table"), get("n"), get("_block")
    vec = _matrix(t.column("vec").combine_chunks())
    sig = _matrix(t.column("sig").combine_chunks()).astype(np.int32)
    square = np.einsum("ij,ij->i", vec, vec)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
    heads = np.append(np.flatnonzero(new), len(key))
    links = np.zeros(len(key), np.int64)
    left, right = [], []
    for a, b in zip(heads.tolist(), heads[1:].tolist()):
        crossed = tile[a] >> 31 != tile[a] & (1 << 31) - 1  # two sub-blocks of a split bucket: each has a tile of its own
        for at in range(a, b, _ROWS):
            end = min(at + _ROWS, b)
            cos = vec[at:end] @ vec[a:b].T / np.sqrt(np.outer(square[at:end], square[a:b]))
            i, j = np.nonzero(cos >= threshold - 1e-9)
            c = cos[i, j]
            i, j = i + at, j + a
            edge = np.flatnonzero(c < threshold + 1e-9)  # settled by the plain formula
            x, y = i[edge], j[edge]
            c[edge] = np.einsum("ij,ij->i", vec[x], vec[y]) / np.sqrt(square[x] * square[y])
            ok = (i < j) & (c >= threshold)
            if crossed:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            if table[a]:  # a pair that shares an earlier table's signature was counted there
                ok = ~(sig[i, : table[a]] == sig[j, : table[a]]).any(axis=1)
                i, j = i[ok], j[ok]
            links += np.bincount(i, n[j], len(key)).astype(np.int64) + np.bincount(j, n[i], len(key)).astype(np.int64)
            i, j = _span(i, j, len(key))
            left.append(i)
            right.append(j)
    return links, *_span(np.concatenate(left), np.concatenate(right), len(key))


def _span(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what all pairs join: at most one for each of the n rows."""
    lab = np.arange(n)
    keep_i, keep_j = [], []
    while True:
        p, q = lab[i], lab[j]
        on = p != q
        i, j, p, q = i[on], j[on], p[on], q[on]
        if not len(i):
            break
        hi, lo = np.maximum(p, q), np.minimum(p, q)
        order = np.lexsort((lo, hi))  # each root moves under its smallest linked root
        first = order[np.append(True, hi[order][1:] != hi[order][:-1])]
        keep_i.append(i[first])
        keep_j.append(j[first])
        lab[hi[first]] = lo[first]
        while (lab[lab] != lab).any():
            lab = lab[lab]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *keep_i]), np.concatenate([none, *keep_j])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, seed: int = 13) -> DataFrame:
    """(id, n_links, component): one row per row of ``vectors``.

    ``n_links`` counts the other rows of the same label found with a cosine of at
    least ``threshold``; ``component`` is the smallest id reachable by links. Rows
    with a null label, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing, nor do vectors of different
    lengths. A null id stays null and names no component unless no id of it is
    known. Rows of equal id are rows of their own. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                          F.col(label_col).cast("string").alias("label")).withColumn("_usable", _usable())
    clean = _scaled(rows.where("_usable"))
    largest = clean.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = max(BITS, math.ceil(math.log2(largest / BUCKET)) if largest > BUCKET else 0)
    n_tables = tables_for(threshold, bits)
    # members of a class, equal labels and vectors, are known by two 64-bit hashes
    clean = clean.withColumn("h1", F.xxhash64(F.lit(1), "label", "vec")).withColumn("h2", F.xxhash64(F.lit(2), "vec", "label"))
    classes = clean.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"),
                                            F.first("label").alias("label"))
    classes = classes.select("h1", "h2", "lo", "n", "vec", F.xxhash64("label", F.size("vec")).alias("family"))
    carried = ["h1", "h2", "lo", "n", "vec", "family"]

    def sign(batches):
        for b in batches:
            vec = b.column("vec")
            dim = np.diff(vec.offsets.to_numpy())
            sig = np.zeros((b.num_rows, n_tables), np.int32)
            for d in np.unique(dim).tolist():
                on = np.flatnonzero(dim == d)
                sig[on] = _signatures(_matrix(vec.take(pa.array(on))), n_tables, bits, seed)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n_tables, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], packed], names=[*carried, "sig"])

    signed = classes.mapInArrow(sign, "h1 long, h2 long, lo long, n long, vec array<double>, family long, sig array<int>")
    signed = cut(signed.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    seats = signed.select("cls", "family", F.posexplode("sig").alias("table", "s"))
    seats = seats.select("cls", "table", F.xxhash64("family", "table", "s").alias("key"))
    met = tiles(seats, ["key"], "cls", TILE).join(signed.select("cls", "n", "vec", "sig"), "cls")

    def link(batches):
        for t in whole_groups(batches, ["key", "_tile"], 1 << 12):
            dim = np.diff(t.column("vec").combine_chunks().offsets.to_numpy())
            for d in np.unique(dim).tolist():  # a bucket holds one length
                part = t.take(pa.array(np.flatnonzero(dim == d)))
                links, i, j = _link(part, threshold)
                cls = part.column("cls").to_numpy()
                on = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([cls[on], cls[i]])), pa.array(np.concatenate([cls[on], cls[j]])),
                     pa.array(np.concatenate([links[on], np.zeros(len(i), np.int64)]))], names=["a", "b", "links"])

    found = cut(deal(met, ["key", "_tile"]).mapInArrow(link, "a long, b long, links long"), "vector-links")
    roots = components(found.where("a <> b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    base = signed.select("cls", "h1", "h2", "lo", "n")
    named = base.join(roots.select(F.col("node").alias("cls"), "root"), "cls")
    moved = named.join(named.groupBy("root").agg(F.min("lo").alias("least")), "root").select("cls", "least")
    base = base.join(counts, "cls", "left").join(moved, "cls", "left")
    base = base.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                       F.coalesce("least", "lo").alias("component"))
    linked = clean.select("id", "h1", "h2").join(base, ["h1", "h2"]).select("id", "n_links", "component")
    alone = rows.where("not _usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)
