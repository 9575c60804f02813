"""Language identification with interpolated Kneser-Ney character models.

Character 4-grams of all training documents are counted per language on the
executors and summed by Spark; lower orders (continuation counts) and the sums of
each context are Spark aggregates over all of them. Every count of every language
is written to the shared folder, by hash ranges, as sorted arrays that the
workers map into memory. A text gets the language with the lowest cross-entropy
per character; a cross-entropy above what texts of that language reach is marked
as rejected. That limit is a percentile of all the language's training texts.
"""
from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path
from .token_files import _file_system
from .words import buffer, mix, pieces

PIECE = 1 << 20          # bytes of text taken at a time
CELLS = 1 << 22          # probabilities (4-grams x languages) held at a time
PARTS = 64               # hash ranges of the written counts, a power of two
ACCEPT = 0.995           # share of a language's training texts that stay accepted
MARGIN = 1.1             # room above that cross-entropy, as those texts were trained on
DISCOUNT = 0.75
UNKNOWN = "und"

_symbols: np.ndarray | None = None


def _symbol_table() -> np.ndarray:
    """Code point to symbol: lower-case letters in 16 bits, 0 for all else."""
    global _symbols
    if _symbols is None:
        t = np.zeros(0x110000, np.uint64)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                x = ord(s.lower()) if len(s.lower()) == 1 else c
                t[c] = x if x < 0xE000 or 0xF900 <= x < 0x10000 else 0xE000 + x % 0x1900  # letters beyond share the private area
        _symbols = t
    return _symbols


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, letters): the 4-gram ending at every character of every
    row, runs of other characters being one boundary, where each row's begin, and
    its number of letters. Every row has at least one, at its end."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    s = _symbol_table()[code]
    keep = s != 0
    n_letters = np.concatenate([[0], np.cumsum(keep)])
    letters = n_letters[first[1:]] - n_letters[first[:-1]]
    after = np.zeros(len(s), bool)
    after[1:] = s[:-1] != 0
    heads = first[:-1][first[:-1] < len(s)]
    after[heads] = False
    keep |= after
    total = np.concatenate([[0], np.cumsum(keep)])
    count = total[first[1:]] - total[first[:-1]]
    n = len(count)
    row = np.repeat(np.arange(n), count)
    out = np.zeros(len(row) + 4 * n, np.uint64)
    out[np.arange(len(row)) + 4 * row + 3] = s[keep]
    at = np.concatenate([[0], np.cumsum(count + 4)])
    wide = out.copy()
    for k in (1, 2, 3):
        wide[k:] |= out[:-k] << np.uint64(16 * k)
    use = np.ones(len(out), bool)
    for k in range(3):
        use[at[:-1] + k] = False
    return wide[use], np.concatenate([[0], np.cumsum(count + 1)])[:-1], letters


_MASK = [np.uint64((1 << 16 * k) - 1) for k in range(5)]
_BOUNDS = np.arange(PARTS, dtype=np.uint64) << np.uint64(65 - PARTS.bit_length())
#: of an n-gram its count, of a context the count and the number of its n-grams
_VALUE = np.dtype([("lang", "<u4"), ("kinds", "<u4"), ("n", "<i8")])
#: tables: n-grams of the orders 1 to 4, then the contexts of these orders
_GRAMS, _CONTEXTS = (0, 1, 2, 3), (4, 5, 6, 7)
_SECTIONS = "part int, t int, start long, size long, kinds long"
_mapped: dict[str, dict[str, np.ndarray]] = {}


def _map(folder: str, name: str, kind) -> np.ndarray:
    """A file of the shared folder mapped into memory, which later tasks of the
    worker use again; of a folder that isn't a local one, a copy without a name."""
    if folder not in _mapped:
        _mapped.clear()
        _mapped[folder] = {}
    held = _mapped[folder]
    if name not in held:
        fs, root = _file_system(folder)
        if isinstance(fs, pa.fs.LocalFileSystem):
            held[name] = np.memmap(f"{root}/{name}", kind, "r")
        else:
            f = tempfile.TemporaryFile()
            with fs.open_input_stream(f"{root}/{name}") as src:
                while block := src.read(1 << 22):
                    f.write(block)
            f.flush()
            held[name] = np.memmap(f, kind, "r")
    return held[name]


class Held:
    """Counts in memory: for each table the sorted hashes and their values."""

    def __init__(self, tables: list):
        self.tables, self.bounds = tables, _BOUNDS[:1]

    def section(self, part: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.tables[t]


class Written:
    """Counts in the shared folder, found through the (start, size) of each table in each part."""

    def __init__(self, folder: str, sections: dict):
        self.folder, self.sections, self.bounds = folder, sections, _BOUNDS

    def section(self, part: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        start, size = self.sections.get((part, t), (0, 0))
        if not size:
            return np.zeros(0, np.uint64), np.zeros(0, _VALUE)
        at = slice(start, start + size)
        return _map(self.folder, f"{part:04d}.hash", np.uint64)[at], _map(self.folder, f"{part:04d}.value", _VALUE)[at]


def _find(counts, t: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``keys``, value) of every entry of these keys in any language."""
    h = mix(keys)  # one to one
    order = np.argsort(h)
    h = h[order]
    ends = np.append(np.searchsorted(h, counts.bounds), len(h))
    where, values = [np.zeros(0, np.int64)], [np.zeros(0, _VALUE)]
    for part in np.flatnonzero(np.diff(ends)):
        hashes, value = counts.section(int(part), t)
        mine = slice(ends[part], ends[part + 1])
        low = np.searchsorted(hashes, h[mine], "left")
        n = np.searchsorted(hashes, h[mine], "right") - low
        if n.any():
            where.append(np.repeat(order[mine], n))
            values.append(value[np.repeat(low + n - np.cumsum(n), n) + np.arange(n.sum())])
    return np.concatenate(where), np.concatenate(values)


@dataclass
class Model:
    languages: list[str]
    counts: Held | Written
    alphabet: int    # symbols seen, and one for all others
    limit: dict[str, float] = field(default_factory=dict)

    def probs(self, keys: np.ndarray, order: int = 4) -> np.ndarray:
        """Probability [key, language] of the last symbol of distinct n-grams.

        Interpolated Kneser-Ney with one discount: the highest order uses counts,
        the lower ones the numbers of distinct left neighbours, down to the
        uniform one.
        """
        if not order:
            return np.full((len(keys), len(self.languages)), 1 / self.alphabet)
        below, at = np.unique(keys & _MASK[order - 1], return_inverse=True)
        p = self.probs(below, order - 1)[at]
        ctx, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        lam, total = np.ones((len(ctx), len(self.languages))), np.full((len(ctx), len(self.languages)), np.inf)
        k, v = _find(self.counts, _CONTEXTS[order - 1], ctx)
        total[k, v["lang"]] = v["n"]
        lam[k, v["lang"]] = DISCOUNT * v["kinds"] / v["n"]
        p *= lam[at]
        k, v = _find(self.counts, _GRAMS[order - 1], keys)
        p[k, v["lang"]] += np.maximum(v["n"] - DISCOUNT, 0) / total[at[k], v["lang"]]
        return p

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """log2 probability of each 4-gram's last character in each language."""
        each, at = np.unique(keys, return_inverse=True)
        return np.log2(self.probs(each)).astype(np.float32)[at]

    def entropies(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character [row, language], letters)."""
        keys, starts, letters = grams(data, off)
        ends = np.append(starts[1:], len(keys))
        total = np.zeros((len(starts), len(self.languages)))
        step = max(1, CELLS // max(1, len(self.languages)))
        for at in range(0, len(keys), step):
            part = keys[at: at + step]
            first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part))
            total[first:last] += np.add.reduceat(self.log_probs(part), np.maximum(starts[first:last] - at, 0), axis=0, dtype=np.float64)
        return -total / (ends - starts)[:, None], letters

    def texts(self, batch: pa.RecordBatch, column: int):
        """Slices of a batch whose results are of bounded size."""
        step = max(1, CELLS // max(1, len(self.languages)))
        for b in pieces(batch, column, PIECE):
            yield from (b.slice(at, step) for at in range(0, b.num_rows, step))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model in memory from each language's 4-grams and their counts."""
    langs = sorted(counts)
    tables: list[list] = [[] for _ in range(8)]
    for k, v in enumerate(langs):
        g, c = counts[v]
        for n in (4, 3, 2, 1):
            if n < 4:
                g, c = np.unique(g & _MASK[n], return_counts=True)
            ctx, inv = np.unique(g >> np.uint64(16), return_inverse=True)
            for t, key, size, kinds in ((_GRAMS[n - 1], g, c, 0), (_CONTEXTS[n - 1], ctx, np.bincount(inv, c), np.bincount(inv))):
                value = np.zeros(len(key), _VALUE)
                value["lang"], value["n"], value["kinds"] = k, size, kinds
                tables[t].append((mix(key), value))
    held = []
    for t in tables:
        h = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in t)])
        o = np.argsort(h, kind="stable")
        held.append((h[o], np.concatenate([np.zeros(0, _VALUE), *(x[1] for x in t)])[o]))
    return Model(langs, Held(held), len(np.unique(held[0][0])) + 1)


def store(counted: DataFrame) -> Model:
    """The model from (lang, gram, n) of all 4-grams, its counts written to the shared folder."""
    spark = counted.sparkSession
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())  # a name for each language
    folder = new_path(spark, "language-model")
    tables, grams_of = [], counted
    for n in (4, 3, 2, 1):
        if n < 4:
            grams_of = grams_of.groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(_MASK[n]))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        contexts = grams_of.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("gram")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
        tables.append(grams_of.select(F.lit(_GRAMS[n - 1]).alias("t"), "lang", "gram", "n", F.lit(0).cast("long").alias("kinds")))
        tables.append(contexts.select(F.lit(_CONTEXTS[n - 1]).alias("t"), "lang", "gram", "n", "kinds"))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)

    def hashed(batches):
        names = pa.array(langs, pa.string())
        for b in batches:
            h = mix(b.column(2).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.searchsorted(_BOUNDS, h, "right") - 1).astype(np.int32)), b.column(0), pa.array(h.view(np.int64)),
                 pa.compute.index_in(b.column(1), value_set=names), b.column(3), b.column(4)], names=["part", "t", "h", "lang", "n", "kinds"])

    def write(batches):
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        out, held, found = {}, None, {}

        def whole():
            for end, (path, f) in out.items():
                f.close()
                fs.move(path, f"{root}/{held:04d}.{end}")
            start, rows = 0, []
            for t in sorted(found):
                rows.append({"part": held, "t": t, "start": start, "size": found[t][0], "kinds": found[t][1]})
                start += found[t][0]
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("t", pa.int32()), ("start", pa.int64()),
                                                                      ("size", pa.int64()), ("kinds", pa.int64())]))

        for batch in batches:
            part = batch.column(0).to_numpy()
            for lo, hi in _runs(part):
                if part[lo] != held:
                    if out:
                        yield whole()
                    held, found = int(part[lo]), {}
                    names = {end: f"{root}/{held:04d}.{end}.{uuid.uuid4().hex}.tmp" for end in ("hash", "value")}
                    out = {end: (path, fs.open_output_stream(path)) for end, path in names.items()}
                t, h, lang, n, kinds = (batch.column(k).to_numpy()[lo:hi] for k in range(1, 6))
                value = np.zeros(hi - lo, _VALUE)
                value["lang"], value["kinds"], value["n"] = lang, kinds, n
                out["hash"][1].write(h.astype("<i8").tobytes())
                out["value"][1].write(value.tobytes())
                for a, z in _runs(t):
                    had = found.setdefault(int(t[a]), [0, 0, None])
                    had[0] += z - a
                    had[1] += int((h[a + 1: z] != h[a: z - 1]).sum()) + (had[2] is None or int(h[a]) != had[2])
                    had[2] = int(h[z - 1])
        if out:
            yield whole()

    dealt = every.select("t", "lang", "gram", "n", "kinds").mapInArrow(hashed, "part int, t int, h long, lang int, n long, kinds long")
    dealt = dealt.repartitionById(PARTS, F.col("part")).sortWithinPartitions("part", "t", "h", "lang")
    sections = dealt.mapInArrow(write, _SECTIONS).collect()  # eight rows at most for each of PARTS
    alphabet = sum(r["kinds"] for r in sections if r["t"] == _GRAMS[0]) + 1
    return Model(langs, Written(folder, {(r["part"], r["t"]): (r["start"], r["size"]) for r in sections}), alphabet)


def _runs(a: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every run of equal values."""
    at = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, int)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def _merge(a, b):
    keys, inv = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(inv, np.concatenate([a[1], b[1]])).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of ``docs`` (text, lang), all of both known."""
    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in (p for batch in batches for p in pieces(batch, 0, PIECE)):
            lang = b.column(1)
            for v in lang.unique().to_pylist():
                text = b.column(0).filter(pa.compute.equal(lang, v))
                new = np.unique(grams(*buffer(text))[0], return_counts=True)
                held[v] = _merge(held[v], new) if v in held else new
            if sum(len(k) for k, _ in held.values()) > 1 << 21:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    def _rows(held):
        for v, (k, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))],
                                             names=["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo
    5, is 0 (a null id counts as the empty text, and so is held out)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the documents that are not held out and have text and language."""
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = train.where(~held_out(F.col("id"))).where("text is not null and lang is not null")
    model = store(cut(count_grams(train.select("text", "lang")), "language-grams"))
    if not model.languages:
        return model
    own = own_bits(train, model)
    q = lambda x: F.percentile_approx(x, ACCEPT)
    limits = own.groupBy("lang").agg(F.coalesce(q(F.when(F.col("letters") > 0, F.col("bits"))), q("bits")).alias("q"))
    for r in limits.collect():  # a row for each language
        model.limit[r.lang] = r.q * MARGIN
    return model


def own_bits(docs: DataFrame, model: Model) -> DataFrame:
    """(lang, bits, letters) of ``docs`` (text, lang): each text's cross-entropy in
    its own language, which is one of the model's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names; the counts stay in their files

    def run(batches):
        m = shared.value
        names = pa.array(m.languages, pa.string())
        for b in (p for batch in batches for p in m.texts(batch, 0)):
            h, letters = m.entropies(*buffer(b.column(0)))
            own = pa.compute.index_in(b.column(1), value_set=names).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(h[np.arange(b.num_rows), own]), pa.array(letters.astype(np.int64))],
                                             names=["lang", "bits", "letters"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, bits double, letters long")


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_lang``, ``_score``, ``_bits`` and ``_rejected``.

    ``_score`` is the language's share of 2 ** -bits among all languages. A null
    text and one without a letter get "und" and score 0; so does every text when
    nothing was learned. ``_rejected`` tells whether the cross-entropy, ``_bits``,
    is above the language's calibrated limit. Other columns pass through; columns
    of these names are replaced.
    """
    from pyspark.sql import types as T
    docs = docs.drop("_lang", "_score", "_bits", "_rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names and limits; the counts stay in their files
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        names = pa.array([*m.languages, UNKNOWN], pa.string())
        limit = np.array([m.limit.get(v, np.inf) for v in m.languages] + [np.inf])
        for b in (p for batch in batches for p in m.texts(batch, at)):
            n = b.num_rows
            best, score, bits = np.full(n, len(m.languages)), np.zeros(n), np.zeros(n)
            if m.languages and n:
                h, letters = m.entropies(*buffer(b.column(at)))
                on = np.flatnonzero(letters > 0)
                low = h[on].argmin(axis=1)
                best[on] = low
                bits[on] = h[on, low]
                score[on] = 1 / np.exp2(h[on, low][:, None] - h[on]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, names.take(pa.array(best)), pa.array(score), pa.array(bits), pa.array(bits > limit[best])],
                names=[*b.schema.names, "_lang", "_score", "_bits", "_rejected"])

    extra = [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_bits", T.DoubleType()),
             T.StructField("_rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))
