"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers and annotations vote good, bad or nothing on two traits of
every document, ``junk`` and ``toxic``. Expectation-maximisation over the counts
of vote patterns (all documents; a bounded number of patterns) estimates each
labeller's accuracies, Dawid and Skene's model with abstention as a third vote.
The posterior labels of a bounded sample train a logistic scorer with L1 over
hashed word and prefix features; the scorer alone decides on documents.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .words import ALNUM, LOWER, NOT_SPACE, buffer, hashes, pieces, prefix_hashes, spans

DIMS = 1 << 20            # hashed weights of a trait
SAMPLE = 12000            # documents that train the scorer at most
SAMPLE_BYTES = 256 << 20  # and the bytes of their texts, but for the last one
MIN_DOCS = 3              # documents of the sample that share a feature, for it to get a weight
ANNOTATION_ERROR = 0.001  # rate of wrong annotations at most
PREFIXES = (4, 5, 6)      # bytes of the word prefixes that are features beside the word
TRAITS = ("junk", "toxic")
#: English insults that the ``insults`` labeller knows; other languages are learned from annotations
INSULTS = frozenset(b"idiot idiots moron morons stupid pathetic loser losers scum trash worthless disgusting clown dumb imbecile".split())

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*%$&!|@^~=<>{}\\_", np.uint8))
_BARE = np.isin(np.arange(256), np.frombuffer(b"|-*", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122)
_MARKS = np.array([0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.8])
_STEPS = hashes(np.arange(64, dtype=np.uint8), np.arange(55), np.ones(55, np.int64), 3).reshape(5, 11) % np.uint64(DIMS)
_BLOCK = 512  # documents of the sample whose features are multiplied at a time
_ABSTAIN, _GOOD, _BAD = 0, 1, 2
#: labellers of each trait; the last vote of each comes from the annotations
LABELLERS = {"junk": ("symbols", "repeats", "tables", "shouting", "variety", "annotated"), "toxic": ("insults", "annotated")}


def shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, shares) of every text: the number of words between white space;
    symbols in bytes, words equal to the word before, bare separators in words,
    capitals in ASCII letters, and distinct words in words."""
    n_rows = len(off) - 1
    starts, lens, row = spans(data, off, NOT_SPACE)
    n = np.bincount(row, minlength=n_rows)
    h = hashes(data, starts, lens, 4)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    bare = (lens == 1) & _BARE[data[starts]]
    key = np.sort(row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n_rows)

    def total(lut):
        c = np.concatenate([[0], np.cumsum(lut[data], dtype=np.int64)])
        return c[off[1:]] - c[off[:-1]]

    out = np.zeros((n_rows, 5))
    out[:, 0] = total(_SYMBOL) / np.maximum(1, np.diff(off))
    out[:, 1] = np.bincount(row[again], minlength=n_rows) / np.maximum(1, n)
    out[:, 2] = np.bincount(row[bare], minlength=n_rows) / np.maximum(1, n)
    out[:, 3] = total(_UPPER) / np.maximum(1, total(_LETTER))
    out[:, 4] = np.where(n > 0, distinct / np.maximum(1, n), 1.0)
    return n, out


def votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Votes of the heuristic labellers, two bits each, in the order of LABELLERS."""
    n, share = shapes(data, off)

    def vote(x, bad, good, least):
        return np.where(n < least, _ABSTAIN, np.where(x >= bad, _BAD, np.where(x <= good, _GOOD, _ABSTAIN)))

    low = LOWER[data]
    starts, lens, row = spans(low, off, ALNUM)
    insult = np.zeros(len(off) - 1, np.int64)
    insult[row[np.isin(hashes(low, starts, lens), _INSULT_HASHES)]] = _BAD
    out = (vote(share[:, 0], 0.05, 0.02, 5), vote(share[:, 1], 0.2, 0.08, 5), vote(share[:, 2], 0.15, 0.05, 5),
           vote(share[:, 3], 0.5, 0.2, 5), vote(-share[:, 4], -0.12, -0.3, 100), insult)
    return sum(v.astype(np.int64) << 2 * i for i, v in enumerate(out))


def _hash_of(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    lens = np.array([len(w) for w in words])
    return hashes(data, np.cumsum(lens) - lens, lens)


_INSULT_HASHES = _hash_of(sorted(INSULTS))


def features(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct ``row * DIMS + feature`` of every text: its words, their
    prefixes, and a step for each mark that a share of its shape passes.
    With ``wanted`` (a mask over the features) only those."""
    low = LOWER[data]
    starts, lens, row = spans(low, off, ALNUM)
    found = []

    def add(rows, h):
        f = (h % np.uint64(DIMS)).astype(np.int64)
        if wanted is not None:
            on = wanted[f]
            rows, f = rows[on], f[on]
        found.append(rows * DIMS + f)

    add(row, hashes(low, starts, lens, 1))
    for k in PREFIXES:
        long = lens > k
        add(row[long], prefix_hashes(low, starts[long], k, 2))
    passed = shapes(data, off)[1][:, :, None] >= _MARKS
    r, i, s = np.nonzero(passed)
    add(r, _STEPS[i, s])
    return np.unique(np.concatenate(found))


def fit_em(patterns: dict[tuple[int, ...], int], n_labellers: int, prior: float = 0.1, rounds: int = 200):
    """Dawid-Skene with abstention over counts of vote patterns.

    Returns (P(bad), accuracies[labeller, class, vote], posterior by pattern).
    Starts from labellers that are right four times in five when they vote. The
    last labeller, the annotations, anchors the classes: its votes are taken to
    be wrong at most with rate ``ANNOTATION_ERROR``.
    """
    if not patterns:
        return prior, np.full((n_labellers, 2, 3), 1 / 3), {}
    keys = sorted(patterns)
    v = np.array(keys, np.int64)
    c = np.array([patterns[k] for k in keys], float)
    acc = np.zeros((n_labellers, 2, 3))
    for i in range(n_labellers):
        share = np.array([c[v[:, i] == s].sum() for s in range(3)]) / c.sum()
        for cls in (0, 1):
            tilt = np.array([1, 1.6 if cls == 0 else 0.4, 0.4 if cls == 0 else 1.6])
            acc[i, cls] = share * tilt + 1e-3
            acc[i, cls] /= acc[i, cls].sum()
    post = np.zeros(len(keys))
    for _ in range(rounds):
        ll = np.log([1 - prior, prior]) + sum(np.log(acc[i][:, v[:, i]]).T for i in range(n_labellers))
        new = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500)))
        moved = np.abs(new - post).max()
        post = new
        prior = float(np.clip((post @ c) / c.sum(), 1e-4, 0.9))
        for i in range(n_labellers):
            for s in range(3):
                on = v[:, i] == s
                acc[i, 0, s] = (1 - post[on]) @ c[on] + 0.5
                acc[i, 1, s] = post[on] @ c[on] + 0.5
            acc[i] /= acc[i].sum(axis=1, keepdims=True)
        for cls, wrong, right in ((0, _BAD, _GOOD), (1, _GOOD, _BAD)):
            voted = acc[-1, cls, wrong] + acc[-1, cls, right]
            acc[-1, cls, wrong] = min(acc[-1, cls, wrong], ANNOTATION_ERROR * voted)
            acc[-1, cls, right] = voted - acc[-1, cls, wrong]
        if moved < 1e-9:
            break
    return prior, acc, dict(zip(keys, post.tolist()))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, alone: float = 3.0, epochs: int = 80, rate: float = 0.3):
    """Weights and bias of a logistic scorer; ``target`` holds probabilities.

    Classes weigh alike; AdaGrad steps with soft thresholding (L1), full batches.
    The L1 term outweighs the pull of ``alone`` examples of the smaller class, so
    a feature that only a few documents share gets no weight.
    """
    w = np.zeros(DIMS, np.float32)
    if not len(rows) or target.max(initial=0) < 0.5 or target.min(initial=1) >= 0.5:
        return w, (4.0 if len(rows) and target.min(initial=1) >= 0.5 else -4.0)
    weight = np.where(target >= 0.5, 0.5 / (target >= 0.5).sum(), 0.5 / (target < 0.5).sum())
    l1 = alone * weight.max()
    used = np.zeros(DIMS, bool)
    for r in rows:
        used[r] = True
    column = np.cumsum(used, dtype=np.int32) - 1
    blocks = []  # some documents at a time, so that a pass needs little memory
    for at in range(0, len(rows), _BLOCK):
        part = rows[at: at + _BLOCK]
        lens = np.array([len(r) for r in part])
        blocks.append((slice(at, at + len(part)), column[np.concatenate(part)], lens, np.cumsum(lens) - lens))
    wd = np.zeros(int(used.sum()))
    g2, b, gb2 = np.full(len(wd), 1e-12), 0.0, 1e-12
    for _ in range(epochs):
        g, gb = np.zeros(len(wd)), 0.0
        for rows_at, idx, lens, starts in blocks:
            z = np.add.reduceat(wd[idx], starts) + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[rows_at]) * weight[rows_at]
            g += np.bincount(idx, weights=np.repeat(err, lens), minlength=len(wd))
            gb += err.sum()
        g2 += g * g
        step = rate / np.sqrt(g2)
        wd -= step * g
        wd = np.sign(wd) * np.maximum(0, np.abs(wd) - step * l1)
        gb2 += gb ** 2
        b -= rate / np.sqrt(gb2) * gb
    w[used] = wd
    return w, float(b)


@dataclass
class Model:
    """A scorer for each trait, and what the weak-label model found."""
    weights: dict[str, np.ndarray]
    bias: dict[str, float]
    accuracies: dict[str, np.ndarray]
    prior: dict[str, float]

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of each trait (columns, as TRAITS) for each text (rows)."""
        w = [self.weights[t] for t in TRAITS]
        key = features(data, off, (w[0] != 0) | (w[1] != 0))
        row, f = key // DIMS, key % DIMS
        z = [np.bincount(row, weights=x[f], minlength=len(off) - 1) + self.bias[t] for x, t in zip(w, TRAITS)]
        return 1 / (1 + np.exp(-np.clip(np.stack(z, axis=1), -30, 30)))


def _split(packed: int, annotated: dict[str, int]) -> dict[str, tuple[int, ...]]:
    own = [packed >> 2 * i & 3 for i in range(6)]
    return {"junk": (*own[:5], annotated["junk"]), "toxic": (own[5], annotated["toxic"])}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
        sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model from all documents' votes and the words of at most ``sample``
    documents (ids), whose texts have ``sample_bytes`` but for the last one.

    Texts that are null or empty abstain and train nothing. Rows of ``labels``
    with a null id are ignored; of contradicting rows of an id the worse counts;
    ids without a document, or without any label, are no error. Without a bad
    example of a trait its scorer rejects nothing.
    """
    def run(batches):
        for b in (p for batch in batches for p in pieces(batch, 1)):
            v = votes(*buffer(b.column(1)))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.int32()), size], names=["id", "v", "size"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lab = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id is not null").groupBy("id")
           .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")))
    vote = lambda c, bad: F.when(F.col(c).isNull(), 0).when(F.col(c) == bad, 2).otherwise(1)
    narrow = src.mapInArrow(run, "id long, v int, size long").join(lab, "id", "left")
    narrow = cut(narrow.select("id", "v", "size", vote("q", 0).alias("junk"), vote("t", 1).alias("toxic")), "weak-votes")
    counts = narrow.groupBy("v", "junk", "toxic").count().collect()  # at most 3^8 patterns
    acc, prior, post = {}, {}, {}
    for trait in TRAITS:
        patterns: dict[tuple[int, ...], int] = {}
        for r in counts:
            k = _split(r.v, {"junk": r.junk, "toxic": r.toxic})[trait]
            patterns[k] = patterns.get(k, 0) + r["count"]
        prior[trait], acc[trait], post[trait] = fit_em(patterns, len(LABELLERS[trait]))
    # a bounded sample: half from annotated documents, so that both traits have sure votes
    order = F.xxhash64(F.lit(11), "id")
    some = narrow.where("id is not null").withColumn("known", F.expr("junk > 0 and toxic > 0"))
    picked = some.where("known").orderBy(order, "id").limit(sample * 3 // 4).union(
        some.where("not known and v > 0").orderBy(order, "id").limit(sample - sample * 3 // 4))
    upto = Window.orderBy(order, "id", "v", "size").rowsBetween(Window.unboundedPreceding, -1)  # over at most `sample` narrow rows
    picked = picked.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).where(F.col("before") < sample_bytes)
    picked = F.broadcast(picked.drop("known", "size", "before").dropDuplicates(["id", "v"]))

    def take(batches):
        for b in (p for batch in batches for p in pieces(batch, 1)):
            key = features(*buffer(b.column(1)))
            at = np.searchsorted(key, np.arange(b.num_rows + 1) * DIMS)
            f = (key % DIMS).astype("<i4")
            packed = [f[i:j].tobytes() for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(votes(*buffer(b.column(1))), pa.int32())],
                                             names=["id", "f", "v"])

    # of an id's rows one counts: the bound holds however often an id repeats
    rows = src.where("text is not null").join(picked.select("id").distinct(), "id", "left_semi").mapInArrow(take, "id long, f binary, v int")
    one = rows.join(picked, ["id", "v"]).groupBy("id").agg(F.min(F.struct("f", "v", "junk", "toxic")).alias("x"))
    got = one.select("id", "x.*").toArrow().sort_by("id")
    df = np.zeros(DIMS, np.int32)
    for x in got.column("f"):
        df[np.frombuffer(x.as_buffer(), np.int32)] += 1
    feats = [(f := np.frombuffer(x.as_buffer(), np.int32))[df[f] >= MIN_DOCS] for x in got.column("f")]
    got = got.drop_columns(["f"])
    weights, bias = {}, {}
    for trait in TRAITS:
        keys = [_split(v, {"junk": j, "toxic": t})[trait] for v, j, t in
                zip(*(got.column(c).to_pylist() for c in ("v", "junk", "toxic")))]
        sure = [i for i, k in enumerate(keys) if any(k) and len(feats[i])]
        target = np.array([post[trait][keys[i]] for i in sure])
        weights[trait], bias[trait] = fit_linear([feats[i] for i in sure], target)
    return Model(weights, bias, acc, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5,
          names: tuple[str, str, str] = ("_p_junk", "_p_toxic", "_kept")) -> DataFrame:
    """``docs`` with the probabilities of both traits and whether both are below
    ``threshold``, under ``names`` (a column of ``docs`` of such a name is replaced).

    Map-only; other columns pass through. Null and empty texts score as a text
    without words.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * DIMS floats, whatever the corpus
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in (p for batch in batches for p in pieces(batch, at)):
            p = m.score(*buffer(b.column(at)))
            kept = (p < threshold).all(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(kept)],
                                             names=[*b.schema.names, *names])

    kinds = T.DoubleType(), T.DoubleType(), T.BooleanType()
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    return docs.mapInArrow(run, schema)
