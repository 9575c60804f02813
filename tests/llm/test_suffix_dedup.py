import random

import numpy as np
import pytest

from auditspark.llm import suffix_dedup as S


def brute(rows, n):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = bytearray(len(t))
        for a in range(len(t) - n + 1):
            w = t[a: a + n]
            if w in seen:
                gone[a: a + n] = b"\1" * n
            seen.add(w)
        runs = sum(1 for a in range(len(t)) if gone[a] and (a == 0 or not gone[a - 1]))
        out.append((-1 if rows[i][0] is None else rows[i][0], len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def case(seed, n):
    r = random.Random(seed)
    alpha = "abcdé " if seed % 2 else "ab"
    text = lambda k: "".join(r.choice(alpha) for _ in range(k))
    shared = [text(r.randint(n // 2, 5 * n)) for _ in range(6)]
    rows = []
    for i in range(90):
        t = "".join(r.choice([text(r.randint(0, 3 * n)), r.choice(shared), shared[0]]) for _ in range(r.randint(0, 4)))
        rows.append((i * 2, t))
        if r.random() < 0.3 and t:  # a near copy
            k = r.randrange(len(t))
            rows.append((1000 + i, t[:k] + "Z" + t[k + 1:]))
        if r.random() < 0.2:
            rows.append((2000 + i, t))
    rows += [(5, None), (7, ""), (9, "x" * 9 * n), (11, "x" * (n - 1)), (13, "xy" * 5 * n), (15, "\x00" * 3 * n), (None, shared[1]),
             (4000, shared[2] * 300)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,gram,shallow,hot,shard", [
    (1, 20, 6, 8, 1024, 700), (2, 24, 8, 16, 3, 700), (3, 100, 24, 48, 1024, 1 << 20), (4, 17, 17, 0, 2, 300), (5, 12, 1, 8, 20, 100)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, n, gram, shallow, hot, shard):
    rows = case(seed, n)
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string").repartition(3)
    got = []
    # the constants are read by the tasks' own interpreters: run the steps here instead
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    monkeypatch.setattr(S, "CHUNK", 97 if seed % 2 else 1 << 20)
    got = sorted((-1 if r["id"] is None else r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in local(rows, n, gram, shallow))
    assert got == brute(rows, n)
    if seed == 3:
        got = S.remove_repeats(df, length=n, gram=gram, shallow=shallow).collect()
        assert sorted((-1 if r.id is None else r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, n)


def local(rows, n, gram, shallow, buckets=3):
    """The operator's steps on one interpreter, with dictionaries for shuffles."""
    import pyarrow as pa
    from auditspark.llm import words

    def by(batches, k):
        out = {}
        for b in batches:
            for r in b.to_pylist():
                out.setdefault(r[k], []).append(r)
        return [x for key in sorted(out) for x in out[key]], out

    table = []
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "text"])
    hashes, texts = [], []
    for shard, b in enumerate(words.pieces(batch, 1, S.SHARD_BYTES)):
        data, off = words.buffer(b.column(1))
        texts.append({"shard": shard, "text": S.zstandard.ZstdCompressor().compress(data.tobytes()), "offsets": off.astype("<i8").tobytes(),
                      "ids": b.column(0).to_pylist()})
        u, c = np.unique(S.anchors(data, off, n, gram)[0], return_counts=True)
        low, c = (u & np.uint64(0xFFFFFFFF)).astype(np.uint32), c.astype(np.uint16)
        hashes += [(k, shard, S._pack(low[i:j], c[i:j])) for k, i, j in S._parts(S._bucket(u, buckets))]
    hashes.sort(key=lambda x: x[:2])
    codes = by(S._repeated([S._batch(hashes)]), "shard")[1]
    schema = pa.schema([("shard", pa.int64()), ("text", pa.binary()), ("offsets", pa.binary()), ("ids", pa.list_(pa.int64()))])
    messages = pa.list_(pa.struct([("bucket", pa.int32()), ("payload", pa.binary())]))

    def joined(name, found):
        rec = [t | {name: [{"bucket": c["bucket"], "payload": c["payload"]} for c in found.get(t["shard"], [])]} for t in texts]
        return pa.RecordBatch.from_pylist(rec, schema=schema.append(pa.field(name, messages)))

    def sent(batches):
        return [S._batch([(r["bucket"], r["shard"], r["payload"]) for r in by(batches, "bucket")[0]])]

    judged = by(S._doubts(n)(sent(S._claims(buckets, n, gram)([joined("codes", codes)]))), "called")[1]
    calls = {}
    for r in judged.get(1, []):
        calls.setdefault(r["shard"], []).append(r)
    ranges = {}
    for r in judged.get(0, []) + [x for b in S._sorted_out(n, shallow)(sent(S._contexts(n)([joined("calls", calls)]))) for x in b.to_pylist()]:
        ranges.setdefault(r["shard"], []).append(r["payload"])
    schema = pa.schema([*list(schema)[:4], ("ranges", pa.list_(pa.binary()))])
    rec = [t | {"ranges": ranges.get(t["shard"])} for t in texts]
    for b in S._cut_out([pa.RecordBatch.from_pylist(rec, schema=schema)]):
        table += b.to_pylist()
    return table


def test_deep_shallow_order():
    r = random.Random(8)
    for shallow in (0, 8, 16):
        strings = [bytes(r.choice(b"\0ab") for _ in range(r.randint(0, 30))) for _ in range(400)]
        strings += strings[:50]
        group = np.sort(np.array([r.randrange(5) for _ in strings]))
        order, lcp = S.deep_shallow(strings, group, shallow)
        for j in range(1, len(order)):
            a, b = order[j - 1], order[j]
            if group[a] != group[b]:
                assert lcp[j] == -1
                continue
            assert strings[a] <= strings[b]
            k = 0
            while k < min(len(strings[a]), len(strings[b])) and strings[a][k] == strings[b][k]:
                k += 1
            assert lcp[j] == k
        assert [group[i] for i in order] == group.tolist()


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
