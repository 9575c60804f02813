import hashlib
import random
import re
import zlib

import pytest

from auditspark.llm import conversation_trie as T


def brute(rows, every=20, heads=4):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        m = c - int(c / every) * every  # the remainder has the sign of c
        built[c] = own.get(c - m, [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = (len(members[k]) - 1) * n + sum(saved[x] for x in kids.get(k, []))
    return sorted((min(m), len(k), -9 if not k else min(members[k[:-1]]), len(m), len(kids.get(k, [])), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest())
                  for k, m in members.items())


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, near int").repartition(parts)
    out = T.trie(T.rebuilt(df, 20, 4))
    return sorted((r.id, r.depth, -9 if r.parent_id is None else r.parent_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


def some(seed, convs=160, most=7):
    r = random.Random(seed)
    texts = ["", " ", "one", "one two\nthree", "a\tb  c", "Ünï cödé", None, "x " * 50]
    out = []
    for c in range(-25, convs):
        if r.random() < 0.1:
            continue
        copy = random.Random(3) if r.random() < 0.35 else r  # a third of all are copies
        for t in range(copy.randint(1, most)):
            out.append((c, None if t == 0 and copy.random() < 0.2 else t, copy.choice(["user", "assistant", None]), copy.choice(texts)))
    return out


@pytest.mark.parametrize("block", [1 << 15, 1, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_ROWS", block)
    rows = some(block)
    assert run(spark, rows) == brute(rows)


def test_blocks_share_what_neighbours_share():
    """Any split into blocks, without Spark: the partial rows and the corrections add up."""
    r = random.Random(2)
    turns = [bytes([i]) * 16 + i.to_bytes(4, "big") for i in range(6)]
    keys = sorted(b"".join(r.choice(turns) for _ in range(r.choice([0, 1, 2, 3, 9]))) for _ in range(120))
    keys += [keys[60]] * 50
    ids = sorted((k, i) for i, k in enumerate(sorted(keys)))
    for size in (1, 3, 50, 1000):
        blocks = []
        for at in range(0, len(ids), size):
            held = []
            for k, i in ids[at: at + size]:
                if held and held[-1][0] == k:
                    held[-1][1].append(i)
                else:
                    held.append((k, [i]))
            blocks.append(held)
        n = sum(1 for p, b in enumerate(blocks) for row in T.block_rows(p, b) if row[0] == T.CLOSED)
        opened = {row[5] for p, b in enumerate(blocks) for row in T.block_rows(p, b) if row[0] == T.OPEN}
        assert n + len(opened) == len({k[:d] for k, _ in ids for d in range(0, len(k) + 1, T.WIDTH)})


def test_node_layouts_grow():
    root = T.Node(b"", 0)
    kinds = set()
    for i in range(256):
        T.insert(root, bytes([i, 1, 2])).ends = [i]
        kinds.add(root.room)
    assert kinds == {4, 16, 48, 256}
    assert sorted(k.key[0] for k in root.children()) == list(range(256))
    assert T.insert(root, bytes([77, 1, 2])).ends == [77]
    short = T.insert(root, bytes([77, 1]))
    assert short.depth == 2 and short.children()[0].ends == [77]


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    # ids 20 and 21: 21 may have fewer turns of its own than it takes from 20, and 41 has no base
    rows = [(20, i, "user", f"t{i}") for i in range(5)] + [(21, 0, "user", "own"), (41, 0, "user", "own"), (25, 0, None, None), (25, 0, None, None)]
    rows += [(60, i, "user", "same") for i in range(300)] + [(61, i, "user", "same") for i in range(300)] + [(62, 0, "user", "w " * 200000)]
    assert run(spark, rows) == brute(rows)
