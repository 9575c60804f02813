import random
import zlib

import numpy as np
import pytest

from auditspark.llm import token_files as T

P = pytest.importorskip("public_tokenizers")
END = 2


def test_round_trip(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    r = random.Random(1)
    odd = ["It's", "CAFÉ", "é", "ΟΔΟΣ", "ﬁ", "\x1c", "\xa0", "a\x85b", " ", "...", ",\"", "12x3", "😀😀", "<|endoftext|>", "İİ",
           "\x0b", "\t\n", "ñandú", "<|ENDOFTEXT|>", "I\u0307.", "Σ.", "ΑΣ,", "a.b.", "it's,", "x!", "7.", "é.", "K.", "don't!?", "ma'am.", "中文", "\x00", "KK"]
    texts = [None, "", " \n"] + odd + ["".join(r.choice(odd + [" ", "word", "The"]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    texts.append("lorem ipsum " * 60000)
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    rows += [(None, "last one", "x"), (6, "same id", "x"), (6, "same id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    m = T.write(df, P.path("word_bpe_49k.json"), END)
    got = sorted((r.start, -1 if r.id is None else r.id, r.n_tokens, r.ids_crc32) for r in T.read(m).collect())
    want = {}
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [END]
        want.setdefault(-1 if i is None else i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [g[1] for g in got] == sorted(g[1] for g in got if g[1] >= 0) + [-1]
    at = 0
    seen = {}
    for start, i, n, crc in got:
        assert start == at
        at += n
        seen.setdefault(i, []).append((n, crc))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_remembering_changes_nothing(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(T, "CACHE", 5)
    path = P.path("word_bpe_49k.json")
    enc, lib = T.Encoder(path, END), Tokenizer.from_file(path)
    r = random.Random(4)
    parts = ["The", "the.", "the,", "THE", "a", "B.", "c!", "'s", "it's.", "\u0301.", "e\u0301.", "I\u0307", "ß", "ﬁ,", ".", ",,", "1.5", "#x.", "straße", "ÿàø", "×", "÷", "éé"]
    for _ in range(300):
        t = "".join(r.choice(parts + [" ", "\n"]) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(enc(t.encode()), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids + [END]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.read(T.write(df, P.path("word_bpe_49k.json"), END)).collect() == []


def test_letters_compose_before_they_are_lowered():
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    enc, lib = T.Encoder(path, END), Tokenizer.from_file(path)
    pairs = ["H̱", "T̈", "J̌", "W̊", "Y̊"]  # the small letter composes, the capital doesn't
    texts = [t for p in pairs for t in (p, p + "izb", p.lower() + "izb", f"The {p}izb. A{p}, THE end", f"{p}IZB {p.lower()}")]
    for t in [*texts, " ".join(texts)]:
        assert np.frombuffer(enc(t.encode()), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids + [END]


def test_a_tokenizer_that_keeps_space_and_case(spark):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    assert T.Encoder(P.path("word_bpe_49k.json"), END).cut and not T.Encoder(path, END).cut
    lib = Tokenizer.from_file(path)
    texts = ["Hello big world", "  two  spaces\n\n", "", None, "ÄÖ é́", "hello big world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.id: (r.n_tokens, r.ids_crc32) for r in T.read(T.write(df, path, END)).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [END]
        assert got[i][0] == len(ids)
        assert got[i][1] == zlib.crc32(np.array(ids, "<u4").tobytes())
