import hashlib
import random

import numpy as np
import pytest

from auditspark.llm import piece_encoding as P

tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "héllo  wörld", "你好𝔘", "\n\t", "▁", "a▁b", "<s>", "</s>", "<0x41>", "\x00", "١٢٣", "é", "ﬁ", "Ａｂ", "㌀",
       " ", "　", "가나", "�", "😀😀", "x" * 200, "...!?", "ﷺ", "¨", "​", "\r\n"]


def texts(n=300):
    r = random.Random(5)
    mixed = ["".join(r.choice([*ODD, " ", "the", " and", "über", "1"]) for _ in range(r.randint(1, 40))) for _ in range(n)]
    return [t.encode() for t in ODD + mixed] + [b"ab\xffcd \xe4\xbd", b"\xed\xa0\x80x", b"\xf0\x9f\x98", b"\xc0\xaf \xff"]


def variant(rule=None, squeeze=False, prefix=True, suffix=False, fallback=True, symbols=()):
    """The installed model with another normaliser or other marks; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    if rule:
        m.normalizer_spec.precompiled_charsmap = charmap(rule)
    m.normalizer_spec.remove_extra_whitespaces = squeeze
    m.normalizer_spec.add_dummy_prefix = prefix
    m.trainer_spec.treat_whitespace_as_suffix = suffix
    if not fallback:
        m.trainer_spec.byte_fallback = False
        for p in m.pieces:
            if p.type == 6:
                p.type = 5
    for s in symbols:
        m.pieces.add(piece=s, score=0.0, type=4)
    return m.SerializeToString()


def charmap(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb
    n = spm.SentencePieceNormalizer(rule_name=rule)
    spec = pb.NormalizerSpec()
    blob = n.serialized_normalizer_spec
    spec.ParseFromString(blob() if callable(blob) else blob)
    return spec.precompiled_charsmap


VARIANTS = {
    "plain": {}, "nfkc": {"rule": "nmt_nfkc"}, "nfkc squeezed": {"rule": "nmt_nfkc", "squeeze": True}, "folded": {"rule": "nmt_nfkc_cf", "squeeze": True},
    "no prefix": {"prefix": False}, "suffix": {"suffix": True, "squeeze": True}, "unknowns": {"fallback": False, "rule": "nfkc"},
    "symbols": {"symbols": ("<tool>", "Ａｂ", " and"), "rule": "nmt_nfkc"},
}


@pytest.mark.parametrize("name", VARIANTS)
def test_ids_and_spans_equal_the_library(name):
    model = variant(**VARIANTS[name])
    enc, lib = P.Encoder(model), spm.SentencePieceProcessor(model_proto=model)
    for raw in texts() + ([b"x<tool>y <tool><tool> and and"] if "symbols" in name else []):
        ids, begins, ends = enc.encode(raw)
        want = lib.encode(raw, add_bos=True, add_eos=True)
        assert ids.tolist() == want, raw
        assert enc.decode(ids) == lib.decode(want)
        plain = lib.encode(raw, return_type="proto").pieces
        assert [(p.begin, p.end) for p in plain] == list(zip(begins[1:-1].tolist(), ends[1:-1].tolist())), raw
        assert (begins[0], ends[0], begins[-1], ends[-1]) == (0, 0, len(raw), len(raw))


def test_rows(spark):
    lib = spm.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t.decode(errors="ignore"), "x") for i, t in enumerate(texts(40))]
    rows += [(3, None, "x"), (None, "no id", "x"), (7, "again", "x"), (7, "again", "x"), (8, "lorem ipsum é " * 30000, "x"), (9, "y" * 300000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = sorted((-1 if i is None else i, len(e), sha(np.array(e, "<u4").tobytes()), sha(lib.decode(e).encode()))
                  for i, t, _ in rows for e in [lib.encode(t or "", add_bos=True, add_eos=True)])
    got = [(-1 if r.id is None else r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.digests(df, MODEL).collect()]
    assert sorted(got) == want
    full = P.encode(df.where("doc_id < 40 or doc_id is null"), MODEL)
    texts_of = {}
    for i, t, _ in rows:
        texts_of.setdefault(i, set()).add(t or "")
    for r in full.collect():
        ok = False
        for t in texts_of[r.id]:
            raw = t.encode()
            joined = b"".join(raw[b:e] for b, e in zip(r.begins, r.ends))
            ok |= joined == raw
        assert ok, r.id  # the spans of this model's pieces are the text
    back = {(r.id, r.text) for r in P.decode(full, MODEL).collect()}
    assert (7, "again") in back and (None, "no id") in back
    assert P.digests(df.where("false"), MODEL).count() == 0


def sha(b):
    return hashlib.sha256(b).hexdigest()
