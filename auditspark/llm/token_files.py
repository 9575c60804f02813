"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are encoded where they lie, dealt by ranges of their ids and written in
ascending order, one file for each range, straight into the shared folder: ids
(``.bin``, little-endian unsigned 16 or 32 bit) and offsets (``.idx``, 64 bit). A
manifest table lists the files; the position of a file's first id in the whole
corpus is a prefix sum over it. Readers map the files into memory.
"""
from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, parallelism

CACHE = 1 << 19  # chunks of a generation
#: words of lower-case Latin letters, which no normalisation or splitting changes: the library's BPE takes them at once
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: byte-level BPE's characters for bytes: visible ones stay, the others follow from 256 on
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
_MARKS, _PLAIN = frozenset(b".,;:!?"), frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_MANIFEST = "part long, path string, n_docs long, n_tokens long, width int"


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _put(fs: pa.fs.FileSystem, path: str, write) -> None:
    """A whole file or none, whichever attempt of a task comes last."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        write(f)
    fs.move(tmp, path)


def _drops_space_and_case(tokenizer_path: str) -> bool:
    """Whether the tokenizer's own file says that letters are lowered and that what lies
    between its words is removed: a normaliser of nothing but composition, white space and
    lower case, and a split that removes what its pattern does not name."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)

    def parts(x: dict | None, key: str) -> list[dict]:
        return [] if x is None else [y for z in x[key] for y in parts(z, key)] if x["type"] == "Sequence" else [x]

    norm, pre = parts(spec.get("normalizer"), "normalizers"), parts(spec.get("pre_tokenizer"), "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in norm)
    split = bool(pre) and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] for p in pre[1:])
    return plain and any(n["type"] == "Lowercase" for n in norm) and split and rest


class Encoder:
    """The tokenizers library over whole texts, remembering chunks between white space
    where the tokenizer's file says that texts may be cut there; else every text is
    given to the library whole.

    In the first case the library drops white space, never joins across it and lowers all letters,
    so a text's ids are those of its chunks one after the other, ASCII ones
    lower-cased; and one mark at the end of a chunk, after an ASCII letter or
    digit, is a token run of its own. The library composes letters before it
    lowers them, so other chunks stay as written. Two generations of CACHE chunks
    are remembered.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(tokenizer_path)
        self.code = "H" if max(self.lib.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "I"
        self.end = array(self.code, [end_id]).tobytes()
        probe = ["abc", "straße", "é", "àÿø".lower()]  # whether the vocabulary treats such words so
        self.simple = all([t.id for t in self.lib.model.tokenize(w.encode().decode("latin-1").translate(_BYTE_CHARS))]
                          == self.lib.encode(w, add_special_tokens=False).ids for w in probe)
        self.cut = _drops_space_and_case(tokenizer_path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.specials = [t.encode() for t in self.lib.get_added_tokens_decoder().values() for t in [t.content]]

    def _encode(self, chunks: list[bytes]) -> None:
        known, code, bpe = self.known, self.code, self.lib.model.tokenize
        rest = []
        for c in chunks:
            if self.simple and _WORD.fullmatch(c):
                known[c] = array(code, [t.id for t in bpe(c.decode() if c.isascii() else c.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            else:
                rest.append(c)
        for at in range(0, len(rest), 4096):
            part = rest[at: at + 4096]
            for c, e in zip(part, self.lib.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)):
                known[c] = array(code, e.ids).tobytes()

    def _learn(self, chunks: set[bytes]) -> None:
        known, before = self.known, self.before
        missing = chunks.difference(known)
        old = [c for c in missing if c in before]
        for c in old:
            known[c] = before[c]
        missing.difference_update(old)
        # capitals: an ASCII chunk has the ids of its lower-case form
        same = {c: low for c in missing if c.isascii() and (low := c.lower()) != c and not any(t in low for t in self.specials)}
        missing.difference_update(same)
        missing.update(low for low in same.values() if low not in known)
        split = [c for c in missing if len(c) > 1 and c[-1] in _MARKS and c[-2] in _PLAIN]
        missing.difference_update(split)
        missing.update(c[:-1] for c in split)
        missing.update(c[-1:] for c in split)
        self._encode([c for c in missing if c not in known])
        for c in split:
            known[c] = known[c[:-1]] + known[c[-1:]]
        for c, low in same.items():
            known[c] = known[low]

    def __call__(self, text: bytes) -> bytes:
        if not self.cut:
            return array(self.code, self.lib.encode(text.decode(), add_special_tokens=False).ids).tobytes() + self.end
        chunks = text.split()
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        self._learn(set(chunks))
        return b"".join(map(self.known.__getitem__, chunks)) + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(tokenizer_path: str, end_id: int) -> Encoder:
    """The worker's encoder, which later tasks of the worker use again."""
    key = (tokenizer_path, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          folder: str | None = None) -> DataFrame:
    """Write the ids of all documents; returns the manifest with ``base``, the
    number of ids before each file.

    Null texts are encoded as empty ones: the end id alone. Null document ids come
    last; rows of equal ids follow each other in the order of their ids' bytes.
    ``folder`` must be a new one that driver and executors share; by default it
    lies in the shared folder. No documents give no files.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = parallelism(spark)
    cuts = src.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10000)).first()[0] if n > 1 else None
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def encode(batches):
        enc = encoder(tokenizer_path, end_id)
        for b in batches:
            ids = b.column(0)
            part = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            part[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds)
            for at in range(0, b.num_rows, 256):
                out = [enc(t.as_py() or b"") for t in b.column(1).slice(at, 256).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(part[at: at + 256]), ids.slice(at, 256), pa.array(out, pa.binary())],
                                                 names=["part", "id", "ids"])

    def store(batches):
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        width = np.dtype(encoder(tokenizer_path, end_id).code).itemsize
        held, lens, ids = None, [], []

        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))

        def whole(part, data):
            off = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]) // width
            null = np.array([i is None for i in ids], np.uint8)
            head = np.array([len(ids)], "<i8")
            key = np.array([i or 0 for i in ids], "<i8")
            stem = f"{root}/{part:08d}"
            fs.move(data, f"{stem}.bin")
            _put(fs, f"{stem}.idx", lambda f: [f.write(x.tobytes()) for x in (head, off.astype("<i8"), key, null)])
            return pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder.rstrip('/')}/{part:08d}", "n_docs": len(ids),
                                                "n_tokens": int(off[-1]), "width": width}],
                                              schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()),
                                                                ("n_tokens", pa.int64()), ("width", pa.int32())]))

        out = tmp = None
        for part, i, data in rows():
            if part != held:
                if out is not None:
                    out.close()
                    yield whole(held, tmp)
                held, lens, ids = part, [], []
                tmp = f"{root}/{part:08d}.{uuid.uuid4().hex}.tmp"
                out = fs.open_output_stream(tmp)
            buf = data.as_buffer()
            out.write(buf)
            lens.append(buf.size)
            ids.append(i)
        if out is not None:
            out.close()
            yield whole(held, tmp)

    coded = src.mapInArrow(encode, "part int, id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_last(), "ids")
    files = cut(dealt.mapInArrow(store, _MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document from the mapped files;
    the checksum is of the ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, stem = _file_system(r["path"])
                local = isinstance(fs, pa.fs.LocalFileSystem)
                if local:
                    idx = np.memmap(f"{stem}.idx", np.uint8, "r")
                    ids = np.memmap(f"{stem}.bin", f"<u{r['width']}", "r")
                else:
                    idx = np.frombuffer(fs.open_input_file(f"{stem}.idx").readall(), np.uint8)
                    ids = np.frombuffer(fs.open_input_file(f"{stem}.bin").readall(), f"<u{r['width']}")
                n = int(idx[:8].view("<i8")[0])
                off = idx[8: 16 + 8 * n].view("<i8")
                key = idx[16 + 8 * n: 16 + 16 * n].view("<i8")
                null = idx[16 + 16 * n:].astype(bool)
                for at in range(0, n, 4096):
                    end = min(n, at + 4096)
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(off[at:end].tolist(), off[at + 1: end + 1].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(key[at:end]), mask=np.array(null[at:end])), pa.array(off[at:end] + r["base"]),
                         pa.array(np.diff(off[at: end + 1])), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(parallelism(manifest.sparkSession))
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
