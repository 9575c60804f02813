"""SentencePiece encoding with byte offsets, and decoding.

A text is normalised through the model's compiled character map (a double-array
trie over UTF-8): at every place the longest key is replaced, and an array keeps,
for every normalised byte, the source byte that it came from. The normalised text
is segmented by the library's model with its own normaliser switched off, and every
piece is projected through the array to the bytes of the original text.

Everything is map-only: a text is encoded where it lies. Nulls are empty texts,
an empty text has only the begin and end ids; bytes that are not UTF-8 become
U+FFFD one by one, as in the library. Repeated rows and ids are encoded row by row;
other columns are not read, so their names cannot clash.
"""
from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces as slices

SPACE = "▁"


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("piece_bytes", _each_byte)


class CharMap:
    """The compiled character map of a model: longest-prefix replacement."""

    def __init__(self, blob: bytes, symbols: list[str]):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.trie = memoryview(blob[4: 4 + size]).cast("I") if blob else None
        self.out = blob[4 + size:]
        self.symbols = sorted((s.encode() for s in symbols), key=len, reverse=True)
        self.plain: dict[str, bool] = {}

    def _walk(self, data: bytes, at: int, end: int) -> tuple[int, int, bool]:
        """(length, value) of the longest key at ``at``; whether a longer one could follow after ``end``."""
        trie = self.trie
        length = value = 0
        unit = trie[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, end):
            byte = data[i]
            node ^= byte
            if node >= len(trie):
                return length, value, False
            unit = trie[node]
            if unit & 0x800000FF != byte:
                return length, value, False
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                length, value = i + 1 - at, trie[node] & 0x7FFFFFFF
        return length, value, True

    def is_plain(self, char: str) -> bool:
        """Whether no key and no symbol begins with ``char``."""
        known = self.plain.get(char)
        if known is None:
            b = char.encode()
            known = not any(s.startswith(b) for s in self.symbols)
            if known and self.trie is not None:
                length, _, more = self._walk(b, 0, len(b))
                known = not length and not more
            self.plain[char] = known
        return known

    def at(self, data: bytes, place: int) -> tuple[int, bytes]:
        """(source bytes, replacement) at a place of valid UTF-8."""
        for s in self.symbols:
            if data.startswith(s, place):
                return len(s), s
        if self.trie is not None:
            length, value, _ = self._walk(data, place, len(data))
            if length:
                return length, self.out[value: self.out.index(b"\0", value)]
        lead = data[place]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[place: place + n]


class Encoder:
    """One model; ``encode`` gives ids and the source bytes of every piece."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = m.trainer_spec.treat_whitespace_as_suffix
        self.space = SPACE if self.escape else " "
        self.map = CharMap(spec.precompiled_charsmap, [p.piece for p in m.pieces if p.type == 4])
        self.bytes_too = m.trainer_spec.byte_fallback
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        self.is_byte = np.array([p.type == 6 for p in m.pieces])
        self.lens = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in m.pieces], np.int32)
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.parts = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())

    def normalise(self, raw: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes (one more for the end)."""
        try:
            text, data, source, broken = raw.decode(), raw, None, frozenset()
        except UnicodeDecodeError:
            text = raw.decode(errors="piece_bytes")
            data = text.encode()
            source, broken = _sources(raw, text)
        special = {c for c in set(text) if not self.map.is_plain(c)}
        if self.squeeze:
            special.add(" ")
        if special:
            out, at = self._replaced(text, data, special, broken)
        else:
            out, at = text, np.arange(len(data) + 1, dtype=np.int32)
        if self.squeeze and out:  # a written space mark at the end goes too
            kept = len(out.rstrip(f" {SPACE}" if self.escape else " ").encode())
            out, at = out.encode()[:kept].decode(), at[: kept + 1]
            if not out and self.suffix and self.prefix:
                return self.space, np.append(np.full(len(self.space.encode()), at[0]), at)
        if not out:
            return "", at[-1:]
        if source is not None:
            at = source[at]
        if self.escape and " " in out:
            times = np.ones(len(at), np.int8)
            times[:-1][np.frombuffer(data if out is text else out.encode(), np.uint8) == 32] = 3
            at = np.repeat(at, times)
            out = out.replace(" ", SPACE)
        if self.prefix:
            n = len(self.space.encode())
            if self.suffix:
                out, at = out + self.space, np.append(at, np.full(n, at[-1]))
            else:
                out, at = self.space + out, np.append(np.full(n, at[0]), at)
        return out, at

    def _replaced(self, text: str, data: bytes, special: set[str], broken: set[int]) -> tuple[str, np.ndarray]:
        stops = re.compile("[" + "".join(map(re.escape, special)) + "]")
        parts: list[bytes] = []
        at: list[np.ndarray] = []
        blank = self.squeeze  # whether what stands before ends in a space
        char = place = 0  # the same place in text and in its bytes
        while char < len(text):
            hit = stops.search(text, char)
            stop = hit.start() if hit else len(text)
            if stop > char:
                run = text[char:stop].encode()
                parts.append(run)
                at.append(np.arange(place, place + len(run)))
                place += len(run)
                char, blank = stop, False
                continue
            n, new = self.map.at(data, place) if place not in broken else (3, data[place: place + 3])  # the map is for what was written
            if blank:
                new = new.lstrip(b" ")
            if new:
                parts.append(new)
                at.append(np.full(len(new), place))
                blank = self.squeeze and new.endswith(b" ")
            char += len(data[place: place + n].decode())
            place += n
        out = b"".join(parts)
        where = np.concatenate([*at, [place]]).astype(np.int64) if at else np.array([place])
        return out.decode(), where

    def encode(self, raw: bytes | None, bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): each piece and the bytes of the original text that it stands for."""
        raw = raw or b""
        text, at = self.normalise(raw)
        ids = np.array(self.parts.encode(text, num_threads=1), np.uint32)
        # the lengths of the pieces follow from their ids, but for runs of unknown characters
        lens = self.lens[ids] if self.bytes_too else np.array([len(p.encode()) for p in self.parts.encode(text, out_type=str)], np.int32)
        stop = np.cumsum(lens, dtype=np.int32)
        start = stop - lens
        begins, ends = at[start], at[stop]
        self._whole_characters(text, at, np.flatnonzero(self.is_byte[ids]), start, begins, ends)
        if bos:
            ids, begins, ends = np.append(np.uint32(self.bos), ids), np.append(0, begins), np.append(0, ends)
        if eos:
            ids, begins, ends = np.append(ids, np.uint32(self.eos)), np.append(begins, len(raw)), np.append(ends, len(raw))
        return ids.astype("<u4"), begins.astype(np.int64), ends.astype(np.int64)

    @staticmethod
    def _whole_characters(text: str, at: np.ndarray, single: np.ndarray, start: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Of the pieces for a character's bytes, the last one stands for all of it."""
        if not len(single):
            return
        b = np.frombuffer(text.encode(), np.uint8)
        single = single[b[start[single]] >= 0x80]
        head = start[single]
        for _ in range(3):
            head = head - ((b[head] & 0xC0) == 0x80)
        begins[single] = at[head]
        after = np.minimum(start[single] + 1, len(b) - 1)
        more = ((b[after] & 0xC0) == 0x80) & (after > start[single])
        ends[single[more]] = begins[single[more]]

    def decode(self, ids: np.ndarray) -> str:
        return self.lib.decode(ids.tolist())


def _sources(raw: bytes, text: str) -> tuple[np.ndarray, set[int]]:
    """For each byte of the repaired text, the byte of ``raw`` that it came from; the places of repaired bytes."""
    out, place, broken = [], 0, set()
    for c in text:
        b = c.encode()
        n = len(b) if raw.startswith(b, place) else 1
        if n < len(b):
            broken.add(len(out))
        out += [place] * len(b) if n < len(b) else range(place, place + n)
        place += n
    return np.array([*out, place], np.int64), broken


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder of a model, which its later tasks use again."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _model(path: str) -> bytes:
    """The model file (some 100 kB to a few MB), sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    for batch in batches:
        for part in slices(batch, 1):
            yield part.column(0), part.column(1).to_pylist()


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           bos: bool = True, eos: bool = True) -> DataFrame:
    """(id, ids, begins, ends) of every text: a piece ``ids[i]`` stands for the bytes
    ``begins[i]`` to ``ends[i]`` of the original text in UTF-8."""
    model, rows = _model(model_path), _input(docs, id_col, text_col)

    def run(batches):
        enc = encoder(model)
        for ids, texts in _rows(batches):
            found = [enc.encode(t, bos, eos) for t in texts]
            cols = [pa.array([f[k].astype(np.int64) for f in found], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([ids, *cols], ["id", "ids", "begins", "ends"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<long>, begins array<long>, ends array<long>")


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """(id, text) of rows (id, ids); a null list is an empty one."""
    model, rows = _model(model_path), tokens.select("id", F.col("ids").cast("array<long>").alias("ids"))

    def run(batches):
        enc = encoder(model)
        for b in batches:
            text = [enc.lib.decode([i for i in ids or [] if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text encoded with begin and end ids, and decoded, as (id, n_tokens,
    ids_sha256, decoded_sha256, spans_sha256): the ids, and the begins and ends in
    turn, hashed as little-endian unsigned integers of 32 and 64 bits. One pass
    without the arrays leaving the task."""
    model, rows = _model(model_path), _input(docs, id_col, text_col)

    def run(batches):
        enc = encoder(model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for ids, texts in _rows(batches):
            n, a, b, c = [], [], [], []
            for t in texts:
                found, begins, ends = enc.encode(t)
                n.append(len(found))
                a.append(sha(found.tobytes()))
                b.append(sha(enc.decode(found).encode()))
                c.append(sha(np.stack([begins, ends], 1).astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (a, b, c))],
                                             ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
