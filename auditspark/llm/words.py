"""Words of Arrow text columns as numpy arrays, without an object for each word."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 4 << 20  # bytes of text that are taken apart at a time
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: word characters after ASCII lower-casing: digits, a to z and every byte of a character beyond ASCII
ALNUM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
NOT_SPACE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text (a longer text is alone)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, row) of maximal runs of member bytes within the rows."""
    m = np.zeros(len(data) + 1, bool)
    m[:-1] = member[data]
    edge = np.empty(len(m), bool)
    edge[0] = m[0]
    np.not_equal(m[1:], m[:-1], out=edge[1:])
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    inner = cuts[m[cuts] & m[cuts - 1]]  # rows that meet inside a run
    at = np.flatnonzero(edge)
    if len(inner):
        at = np.sort(np.concatenate([at, inner, inner]))
    starts, ends = at[::2], at[1::2]
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends - starts, np.repeat(np.arange(len(offsets) - 1), counts)


def _words64(data: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings at the spans."""
    u = _words64(data)
    h = mix(lens.astype(np.uint64) + np.uint64(seed * 0x9E3779B1 + 1))
    live = np.arange(len(starts))
    k = 0
    while len(live):
        left = lens[live] - k
        live = live[left > 0]
        if not len(live):
            break
        part = u[starts[live] + k] & _KEEP[np.minimum(lens[live] - k, 8)]
        h[live] = mix((h[live] ^ part) * _M2 + np.uint64(0x9E3779B97F4A7C15))
        k += 8
    return h


def prefix_hashes(data: np.ndarray, starts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of the first ``k`` <= 8 bytes at ``starts``."""
    return mix((_words64(data)[starts] & _KEEP[k]) * _M1 + np.uint64(seed * 31 + k))
