"""Global counts of 64-bit keys that blocks of rows ask for: keys travel packed by ranges, counts come back in the order of the keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagetrail.llm.common import in_groups

ASKED = "block long, kind int, part long, m int, keys binary, counts binary"
ANSWERED = "block long, kind int, part long, m int, totals binary, seen long"
#: Keys that one range is to hold, with those that several blocks ask for.
RANGE = 2_000_000

# Words are hashed as sums of a random number for each byte times a power of an odd number.
_ODD = np.uint64(0x9E3779B97F4A7C17)
_LOW = 1 << 12


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_table() -> np.ndarray:
    """A number for each byte: A-Z as a-z, white space (0x20, 0x09-0x0D) zero."""
    codes = np.arange(256)
    codes[65:91] += 32
    out = mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    out[[32, *range(9, 14)]] = 0
    return out


_NUMBER = _bytes_table()
_SPACE = _NUMBER == 0
_POWERS = np.cumprod(np.full(_LOW, _ODD))


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space of every text, A-Z as a-z, and how many each text has; null has none. Works on the bytes at once, no word becomes a Python object."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if at[-1] == at[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # before a text's first byte
    edge[at] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, at))
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(starts, starts[i] + (1 << 15))), i + 1)
        part = data[starts[i] : ends[j - 1]]
        rel = starts[i:j] - starts[i]
        place = np.arange(len(part)) - np.repeat(rel, np.diff(np.append(rel, len(part))))
        value = _NUMBER[part] * _POWERS[place & (_LOW - 1)]
        if int((ends[i:j] - starts[i:j]).max()) > _LOW:
            value *= mixed((place >> 12).astype(np.uint64)) | np.uint64(1)
        out[i:j] = np.add.reduceat(value, rel)
        i = j
    return mixed(out + (ends - starts).astype(np.uint64)), counts


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers in few bytes: their bytes by place, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(-1) if n else np.zeros(0, np.uint64)


def ask(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, parts: int):
    """Yields rows of ASKED for sorted distinct keys below 2**bits: one for each of `parts` equal ranges of them that has any."""
    width = -(-(1 << bits) // parts)
    cuts = np.searchsorted(keys, np.array([min(k * width, (1 << 64) - 1) for k in range(1, parts)], np.uint64)) if parts > 1 else np.zeros(0, np.int64)
    edges = [0, *cuts.tolist(), len(keys)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            steps = np.diff(keys[a:b], prepend=np.uint64(0))
            yield block, kind, k, b - a, squeeze(steps), squeeze(counts[a:b])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "kind", "part", "m", "keys", "counts"])


def tally(asked: DataFrame) -> DataFrame:
    """ASKED to ANSWERED: the sums of a key's counts over all blocks, in the order in which the block asked.

    Rows of one (kind, range) meet in one group, which holds about RANGE keys if the ranges were chosen so; a block asks
    for a key once, so a key that every block holds has no more rows than there are blocks. seen, in one row of a
    group, is the number of its different keys whose sum isn't 0; in the others 0.
    """

    def add(group: pa.Table) -> pa.Table:
        sizes = group.column("m").to_pylist()
        keys = np.concatenate([np.cumsum(unsqueeze(k, m), dtype=np.uint64) for k, m in zip(group.column("keys").to_pylist(), sizes)])
        counts = np.concatenate([unsqueeze(c, m) for c, m in zip(group.column("counts").to_pylist(), sizes)])
        order = np.argsort(keys)
        new = np.append(True, np.diff(keys[order]) != 0)
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(new) - 1
        totals = np.add.reduceat(counts[order], np.flatnonzero(new))
        answers = np.split(totals[of], np.cumsum(sizes)[:-1])
        seen = [int((totals > 0).sum()), *[0] * (len(sizes) - 1)]
        columns = {c: group.column(c) for c in ("block", "kind", "part", "m")}
        return pa.table(columns | {"totals": pa.array([squeeze(a) for a in answers], pa.binary()), "seen": pa.array(seen, pa.int64())})

    return in_groups(asked.groupBy("kind", "part"), add, ANSWERED)


def totals_of(rows: pa.Table, kind: int) -> np.ndarray:
    """A block's totals of a kind, in the order of its sorted keys, from its rows of ANSWERED."""
    picked = sorted((p, m, t) for k, p, m, t in zip(*(rows.column(c).to_pylist() for c in ("kind", "part", "m", "totals"))) if k == kind)
    return np.concatenate([np.zeros(0, np.uint64), *(unsqueeze(t, m) for _, m, t in picked)])
