"""Vectorised text kernels: Arrow batches as one byte buffer, words, hashes, shingles and winnowing.

A batch of texts is held as one uint8 buffer with document offsets, in chunks of a few MB, so that a
task's memory doesn't depend on the batch's size; a text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

# Freed batches go back to the system instead of a pool of the worker process.
pa.set_memory_pool(pa.system_memory_pool())

CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch that Spark hands to a task.
BATCH_BYTES = 4 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Spans of up to so many bytes are hashed together, 8 bytes a step; longer ones one by one.
LONGEST = 64
_GOLDEN = U(0x9E3779B97F4A7C15)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of byte spans: every 8 bytes go through a full mix that depends on those before.

    Spans of up to 8 bytes and equal length never collide. Where equality decides a result, callers
    compare the real bytes as well.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(U) * _GOLDEN + U(seed))
    if not len(starts):
        return out
    lanes = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).data, strides=(1,))
    live = np.flatnonzero(size <= LONGEST)
    at, left = starts[live], size[live]
    while True:
        own = np.flatnonzero(left > 0)
        if not len(own):
            break
        live, at, left = live[own], at[own], left[own]
        lane = lanes[at]
        short = left < 8
        lane[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        out[live] = mix((out[live] ^ lane) * _GOLDEN + U(1))
        at, left = at + 8, left - 8
    for i in np.flatnonzero(size > LONGEST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return out


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


class Roller:
    """Polynomial hash modulo 2^64 of spans of 64-bit values, for finding candidates only.

    Long periodic spans can collide, so equal hashes are never taken for equal spans.
    """

    def __init__(self, seed: int):
        self.values = _table(seed)
        self.base = int(mix(np.array([seed + 77], U))[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U))
        return self.up, self.down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[starts:ends], from their prefix sums."""
        _, down = self._powers(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U))


@dataclass
class Chunk:
    """Texts of rows first..first+n of a record batch; offs has n + 1 byte offsets into buf."""

    first: int
    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's texts (nulls as empty ones), in chunks of at most `most` bytes or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield Chunk(i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session, so that long texts don't make large ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def numbered(df: DataFrame) -> DataFrame:
    """The DataFrame with columns c0, c1 and so on, so that no name of the caller's, of whatever kind, meets one of an operator's."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Word characters as UTF-8 bytes: all but ASCII white space; or ASCII letters and digits and all beyond ASCII. Fixed values.
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): byte spans of all words, and how many each text has. Words end at their text's end."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = table[buf]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def single_spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends): the words with one blank after each and nothing else."""
    size = ends - starts + 1
    to = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(to[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[to[1:] - 1] = False
    step = np.zeros(len(buf) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    out[inside] = buf[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    return out, to[:-1], to[1:] - 1


def bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def grams(roller: Roller, values: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): all k-grams that lie within one text, by the index of their first value."""
    n = len(values)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.arange(n - k + 1)
    left = np.repeat(bounds(counts)[1:], counts) - np.arange(n)
    at = at[left[: n - k + 1] >= k]
    return roller.spans(roller.prefix(values), at, at + k), at


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w consecutive hashes, the index of its least one (the last on ties).

    Hashes are compared by their upper 43 bits; the window minimum comes from block-wise running
    minima (two passes, whatever w is).
    """
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    if n > 1 << 20:  # in parts that overlap by w - 1
        step = (1 << 20) - w + 1
        return np.concatenate([window_argmin(h[i : i + (1 << 20)], w) + i for i in range(0, n - w + 1, step)])[: n - w + 1]
    low = U((1 << 21) - 1)
    size = -(-n // w) * w
    key = np.full(size, ~U(0), U)
    key[:n] = (h & ~low) | (low - np.arange(n, dtype=U))
    rows = key.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (low - (least & low)).astype(np.int64)
