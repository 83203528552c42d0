"""Vectorised text kernels over Arrow string columns, shared by the Arrow-based operators.

Everything works on the UTF-8 bytes of a whole batch at once: no per-word Python objects are made. A *word* is a maximal run of
bytes other than ``[\\x20\\x09-\\x0D]``; that set is ASCII, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are expanded into arrays at a time; a longer single document is taken whole.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Words of up to this many bytes are told apart exactly before they are hashed; longer ones by 120 bits of XXH3.
SHORT_WORD = 15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) that together hold all rows, each of at most limit bytes or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Word boundaries of some rows: starts, ends (byte positions), doc (row of each word).

    With ``single`` each character of a script that is written without spaces is a word: U+0E00 to U+0EFF, U+3000 to U+9FFF.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, single: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        inner = ~_SPACE[data]
        first = np.ones(n, dtype=bool)
        last = np.ones(n, dtype=bool)
        if n:
            np.logical_not(inner[:-1], out=first[1:])
            np.logical_not(inner[1:], out=last[:-1])
            full = offsets[:-1] < offsets[1:]
            first[offsets[:-1][full]] = True
            last[offsets[1:][full] - 1] = True
            if single and (high := np.flatnonzero(data >= 0xE0)).size:
                lead = data[high]
                lead = high[(lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xE0) & (data[np.minimum(high + 1, n - 1)] >= 0xB8) & (data[np.minimum(high + 1, n - 1)] <= 0xBB)]
                first[lead] = last[lead + 2] = True
                last[lead[lead > 0] - 1] = True
                first[(lead + 3)[lead + 3 < n]] = True
        self.starts = np.flatnonzero(inner & first)
        self.ends = np.flatnonzero(inner & last) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        #: index of the first word of each row, and one past the last row
        self.first = np.searchsorted(self.starts, offsets, "left")

    def __len__(self) -> int:
        return len(self.starts)

    def _halves(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for each word: its bytes and their number, or a digest of a long word."""
        n = len(self.data)
        padded = np.zeros(n + 16, np.uint8)
        padded[:n] = LOWER[self.data] if lower else self.data
        eight = np.ndarray(n + 9, "<u8", padded, 0, (1,))  # the eight bytes from each byte on
        size = self.ends - self.starts
        low = eight[self.starts] & _MASK[np.minimum(size, 8)]
        high = eight[self.starts + np.minimum(size, 8)] & _MASK[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        for i in np.flatnonzero(size > SHORT_WORD).tolist():
            d = xxhash.xxh3_128_intdigest(padded[self.starts[i]:self.ends[i]])
            low[i], high[i] = d & (1 << 64) - 1, d >> 64 | 0xFF << 56
        return low, high

    def digests(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word's bytes (A-Z lower-cased on demand)."""
        low, high = self._halves(lower)
        return (mix64(mix64(low + np.uint64(0x9E3779B97F4A7C15)) ^ high * np.uint64(0xD6E8FEB86659FD93)),
                mix64(mix64(high + np.uint64(0xC2B2AE3D27D4EB4F)) ^ low * np.uint64(0xFF51AFD7ED558CCD)))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """The first of them."""
        return self.digests(lower)[0]

    def kept(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and row offsets of each row's kept words, joined by one space."""
        n = len(self.data)
        delta = np.zeros(n + 2, dtype=np.int8)
        s, e, d = self.starts[keep], self.ends[keep], self.doc[keep]
        delta[s] += 1
        delta[e] -= 1
        mask = np.cumsum(delta[:n], dtype=np.int8).astype(bool)
        out = self.data.copy()
        if len(s) > 1:
            gap = e[:-1][d[:-1] == d[1:]]
            mask[gap] = True
            out[gap] = 0x20
        total = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return out[mask], total[self.offsets]


def _sequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of what a and b stand for, one after the other."""
    return mix64(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB))


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` consecutive word hashes, and whether the run stays within one row.

    Runs are put together from runs of powers of two, mixed at each step: a sum of multiples would let regular word orders collide.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    power, length, at, out = words, 1, 0, None
    while length <= size:
        if size & length:
            out = power[at:at + n] if out is None else _sequence(out, power[at:at + n])
            at += length
        if 2 * length <= size:
            power = _sequence(power[:-length], power[length:])
        length *= 2
    return out, doc[:n] == doc[size - 1:]


def pack(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, as differences laid out by byte and compressed."""
    d = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) if len(d) else b""


def unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    """Any 64-bit integers, laid out by byte and compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack_plain(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").ravel()


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of text in all rows: one pass that only adds up lengths."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def pieces(total: int, each: int, least: int) -> int:
    """A power of two of pieces so that each gets about ``each`` units."""
    return max(least, 1 << max(0, math.ceil(math.log2(max(1, total / each)))))


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the identifier as text, modulo m: the fixed folds; a null identifier is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(m)), F.lit(0))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder that the session names, cutting its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark) -> None:
    """Let Spark delete the shuffle files of frames that are no longer there; it finds them when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark) -> str:
    """The folder that driver and executors share: what the session names, or one of this machine where it names none (tests)."""
    context = spark.sparkContext
    return spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or f"file:///tmp/checkpoints/{context.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: for wide rows, which a checkpoint would keep uncompressed."""
    df.write.parquet(place := f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(place)


def lean(run):
    """A function of Arrow batches that gives freed memory back when it ends: workers live on for other tasks."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return held


#: Rows and bytes of an Arrow batch at most: texts are long, some very long, and a batch is held by the JVM and by Python.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the corpus; the session's Arrow batches are cut to BATCH_ROWS rows and, unless it says otherwise, to BATCH_BYTES."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if _BYTES not in spark.conf.getAll:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
