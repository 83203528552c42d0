"""Exact dedup with a log-structured merge index of text digests.

A task fills a memtable (digest -> smallest identifier, rows); when it is full it is flushed as sorted runs, one per digest range,
each with a Bloom filter over its digests. Compaction of a range goes level by level: ``FAN_IN`` runs at a time become one, keeping
the smallest identifier, until no more than that are left; of those, a digest that no other run's filter admits is settled at once,
and only the others are merged. Only digests with more than one row leave the index. Every entry is merged once a level, so the work
is in proportion to the entries times the logarithm of the runs.

A row whose digest is in the index is a hit, and hits are verified: the normalised bytes of all rows of a digest are compared, and
where they differ (a digest collision) rows are grouped by their bytes instead. Each task sends the least and the greatest text of a
digest, which are equal if and only if all are, so a text that many rows share travels once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import checkpointed, documents, pieces

MEMTABLE_ROWS = 500_000
RANGE_ROWS = 1 << 20
#: Runs that are merged into one at a time.
FAN_IN = 8
#: Digests of the index that are broadcast at most (32 bytes each) to find the hits; more are joined by a shuffle.
BROADCAST_DIGESTS = 1 << 17
FILTER_BITS = 12
FILTER_HASHES = 4
_NONE = np.iinfo(np.int64).max

_RUN = "piece int, n int, digests binary, ids binary, counts binary, filter binary"
_RUN_ARROW = pa.schema([("piece", pa.int32()), ("n", pa.int32()), ("digests", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary())])
_INDEX_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normalised(text: str | Column) -> Column:
    """Each run of white space as one space; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _bits(digests: np.ndarray, m: int) -> np.ndarray:
    """Filter positions of 32-byte digests, one row each: double hashing with two of their words."""
    w = digests.view("<u8")
    return (w[:, 1:2] + np.arange(FILTER_HASHES, dtype=np.uint64) * (w[:, 2:3] | np.uint64(1))) % np.uint64(m)


def _filter(digests: np.ndarray) -> bytes:
    bits = np.zeros(8 * (len(digests) * FILTER_BITS // 8 + 8), bool)
    bits[_bits(digests, len(bits))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _admits(filter: bytes, digests: np.ndarray) -> np.ndarray:
    at = _bits(digests, 8 * len(filter))
    raw = np.frombuffer(filter, np.uint8)
    return ((raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _merged(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by digest; equal digests become one entry with the smallest identifier and all rows."""
    if not len(digests):
        return digests, ids, counts
    keys = np.ascontiguousarray(digests).view([("", ">u8")] * 4).ravel()
    order = np.argsort(keys, kind="stable")
    digests, ids, counts, keys = digests[order], ids[order], counts[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return digests[at], np.minimum.reduceat(ids, at), np.add.reduceat(counts, at)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def duplicate_index(digests: DataFrame, total: int) -> DataFrame:
    """From (digest binary(32), id): the digests with several rows, their smallest identifier and number of rows."""
    n_pieces = pieces(total, RANGE_ROWS, 16)
    shift = 32 - (n_pieces.bit_length() - 1)

    def flush(held: list) -> pa.RecordBatch:
        digests, ids, counts = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
        top = digests[:, :4].copy().view(">u4").ravel().astype(np.int64) >> shift
        cuts = np.searchsorted(top, np.arange(n_pieces + 1))
        rows = [(p, int(b - a), digests[a:b].tobytes(), ids[a:b].tobytes(), counts[a:b].tobytes(), _filter(digests[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _RUN_ARROW.types, strict=True)], schema=_RUN_ARROW)

    def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((_digests(batch.column(0)), np.asarray(batch.column(1).fill_null(_NONE)), np.ones(batch.num_rows, np.int64)))
            n += batch.num_rows
            if n >= MEMTABLE_ROWS:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    def compact(table: pa.Table) -> pa.Table:
        runs = []
        for batch in table.select(_RUN_ARROW.names[1:]).to_batches():
            for n, d, i, c, f in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                runs.append((np.frombuffer(d, np.uint8).reshape(n, 32), np.frombuffer(i, np.int64), np.frombuffer(c, np.int64), f))
        while len(runs) > FAN_IN:
            merged = [_merged(*(np.concatenate(x) for x in zip(*(r[:3] for r in runs[k:k + FAN_IN]), strict=True))) for k in range(0, len(runs), FAN_IN)]
            last = len(merged) <= FAN_IN
            runs = [(*r, _filter(r[0]) if last else b"") for r in merged]
        rest = []
        for k, (d, i, c, _) in enumerate(runs):
            open_ = c > 1
            for j, run in enumerate(runs):
                if j != k and not open_.all():
                    left = np.flatnonzero(~open_)
                    open_[left] = _admits(run[3], d[left])
            rest.append((d[open_], i[open_], c[open_]))
        d, i, c = _merged(*(np.concatenate(x) for x in zip(*rest, strict=True)))
        d, i, c = d[c > 1], i[c > 1], c[c > 1]
        return pa.Table.from_arrays([pa.array([x.tobytes() for x in d], pa.binary()), pa.array(i, pa.int64(), mask=i == _NONE), pa.array(c, pa.int64())], schema=_INDEX_ARROW)

    return digests.select("digest", "id").mapInArrow(memtables, _RUN).groupBy("piece").applyInArrow(compact, "digest binary, keep_id long, group_size long")


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=lambda norm: F.sha2(norm, 256)) -> DataFrame:
    """One row per row of df: its id, keep_id, group_size, kept and text_sha256 (of the normalised text).

    Texts are equal when their normalised bytes are; the smallest id of a group stays. Null texts count as empty and form one
    group with the empty ones. Rows that repeat an id and a text are copies of the same row: each counts in group_size and is kept
    if it carries the smallest id. Null ids never stay while another id of the group is there; a group of null ids has keep_id
    null and is kept. ``digest`` maps the normalised text to 64 hexadecimal digits. Columns other than the two named are not read.
    """
    norm = normalised(text)
    rows = checkpointed(df.select(F.col(doc_id).cast("long").alias("id"), F.unhex(digest(norm)).alias("digest"), F.sha2(norm, 256).alias("text_sha256")))
    index = checkpointed(duplicate_index(rows, rows.count()))
    n = index.count()
    sent = F.broadcast if n <= BROADCAST_DIGESTS else lambda x: x
    result = rows.join(sent(index), "digest", "left").select("id", "digest", "text_sha256", "keep_id", "group_size")

    # the bytes of all rows of a digest, whatever their identifiers
    texts = df.select(F.col(doc_id).cast("long").alias("id"), norm.alias("norm"), F.unhex(digest(norm)).alias("digest"))
    hits = texts.join(sent(index.select("digest")), "digest", "left_semi")
    # by another key than a shuffled join has, so that Spark may split the join where many rows share a digest
    ends = hits.groupBy(F.hex("digest").alias("hex")).agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    bad = checkpointed(ends.where("least <> greatest").select(F.unhex("hex").alias("digest")))
    if not bad.isEmpty():  # collisions: these digests are grouped by their bytes
        again = texts.withColumn("text_sha256", F.sha2("norm", 256)).join(bad, "digest", "left_semi")
        groups = again.groupBy("norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = again.join(groups, "norm").select("id", "digest", "text_sha256", "keep_id", "group_size")
        result = result.join(bad, "digest", "left_anti").unionByName(again)
    return result.select(
        F.col("id").alias(doc_id),
        F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size") > 1, F.col("id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
