"""Substring dedup by fixed-block anchors.

The index holds the hash of every non-overlapping block of ``ANCHOR`` words; every rolling window of that many words probes it.
A repeat of ``window`` >= 2 * ANCHOR - 1 words holds one whole block of its earlier copy, so no repeat escapes. A hit is extended
to every window around it; the extended windows are matched by their whole sequence, as a digest of 128 bits, with those of the
smallest document that holds it, and the matching ones, laid over each other, are the maximal exact repeats. Repeats within one
document's chunk go the same way.

Nothing travels per word. Documents are dealt by hash into chunks (an exchange that the plan reuses each time a chunk is read
again). A chunk sends each hash range one compressed sorted run of its distinct window hashes, and a range answers each chunk
with the hashes it needs, so a passage that a third of all documents share counts once per chunk:

    chunks --anchors--> ranges --shared anchors--> chunks --extended windows--> ranges --smallest document--> chunks

A task sends at most ``FAN`` runs. Where there are more ranges (or chunks), runs go to groups of them first, and a second exchange,
whose tasks merge what they get in bounded memory and flush large runs, takes them on: runs stay long at any size of input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Words, documents, pack, pack_plain, pieces, slices, string_bytes, text_bytes, unpack, unpack_plain, windows

WINDOW = 13
#: Text bytes of a chunk, and window hashes that a range holds at a time.
CHUNK_BYTES = 6 << 20
RANGE_KEYS = 2 << 20
#: Anchor hashes are cut to so many bits more than the number of words takes: a chance hit (one in 2^SPARE_BITS) only adds windows
#: that the second exchange rejects.
SPARE_BITS = 12
#: Runs that a task sends at most, and keys that the second step of a larger exchange holds before it flushes them.
FAN = 4096
HELD_KEYS = 4 << 20

#: A run: its range or chunk, number of keys, ascending keys, and per key (or absent) the rest of its digest, the smallest document,
#: the largest one less the smallest, and the chunk that it comes from or goes to.
_NAMES = ("key", "rest", "low", "more", "chunk")
_RUN = "dest int, n int, " + ", ".join(f"{c} binary" for c in _NAMES)
_RUN_ARROW = pa.schema([("dest", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in _NAMES])
_NEVER = np.iinfo(np.int64).max

Run = dict[str, np.ndarray]


def _hashed(table: pa.Table) -> Iterator[tuple[int, Words, tuple[np.ndarray, np.ndarray]]]:
    """For each slice of a chunk's rows: first row, words, both hashes of the words."""
    data, offsets = string_bytes(table.column("__text"))
    for a, b in slices(offsets):
        words = Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        yield a, words, words.digests()


def _doc_ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Identifier of each row as a source and as a target: a null one is never smaller, and never has a smaller one."""
    ids = table.column("__id").combine_chunks()
    null = np.asarray(ids.is_null())
    ids = np.asarray(ids.fill_null(0)).astype(np.int64)
    return np.where(null, _NEVER, ids), np.where(null, -_NEVER, ids)


def _packed(dest: np.ndarray, run: Run) -> pa.Table:
    """One row for each destination; ``dest`` ascends, and so do the keys of each."""
    cuts = np.append(np.flatnonzero(np.diff(dest, prepend=-1)), len(dest)).tolist()
    rows: list[list] = [[] for _ in _RUN_ARROW.names]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows[0].append(int(dest[a]))
        rows[1].append(b - a)
        rows[2].append(pack(run["key"][a:b]))
        for k, c in enumerate(_NAMES[1:], 3):
            rows[k].append(pack_plain(run[c][a:b].view(np.int64)) if c in run else b"")
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(rows, _RUN_ARROW.types, strict=True)], schema=_RUN_ARROW)


def _gathered(tables: list, names: tuple[str, ...]) -> Run:
    """The columns of all runs, one after the other."""
    parts: dict[str, list] = {c: [] for c in names}
    for table in tables:
        sizes = table.column("n").to_pylist()
        for c in names:
            parts[c] += [unpack(blob, n) if c == "key" else unpack_plain(blob, n) for n, blob in zip(sizes, table.column(c).to_pylist(), strict=True)]
    kinds = {"key": np.uint64, "rest": np.uint64}
    return {c: np.concatenate([np.zeros(0, kinds.get(c, np.int64)), *(x.view(kinds.get(c, np.int64)) for x in own)]) for c, own in parts.items()}


def _ordered(run: Run, *first: np.ndarray) -> tuple[np.ndarray, Run]:
    """By ``first`` (if given), key and rest."""
    order = np.lexsort(tuple(run[c] for c in ("rest", "key") if c in run) + first)
    return order, {c: v[order] for c, v in run.items()}


def _groups(run: Run) -> np.ndarray:
    """Start of each group of equal keys (and rests) in order."""
    n = len(run["key"])
    new = np.ones(n, bool)
    if n:
        np.not_equal(run["key"][1:], run["key"][:-1], out=new[1:])
        if "rest" in run:
            new[1:] |= run["rest"][1:] != run["rest"][:-1]
    return np.flatnonzero(new)


def _exchange(runs: DataFrame, n: int, names: tuple[str, ...], dest: Callable[[Run], np.ndarray]) -> DataFrame:
    """Runs by destination. Up to FAN destinations they are there already; beyond, runs of groups of them are merged and cut anew."""
    if n <= FAN:
        return runs

    def flush(held: list) -> pa.Table:
        run = _gathered(held, names)
        to = dest(run)
        order, run = _ordered(run, to)
        return _packed(to[order], run)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(batch.slice(i, 1))
                size += batch.column(1)[i].as_py()
                if size >= HELD_KEYS:
                    yield from flush(held).to_batches()
                    held, size = [], 0
        if held:
            yield from flush(held).to_batches()

    return runs.repartition(FAN, "dest").mapInArrow(merge, _RUN)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose sequence also starts in a document with a smaller id.

    Returns, for each row, its id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, on demand, the kept
    text. Windows are judged on the input. Null and empty texts have no words; rows with a null id lose nothing and take nothing
    from others; rows that repeat an id don't count as earlier than each other. Columns other than the two named are not read.
    """
    anchor = (window + 1) // 2
    total = text_bytes(df, text)
    n_chunks = pieces(total, CHUNK_BYTES, 32)
    n_pieces = pieces(total // 5, RANGE_KEYS, 16)
    bits = n_pieces.bit_length() - 1
    anchor_bits = min(62, max(32, bits + 8, SPARE_BITS + math.ceil(math.log2(total + 2))))
    cut, down = np.uint64(anchor_bits - bits), np.uint64(64 - anchor_bits)
    # groups of destinations for which a task makes a run
    each_piece, each_chunk = max(1, n_pieces // FAN), max(1, n_chunks // FAN)
    docs = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    # rows that repeat an id, and those without one, aren't together; any chunk will do for a row
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("__id", F.octet_length("__text"), F.spark_partition_id()), F.lit(n_chunks)).cast("int"))

    def piece_of_anchor(run: Run) -> np.ndarray:
        return (run["key"] >> np.uint64(2) >> cut).astype(np.int64)

    def piece_of_window(run: Run) -> np.ndarray:
        return (run["key"] >> np.uint64(64 - bits)).astype(np.int64)

    def chunk_of(run: Run) -> np.ndarray:
        return run["chunk"]

    def sent(run: Run, to: np.ndarray, each: int) -> pa.Table:
        order, run = _ordered(run, to // each)
        return _packed((to // each)[order], run)

    def named(table: pa.Table, n: int) -> np.ndarray:
        return np.full(n, int(table.column("chunk")[0].as_py()), np.int64)

    def anchors(table: pa.Table) -> pa.Table:
        keys = []
        for _, words, (h, _) in _hashed(table):
            a, whole = windows(h, words.doc, anchor)
            block = (np.arange(len(a)) - words.first[words.doc[:len(a)]]) % anchor == 0
            keys.append(((a >> down) << np.uint64(1) | block)[whole])
        keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        keys.sort()
        h = {"key": keys >> np.uint64(1)}
        at = _groups(h)
        if not len(at):
            return _RUN_ARROW.empty_table()
        block = np.maximum.reduceat(keys & np.uint64(1), at)
        many = (np.diff(at, append=len(keys)) > 1).astype(np.uint64)
        run = {"key": h["key"][at] << np.uint64(2) | many << np.uint64(1) | block, "chunk": named(table, len(at))}
        return sent(run, piece_of_anchor(run), each_piece)

    def shared(table: pa.Table) -> pa.Table:
        _, run = _ordered(_gathered([table], ("key", "chunk")))
        h = {"key": run["key"] >> np.uint64(2)}
        at = _groups(h)
        if not len(at):
            return _RUN_ARROW.empty_table()
        size = np.diff(at, append=len(h["key"]))
        flags = np.bitwise_or.reduceat(run["key"] & np.uint64(3), at)
        hit = np.repeat((flags & np.uint64(1) > 0) & ((size > 1) | (flags > np.uint64(1))), size)
        run = {"key": h["key"][hit], "chunk": run["chunk"][hit]}
        return sent(run, run["chunk"], each_chunk)

    def extended(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = np.unique(_gathered([right], ("key",))["key"])
        if not left.num_rows or not len(hits):
            return _RUN_ARROW.empty_table()
        source, target = _doc_ids(left)
        made: dict[str, list] = {c: [] for c in ("key", "rest", "low", "more")}
        for row, words, (h, g) in _hashed(left):
            a, _ = windows(h, words.doc, anchor)
            w, whole = windows(h, words.doc, window)
            if not len(w):
                continue
            at = np.searchsorted(hits, a >> down)
            found = hits[np.minimum(at, len(hits) - 1)] == a >> down
            reach = np.concatenate([[0], np.cumsum(found)])
            near = whole & (reach[anchor:anchor + len(w)] > reach[:len(w)])
            doc = row + words.doc[:len(w)][near]
            for c, v in zip(made, (w[near], windows(g, words.doc, window)[0][near], source[doc], target[doc]), strict=True):
                made[c].append(v)
        if not any(map(len, made["key"])):
            return _RUN_ARROW.empty_table()
        _, run = _ordered({c: np.concatenate(v) for c, v in made.items()})
        at = _groups(run)
        low, most = np.minimum.reduceat(run["low"], at), np.maximum.reduceat(run["more"], at)
        run = {"key": run["key"][at], "rest": run["rest"][at], "low": low, "more": most - low, "chunk": named(left, len(at))}
        return sent(run, piece_of_window(run), each_piece)

    def smallest(table: pa.Table) -> pa.Table:
        _, run = _ordered(_gathered([table], _NAMES))
        at = _groups(run)
        if not len(at):
            return _RUN_ARROW.empty_table()
        low = np.repeat(np.minimum.reduceat(run["low"], at), np.diff(at, append=len(run["key"])))
        later = low < run["low"] + run["more"]  # some document of the chunk has a smaller one
        run = {"key": run["key"][later], "rest": run["rest"][later], "low": low[later], "chunk": run["chunk"][later]}
        return sent(run, run["chunk"], each_chunk)

    out = pa.schema([("__id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text)

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        _, known = _ordered(_gathered([right], ("key", "rest", "low")))
        n_known = len(known["key"])
        heads = np.flatnonzero(np.diff(known["key"], prepend=known["key"][:1] + np.uint64(1))) if n_known else np.zeros(0, np.int64)
        deep = int(np.diff(heads, append=n_known).max(initial=0))  # rests of one key: 1 but by chance
        _, target = _doc_ids(left)
        made = []
        for row, words, (h, g) in _hashed(left):
            w, whole = windows(h, words.doc, window)
            begin = np.flatnonzero(whole)
            repeat = np.zeros(len(begin), bool)
            if n_known and len(begin):
                at = np.searchsorted(known["key"], w[begin])
                maybe = np.flatnonzero(known["key"][np.minimum(at, n_known - 1)] == w[begin])
                rest = windows(g, words.doc, window)[0][begin[maybe]]
                own = target[row + words.doc[begin[maybe]]]
                for step in range(deep):
                    i = np.minimum(at[maybe] + step, n_known - 1)
                    repeat[maybe] |= (known["key"][i] == w[begin[maybe]]) & (known["rest"][i] == rest) & (known["low"][i] < own)
            begin = begin[repeat]
            cover = np.zeros(len(words) + 1, np.int32)
            cover[begin] += 1
            cover[begin + window] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            data, offsets = words.kept(keep)
            counts = np.concatenate([[0], np.cumsum(~keep)])[words.first]
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            made.append(pa.Table.from_arrays(
                [left.column("__id").combine_chunks()[row:row + len(texts)], pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(counts), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                + [pa.array(texts, pa.binary()).cast(pa.string())] * keep_text, schema=out))
        return pa.concat_tables(made) if made else out.empty_table()

    chunked = lambda: docs.groupBy("chunk")
    by = lambda runs, n, names, dest: _exchange(runs, n, names, dest).groupBy("dest")
    first = by(chunked().applyInArrow(anchors, _RUN), n_pieces, ("key", "chunk"), piece_of_anchor).applyInArrow(shared, _RUN)
    second = chunked().cogroup(by(first, n_chunks, ("key", "chunk"), chunk_of)).applyInArrow(extended, _RUN)
    third = by(second, n_pieces, _NAMES, piece_of_window).applyInArrow(smallest, _RUN)
    schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType())] * keep_text)
    return chunked().cogroup(by(third, n_chunks, ("key", "rest", "low", "chunk"), chunk_of)).applyInArrow(cut_out, schema).withColumnRenamed("__id", doc_id)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), keep_text=False)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
     s AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER n AS seq, count(*) OVER n = 13 AS whole FROM w WINDOW n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
     f AS (SELECT doc_id, i, word, whole AND min(CASE WHEN whole THEN doc_id END) OVER (PARTITION BY seq) < doc_id AS again FROM s),
     c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
     a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
