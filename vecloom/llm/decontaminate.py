"""Benchmark decontamination: edit-distance search for benchmark items in documents.

A document leaks an item of n words if one of its item-sized windows (n consecutive words, or what is left at its end) is within
``(1 - similarity) * n`` word edits of the item. The CGK random walk embeds windows and items so that edit distance becomes Hamming
distance: each step writes the current word and moves on or stays, as a random function of walk, step and word says; after an edit
two walks meet again by chance and then write the same words. Every repetition walks anew, from the front or from the back in turn,
and samples one step of the embedding as its LSH key; windows that have the key of an item are verified by their edit distance.

Steps are sampled before the words run out, and the repetitions of a length are as many as it takes to find all pairs of a simulation
at the largest distance allowed (spread, moved, and in one block at the front or in the middle), and as many again.

Before the walks, pairs of window and item that share too few word q-grams to be within the distance are left out; by the q-gram
lemma that loses nothing. Neighbouring windows differ by two edits at most, so a window that is far off rules out those around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, documents, lean, mix64, pieces, slices, string_bytes, text_bytes, windows

SIMILARITY = 0.8
#: Text bytes of the items that are sent to the tasks at a time; a larger benchmark is searched in blocks.
BLOCK_BYTES = 16 << 20
#: Text bytes that are searched at a time: each item length costs a few calls per slice, so larger ones are cheaper.
SEARCH_BYTES = 2 << 20
#: Words of windows that are embedded or compared at a time, and pairs of q-gram and item that are looked through at a time.
COMPARED_WORDS = 1 << 20
EXPANDED = 1 << 20
#: Steps of a walk that are sampled, in words of the item: walks run out of words after two steps a word on average.
SAMPLED_STEPS = 1.6
#: Simulated pairs of each kind, and repetitions at most that the simulation tries.
SIMULATED = 60
MOST_REPEATS = 240

_OUT = "__id long, item_id long, distance int, start_word long, n_words int"


def edits_allowed(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def _qgram(n: int, k: int) -> tuple[int, int]:
    """Largest q (at most 3) for which the lemma asks for shared q-grams, and how many it asks for."""
    for q in (3, 2, 1):
        if n - q + 1 - k * q >= 1:
            return q, n - q + 1 - k * q
    return 1, 1


def _step(n: int, repeat: int) -> int:
    """The step that a repetition samples: the golden ratio's multiples, which any number of repetitions spreads evenly."""
    return int(max(1, SAMPLED_STEPS * n) * ((repeat // 2 + 0.5) * 0.6180339887498949 % 1))


def backwards(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of words (padded with 0) in reverse."""
    column = np.arange(rows.shape[1])
    return np.where(column < lengths[:, None], np.take_along_axis(rows, np.maximum(lengths[:, None] - 1 - column, 0), 1), np.uint64(0))


def cgk_keys(rows: np.ndarray, lengths: np.ndarray, n: int, repeats: np.ndarray) -> np.ndarray:
    """LSH keys (rows, repeats) of rows of word hashes padded with 0 to n + 1 columns: what each repetition's walk, over the reversed
    row if its number is odd, writes at the step that it samples."""
    m, wide = rows.shape
    flat = np.concatenate([rows.ravel(), backwards(rows, lengths).ravel()])
    line = (np.arange(m)[:, None] * wide + repeats % 2 * (m * wide)).ravel()
    step = np.tile([_step(n, r) for r in repeats.tolist()], m)
    order = np.argsort(-step, kind="stable")  # walks that go on come first
    line, length, step = line[order], np.repeat(lengths, len(repeats))[order], step[order]
    seed = mix64(np.tile(repeats.astype(np.uint64) + np.uint64(1), m)[order] * np.uint64(0x9E3779B97F4A7C15))
    at = np.zeros(len(line), np.int64)
    going = np.searchsorted(-step, -np.arange(int(step.max(initial=0))), "left").tolist()  # walks of more than k steps
    for k, on in enumerate(going):
        if k % 64 == 0 and k:
            seed = mix64(seed)
        coin = mix64(flat[line[:on] + at[:on]] ^ seed[:on]) >> np.uint64(k % 64) & np.uint64(1)
        at[:on] = np.minimum(at[:on] + coin.view(np.int64), length[:on])
    out = np.empty(len(line), np.uint64)
    out[order] = flat[line + at]
    return out.reshape(m, len(repeats))


def _batches(n: int) -> Iterator[np.ndarray]:
    """Numbers of n repetitions, in growing batches: most pairs that agree do so in the first few."""
    a, size = 0, 4
    while a < n:
        yield np.arange(a, min(n, a + size))
        a, size = a + size, 2 * size


def edited(r: np.random.Generator, n: int, k: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """An item of n distinct words and a window at k edits of it: spread substitutions, spread moves (a deletion and an insertion
    each), or a block of other words at the front or in the middle."""
    item = r.integers(1, 2**63, n, dtype=np.uint64)
    other = lambda m: r.integers(1, 2**63, m, dtype=np.uint64)
    window = item.copy()
    if kind == 1:
        moved = k // 2
        window = np.delete(window, r.choice(n, moved, replace=False))
        window = np.insert(window, r.integers(0, len(window) + 1, moved), other(moved))
        if k % 2:
            window[r.integers(0, n)] = other(1)[0]
        return item, window
    at = r.choice(n, k, replace=False) if kind == 0 else np.arange(k) + (0 if kind == 2 else (n - k) // 2)
    window[at] = other(k)
    return item, window


@lru_cache(maxsize=256)
def repeats_for(n: int, similarity: float) -> int:
    """Repetitions for items of n words; lengths are rounded up to steps of a quarter, at which the simulation runs."""
    grid = 5
    while grid < n:
        grid += max(1, grid // 4)
    if grid > n:
        return repeats_for(grid, similarity) if edits_allowed(n, similarity) else 1
    k = edits_allowed(n, similarity)
    if not k:
        return 1  # nothing but copies, which have every key
    r = np.random.default_rng([n, k])
    pairs = [edited(r, n, k, kind) for kind in range(4) for _ in range(max(8, min(SIMULATED, 60_000 // n)))]
    a, b = (np.zeros((len(pairs), n + 1), np.uint64) for _ in range(2))
    a[:, :n], b[:, :n] = (np.stack(x) for x in zip(*pairs, strict=True))
    whole = np.full(len(pairs), n)
    open_ = np.arange(len(pairs))
    for repeats in _batches(MOST_REPEATS):
        same = cgk_keys(a[open_], whole[open_], n, repeats) == cgk_keys(b[open_], whole[open_], n, repeats)
        if same.any(axis=1).all():
            return 2 * (int(repeats[0]) + 1 + int(same.argmax(axis=1).max()))
        open_ = open_[~same.any(axis=1)]
    return MOST_REPEATS


def edit_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Levenshtein distance of each padded row of a (of la words) and the row of b of n words."""
    j = np.arange(n + 1, dtype=np.int32)
    row = np.tile(j, (len(a), 1))
    out = np.where(la == 0, n, 0)
    for i in range(1, int(la.max(initial=0)) + 1):
        step = np.empty_like(row)
        step[:, 0] = i
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i - 1:i] != b[:, :n]))
        row = np.minimum.accumulate(step - j, axis=1) + j
        out = np.where(la == i, row[:, n], out)
    return out


class Benchmark:
    """Items by length, their q-grams and their LSH keys. Items without words or without an id, and those of fewer than
    ``least_words`` words, are left out."""

    def __init__(self, ids: list[int], texts: list[str | None], similarity: float, least_words: int = 1):
        data, offsets = string_bytes(pa.array([t or "" for t in texts], pa.string()))
        words = Words(data, offsets, True)
        first, second = words.digests(lower=True)
        #: by length: edits allowed, ids, words (both hashes), keys of each repetition
        self.lengths: dict[int, tuple] = {}
        by: dict[int, list] = {}
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if b - a >= max(1, least_words) and ids[i] is not None:
                by.setdefault(int(b - a), []).append((ids[i], first[a:b], second[a:b]))
        grams: dict[int, list] = {}
        for n, items in by.items():
            k = edits_allowed(n, similarity)
            q, need = _qgram(n, k)
            rows, rest = (np.zeros((len(items), n + 1), np.uint64) for _ in range(2))
            rows[:, :n], rest[:, :n] = [x for _, x, _ in items], [x for *_, x in items]
            for row, (_, x, _) in enumerate(items):
                grams.setdefault(q, []).append((n, need, np.unique(windows(x, np.zeros(n, np.int64), q)[0]), row))
            whole = np.full(len(items), n)
            self.lengths[n] = (k, np.array([i for i, *_ in items]), rows, rest, cgk_keys(rows, whole, n, np.arange(repeats_for(n, similarity))))
        self.grams = {}
        for q, x in grams.items():
            every = np.concatenate([g for _, _, g, _ in x])
            holder = np.repeat(np.arange(len(x)), [len(g) for _, _, g, _ in x])
            order = np.argsort(every, kind="stable")
            own, at = np.unique(every[order], return_index=True)
            size = 1 << max(16, (32 * len(own) - 1).bit_length())
            table = np.zeros(size, bool)
            table[own & np.uint64(size - 1)] = True
            self.grams[q] = (own, np.append(at, len(every)), holder[order], np.array([n for n, *_ in x]), np.array([m for _, m, *_ in x]), np.array([row for *_, row in x]), table)

    def candidates(self, h: np.ndarray, words: Words, q: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(item length, item among those of its length, first word) of the pairs of window and item that share enough q-grams, for
        a range of first words after the other, so that a q-gram that many items hold is never expanded for all its places at once."""
        own, cuts, holder, size, need, row, table = self.grams[q]
        g, whole = windows(h, words.doc, q)
        place = np.flatnonzero(table[g & np.uint64(len(table) - 1)] & whole)
        index = np.minimum(np.searchsorted(own, g[place]), len(own) - 1)
        real = own[index] == g[place]
        place, index = place[real], index[real]
        many = np.diff(cuts)[index]
        ends = np.cumsum(many)
        reach = int(size.max(initial=0))
        a = 0
        while a < len(place):
            # windows that start up to the place of hit b - 1 and after that of hit a - 1, and the hits that they may hold
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EXPANDED, "right")))
            low_start, high_start = (place[a - 1] + 1 if a else 0), place[b - 1]
            c = int(np.searchsorted(place, high_start + reach, "right"))
            at, each = place[a:c], many[a:c]
            total = int(each.sum())
            item = holder[np.repeat(cuts[index[a:c]], each) + np.arange(total) - np.repeat(np.cumsum(each) - each, each)]
            at = np.repeat(at, each)
            a = b
            order = np.lexsort((at, item))
            item, at = item[order], at[order]
            # need[item] hits of one item close enough for one window
            end = np.arange(total) + need[item] - 1
            ok = end < total
            end = np.minimum(end, total - 1)
            ok &= (item[end] == item) & (words.doc[at[end]] == words.doc[at]) & (at[end] - at <= size[item] - q)
            item, first, last = item[ok], at[ok], at[end[ok]]
            low = np.maximum(words.first[words.doc[first]], last - (size[item] - q))
            # the ranges [low, first] of each item, without overlaps: later hits give later ranges
            previous = np.full(len(first), -1)
            previous[1:] = np.where(item[1:] == item[:-1], first[:-1], -1)
            low = np.maximum(np.maximum(low, previous + 1), low_start)
            first = np.minimum(first, high_start)
            count = np.maximum(0, first - low + 1)
            start = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item = np.repeat(item, count)
            yield size[item], row[item], start

    def search(self, words: Words) -> Iterator[tuple[np.ndarray, ...]]:
        """Verified (row, item, distance, first word within the row, words of the item)."""
        h, g = words.digests(lower=True)
        total = len(h)
        last = words.first[1:][words.doc] if total else words.first  # one past the last word of each word's row
        for q in self.grams:
            if total < q:
                continue
            for length, which, start in self.candidates(h, words, q):
                for n in np.unique(length).tolist():
                    k, ids, rows, rest, keys = self.lengths[n]
                    begin, item = start[length == n], which[length == n]
                    size = np.minimum(n, last[begin] - begin)
                    whole = size >= n - k
                    begin, item, size = begin[whole], item[whole], size[whole]
                    column, each = np.arange(n + 1), max(1, COMPARED_WORDS // (n + 1))
                    cut = lambda of, s, z: np.where(column < z[:, None], of[np.minimum(s[:, None] + column, total - 1)], np.uint64(0))  # noqa: E731, B023
                    near = []
                    for lo in range(0, len(begin), each):
                        near.append(lo + self._same_key(cut(h, begin[lo:lo + each], size[lo:lo + each]), size[lo:lo + each], item[lo:lo + each], n, keys))
                    near = np.concatenate(near) if near else np.zeros(0, np.int64)
                    begin, item, size = begin[near], item[near], size[near]

                    def distance(i: np.ndarray, begin=begin, item=item, size=size, rows=rows, rest=rest, n=n, k=k, cut=cut) -> np.ndarray:
                        out = np.empty(len(i), np.int64)
                        for lo in range(0, len(i), each):
                            j = i[lo:lo + each]
                            d = edit_distances(cut(h, begin[j], size[j]), size[j], rows[item[j]], n)
                            ok = np.flatnonzero(d <= k)  # words that agree in one hash are told apart by the other
                            d[ok] = np.maximum(d[ok], edit_distances(cut(g, begin[j[ok]], size[j[ok]]), size[j[ok]], rest[item[j[ok]]], n))
                            out[lo:lo + each] = d
                        return out

                    i, d = closest(words.doc[begin] * len(ids) + item, begin, k, distance)
                    if len(i):
                        yield words.doc[begin[i]], ids[item[i]], d, begin[i] - words.first[words.doc[begin[i]]], np.full(len(i), n)

    @staticmethod
    def _same_key(w: np.ndarray, size: np.ndarray, item: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
        """Rows that have a key of their item's in some repetition."""
        hit = np.zeros(len(w), bool)
        open_ = np.arange(len(w))
        for repeats in _batches(keys.shape[1]):
            same = (cgk_keys(w[open_], size[open_], n, repeats) == keys[item[open_]][:, repeats]).any(axis=1)
            hit[open_[same]] = True
            open_ = open_[~same]
            if not len(open_):
                break
        return np.flatnonzero(hit)


def closest(pair: np.ndarray, begin: np.ndarray, k: int, distance) -> tuple[np.ndarray, np.ndarray]:
    """For each pair (of row and item) the entry of smallest distance, if it is at most k, and that distance; the first of equals.

    ``distance`` maps entries to their distances. Windows s words apart differ by 2 s edits at most, so an entry needn't be looked at
    if those looked at say that it is farther than k or than the best one of its pair.
    """
    order = np.lexsort((begin, pair))
    pair, begin = pair[order], begin[order]
    n = len(pair)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(np.append(0, pair[1:] != pair[:-1]))
    d = np.full(n, -1)
    bound = np.zeros(n, np.int64)  # a lower bound of each distance
    best = np.full(group[-1] + 1, k)
    stride = 1 << 20
    while stride:
        todo = np.flatnonzero((d < 0) & (bound <= best[group]))
        # the first of each pair and every stride-th of those left
        rank = np.arange(len(todo)) - np.searchsorted(group[todo], group[todo], "left")
        todo = todo[rank % stride == 0]
        d[todo] = distance(order[todo])
        np.minimum.at(best, group[todo], d[todo])
        known = np.flatnonzero(d >= 0)
        if len(known):
            for side in (-1, 1):
                at = np.searchsorted(known, np.arange(n), "right") - 1 if side < 0 else np.searchsorted(known, np.arange(n), "left")
                ok = (at >= 0) & (at < len(known))
                at = known[np.clip(at, 0, len(known) - 1)]
                ok &= group[at] == group
                bound = np.where(ok, np.maximum(bound, d[at] - 2 * np.abs(begin - begin[at])), bound)
        stride //= 4 if stride > 4 else 2
    found = np.flatnonzero((d >= 0) & (d <= k) & (d == best[group]))
    found = found[np.append(True, group[found][1:] != group[found][:-1])] if len(found) else found
    return order[found], d[found]


def leaks(df: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, start_word, n_words, similarity): for each document and item that it leaks the closest window,
    the first one of equals.

    Words are maximal runs of other than white space, A-Z lower-cased; in scripts that are written without spaces (U+0E00 to U+0EFF,
    U+3000 to U+9FFF) each character is a word. Whole documents are searched, map-only; repeated rows with one id count as one
    document. Null and empty texts leak nothing, rows with a null doc_id are not reported. An item of fewer than five words allows no
    edit and so is searched for exactly; items of fewer than ``least_words`` words, without words or with a null id are not searched
    for. Other columns are not read. Windows within the distance are found but for the few that share no key with their item
    (see ``repeats_for``); whatever is found is within the distance.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).where("__id IS NOT NULL AND __text IS NOT NULL")
    items = bench.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = text_bytes(items, "t")
    blocks = 1 if total <= BLOCK_BYTES else pieces(total, BLOCK_BYTES // 2, 2)
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).toArrow()
        held = Benchmark(own.column("i").to_pylist(), own.column("t").to_pylist(), similarity, least_words)
        shipped = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column(0))
                data, offsets = string_bytes(batch.column(1))
                for a, b in slices(offsets, SEARCH_BYTES):
                    for row, item, distance, start, n in shipped.value.search(Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], True)):
                        order = np.lexsort((start, distance, item, row))
                        row, item, distance, start, n = (x[order] for x in (row, item, distance, start, n))
                        new = np.ones(len(row), bool)
                        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[a + row[new]], pa.int64()), pa.array(item[new], pa.int64()), pa.array(distance[new], pa.int32()), pa.array(start[new], pa.int64()), pa.array(n[new], pa.int32())],
                            names=["__id", "item_id", "distance", "start_word", "n_words"])

        part = docs.mapInArrow(lean(run), _OUT)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("__id", "item_id").agg(F.min(F.struct("distance", "start_word", "n_words")).alias("m"))
    return best.select(F.col("__id").alias(doc_id), "item_id", "m.distance", "m.start_word", "m.n_words", (1 - F.col("m.distance") / F.col("m.n_words")).alias("similarity"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
