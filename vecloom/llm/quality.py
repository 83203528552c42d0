"""Document quality by a linear-chain conditional random field over lines.

Every line is a step of the chain, in state good or bad; its features are those of its own bytes and of the lines before and after it.
Forward-backward gives each line's marginal of being good, and the marginals' mean, weighted by line length, is the document's
evidence, which a logistic calibration turns into a score. Lines have no labels of their own, so training gives each line its
document's label; the calibration then says how much evidence a document needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Words, crc_mod, documents, lean, mix64, slices, string_bytes

#: Labelled documents that the model is fitted on: about so many of each label, by a hash of the identifier.
TRAIN_DOCS = 1500
#: Lines of them that are fitted on; documents are added whole until the next would exceed it.
TRAIN_LINES = 120_000
HELD_OUT_FOLD, HELD_OUT = 4, 2
THRESHOLD = 0.7
ROUNDS = 150
#: Lines and bytes whose features are made at a time, and lines that messages pass one after the other.
BLOCK_LINES = 1 << 13
BLOCK_BYTES = 1 << 20
CHAIN_LINES = 256

_LOWER, _UPPER, _DIGIT, _POINT, _PIPE, _SYMBOL, _OTHER, _SPACE = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[0x80:] = _OTHER
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = _LOWER, _UPPER, _DIGIT
_CLASS[[*b".,;:'\"()-?"]], _CLASS[ord("|")] = _POINT, _PIPE
_CLASS[[0x20, *range(9, 14)]] = _SPACE
OWN = 14


class Lines:
    """Lines of some rows: start and end bytes, row, size; each row has at least one line. ``first`` is where each row's lines begin.

    Features are made for a block of lines at a time, so that a text of nothing but line breaks takes no more memory than another.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n_rows = len(offsets) - 1
        self.data = data
        kind = np.int32 if len(data) < 2**31 else np.int64
        breaks = np.flatnonzero(data == 0x0A).astype(kind) + kind(1)
        row = (np.searchsorted(offsets, breaks, "right") - 1).astype(kind)
        # a break begins a line of the row that it ends in, unless the row ends there
        inside = (breaks > offsets[np.minimum(row, n_rows - 1)]) & (row < n_rows)
        breaks, row = breaks[inside], row[inside]
        starts = np.concatenate([offsets[:-1].astype(kind), breaks])
        row = np.concatenate([np.arange(n_rows, dtype=kind), row])
        order = np.lexsort((starts, row))
        self.start, self.row = starts[order], row[order]
        self.end = np.append(self.start[1:], kind(len(data)))
        self.first = np.searchsorted(self.row, np.arange(n_rows + 1))
        self.end[self.first[1:] - 1] = offsets[1:]
        self.size = self.end - self.start
        self.twice = self._twice()

    def __len__(self) -> int:
        return len(self.start)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of lines that together hold all, each of at most BLOCK_LINES lines and BLOCK_BYTES bytes or one line."""
        a, n = 0, len(self)
        while a < n:
            b = int(np.searchsorted(self.end, int(self.start[a]) + BLOCK_BYTES, "right"))
            b = min(n, max(a + 1, min(b, a + BLOCK_LINES)))
            yield a, b
            a = b

    def words(self, a: int, b: int) -> Words:
        """Words of lines a to b - 1, each of which counts as a row: a word never holds a line break."""
        begin = int(self.start[a])
        return Words(self.data[begin:int(self.end[b - 1])], np.append(self.start[a:b], self.end[b - 1]).astype(np.int64) - begin)

    def _twice(self) -> np.ndarray:
        """Whether a line's words are those of another line of its row."""
        prints = np.zeros(len(self), np.uint64)  # sum over a line's words of a hash of word and place
        some = np.zeros(len(self), bool)
        for a, b in self.blocks():
            words = self.words(a, b)
            if not len(words):
                continue
            place = np.arange(len(words)) - words.first[words.doc]
            sums = np.append(np.uint64(0), np.cumsum(mix64(words.hashes() ^ place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            prints[a:b] = sums[words.first[1:]] - sums[words.first[:-1]]
            some[a:b] = words.first[1:] > words.first[:-1]
        twice = np.zeros(len(self), bool)
        at = np.flatnonzero(some)
        order = at[np.lexsort((prints[at], self.row[at]))]
        equal = (prints[order][1:] == prints[order][:-1]) & (self.row[order][1:] == self.row[order][:-1])
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        return twice

    def own(self, a: int, b: int) -> np.ndarray:
        """Own features (b - a, OWN) of lines a to b - 1."""
        n, begin = b - a, int(self.start[a])
        data, start, end = self.data[begin:int(self.end[b - 1])], self.start[a:b] - begin, self.end[a:b] - begin
        kind = _CLASS[data]
        total = np.zeros(len(data) + 1, np.int32)

        def counted(mask: np.ndarray) -> np.ndarray:
            np.cumsum(mask, out=total[1:])
            return (total[end] - total[start]).astype(float)

        count = [counted(kind == k) for k in range(8)]
        bangs = counted(data == ord("!"))
        words = self.words(a, b)
        h, line = words.hashes(), words.doc
        n_words = np.diff(words.first)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[same], minlength=n)
        order = np.lexsort((h, line))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order][new], minlength=n)
        size, some = np.maximum(self.size[a:b], 1).astype(float), np.maximum(n_words, 1)
        letters = np.maximum(count[_LOWER] + count[_UPPER] + count[_OTHER], 1)
        return np.stack([
            np.ones(n), np.log1p(self.size[a:b]) / 5, count[_UPPER] / letters, count[_DIGIT] / size, np.minimum(1, 8 * count[_PIPE] / size),
            np.minimum(1, 4 * count[_SYMBOL] / size), np.minimum(1, 4 * bangs / size), (size - count[_SPACE]) / some / 10, again / some, count[_OTHER] / size,
            count[_POINT] / some, self.twice[a:b], n_words <= 1, 1 - distinct / some], axis=1)

    def features(self, a: int, b: int) -> np.ndarray:
        """Features of lines a to b - 1: their own, then those of the line before and of the line after."""
        lo, hi = max(0, a - 1), min(len(self), b + 1)
        return neighbours(self.own(lo, hi), self.row[lo:hi])[a - lo:b - lo]


def neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and of the line after within the row (zeros at its ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = row[1:] == row[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after], axis=1)


def _unit(a: np.ndarray) -> np.ndarray:
    """Each row of the last axis divided by its sum."""
    return a / a.sum(axis=-1, keepdims=True)


class Chain:
    """Two-state chain: node score of good against bad, and transition scores [from, to]."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.transitions, self.slope, self.offset = weights, transitions, slope, offset

    def nodes(self, features: np.ndarray) -> np.ndarray:
        """Node score of each line; summed line by line, so that it doesn't depend on what else is in the batch."""
        return (features * self.weights).sum(axis=1)

    def marginals(self, z: np.ndarray, first: np.ndarray, pairs: bool = False):
        """P(good) of each line by forward-backward from the node scores; with ``pairs`` also the expected transitions.

        All rows go side by side, and long ones in blocks of CHAIN_LINES lines side by side as well: the product of a block's
        matrices carries messages across it, and the blocks of a row are then gone through with the messages that reach them.
        """
        step = np.exp(self.transitions - self.transitions.max())
        n = np.diff(first)
        each = -(-n // CHAIN_LINES)
        head = np.cumsum(each) - each  # first block of each row
        number = np.arange(each.sum()) - np.repeat(head, each)
        begin = np.repeat(first[:-1], each) + CHAIN_LINES * number
        length = np.minimum(CHAIN_LINES, np.repeat(first[1:], each) - begin)
        order = np.argsort(-length, kind="stable")
        longest = int(length.max(initial=0))
        active = np.searchsorted(-length[order], -np.arange(longest), "left")  # blocks of more than t lines

        def node(at: np.ndarray) -> np.ndarray:
            return np.exp(np.stack([-np.maximum(z[at], 0), z[at] - np.maximum(z[at], 0)], axis=-1))

        entry, leave = np.ones((len(begin), 2)), np.ones((len(begin), 2))
        if len(begin) > len(n):
            block = np.tile(np.eye(2), (len(begin), 1, 1))  # product of each block's matrices; the first of a row forgets what it got
            long_ = order[np.repeat(each, each)[order] > 1]
            for t in range(longest):
                k = long_[length[long_] > t]
                ahead = block[k] @ step if t else np.where((number[k] == 0)[:, None, None], 1.0, step)
                block[k] = ahead * node(begin[k] + t)[:, None, :]
                block[k] /= block[k].sum(axis=(1, 2), keepdims=True)
            for j in range(1, int(each.max(initial=0))):
                k = head[each > j] + j
                entry[k] = _unit((entry[k - 1][:, :, None] * block[k - 1]).sum(axis=1))
                k = head[each > j] + each[each > j] - 1 - j
                leave[k] = _unit((block[k + 1] * leave[k + 1][:, None, :]).sum(axis=2))
        forward, backward = np.empty(len(z)), np.empty(len(z))  # messages of state good, normalised
        message = entry[order]
        for t in range(longest):
            k = order[:active[t]]
            message = message[:active[t]]
            ahead = message[:, :1] * step[0] + message[:, 1:] * step[1]
            if t == 0:
                ahead = np.where((number[k] == 0)[:, None], 1.0, ahead)
            message = _unit(ahead * node(begin[k] + t))
            forward[begin[k] + t] = message[:, 1]
        state = _unit(leave)
        for t in range(longest - 1, -1, -1):
            k = order[:active[t]]
            inner = k[length[k] - 1 > t]
            m = node(begin[inner] + t + 1) * state[inner]
            state[inner] = _unit(m[:, :1] * step[:, 0] + m[:, 1:] * step[:, 1])
            backward[begin[k] + t] = state[k, 1]
        good = forward * backward / (forward * backward + (1 - forward) * (1 - backward))
        if not pairs:
            return good
        at = np.delete(np.arange(len(z)), first[1:] - 1)  # lines that another of the row follows
        m = node(at + 1) * np.stack([1 - backward[at + 1], backward[at + 1]], axis=1)
        joint = np.stack([1 - forward[at], forward[at]], axis=1)[:, :, None] * step * m[:, None, :]
        return good, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def evidence(self, z: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logit of each row's mean marginal, weighted by line length (a row of empty lines: by line)."""
        good, row = self.marginals(z, first), np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = size + 1e-3
        n = len(first) - 1
        mean = np.bincount(row, weights=weight * good, minlength=n) / np.maximum(np.bincount(row, weights=weight, minlength=n), 1e-9)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, lines: Lines) -> np.ndarray:
        z = np.concatenate([np.zeros(0), *(self.nodes(lines.features(a, b)) for a, b in lines.blocks())])
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(z, lines.size, lines.first) + self.offset, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression of y on x, with a weak pull to the identity."""
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0]), float(w[1])


def fit_chain(features: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Chain:
    """Maximum likelihood (Adam, weighted lines) of the chain whose lines all carry their row's label."""
    n = np.diff(first)
    y = np.repeat(label, n).astype(float)
    seen = np.zeros((2, 2))
    inner = np.maximum(n - 1, 0)
    seen[0, 0], seen[1, 1] = inner[label == 0].sum(), inner[label == 1].sum()
    chain = Chain(np.zeros(features.shape[1]), np.zeros((2, 2)))
    theta = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, ROUNDS + 1):
        good, expected = chain.marginals(chain.nodes(features), first, pairs=True)
        gradient = np.concatenate([features.T @ (weight * (y - good)) / weight.sum(), 0.1 * ((seen - expected) / max(1, inner.sum())).ravel()]) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)
        # a chain that can't change its state would let one line speak for all
        theta[-4:] = np.clip(theta[-4:], -1, 1)
        chain = Chain(theta[:-4], theta[-4:].reshape(2, 2))
    return chain


def _batch_lines(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Lines]]:
    data, offsets = string_bytes(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, Lines(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Chain:
    """Fit on labelled rows whose crc32(doc_id) mod 4 isn't 2, about TRAIN_DOCS of each label (0 and 1) by a hash of the identifier.

    The driver gets the identifiers and line counts of the sample, takes documents in the order of another hash as long as they have
    TRAIN_LINES lines together and a twentieth of that each, and then the line features of those. A document with several labels has
    the largest, one with several texts any one of them. Without labels of both kinds every document scores the share of label 1.
    """
    marks = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull() & (crc_mod(doc_id, HELD_OUT_FOLD) != HELD_OUT)).groupBy(F.col(doc_id).alias("id")).agg(F.max(quality).alias("y"))
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    base = sizes.get(1, 0) / total if total else 0.5
    if len(sizes) < 2:
        p = min(max(base, 1e-3), 1 - 1e-3)
        return Chain(np.zeros(3 * OWN), np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p))))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, TRAIN_DOCS / n)))])
    drawn = marks.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < F.element_at(share, F.col("y")) * (1 << 30))
    sample = df.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(drawn), "id")  # drawn: about 2 TRAIN_DOCS rows of two numbers
    sample = sample.withColumn("h", F.xxhash64("text"))
    lines_in = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).alias("n")
    counts = sample.select("id", "h", lines_in).groupBy("id").agg(F.min(F.struct("h", "n")).alias("m")).select("id", "m.h", "m.n").where(F.col("n") <= TRAIN_LINES // 20)
    taken, held = [], 0
    for r in sorted(counts.collect(), key=lambda r: (r.id * 0x9E3779B97F4A7C15 % 2**64 * 0xD6E8FEB86659FD93 % 2**64 >> 8, r.id)):
        if held + r.n <= TRAIN_LINES:
            taken.append((r.id, r.h))
            held += r.n
    chosen = df.sparkSession.createDataFrame(taken, T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType())]))
    # one text of each, however many rows repeat it
    sample = sample.join(F.broadcast(chosen), ["id", "h"]).groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("sizes", T.BinaryType()), T.StructField("features", T.BinaryType())])

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lines in _batch_lines(batch, 2):
                cuts = lines.first
                own = np.concatenate([lines.own(*x) for x in lines.blocks()]).astype("<f4")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(1).slice(a, b - a).cast(pa.int32()),
                    pa.array([lines.size[s:e].astype("<i8").tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([own[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["id", "y", "sizes", "features"])

    rows = sorted(sample.mapInArrow(lean(lines_of), out).collect(), key=lambda r: r.id)
    n = np.array([len(r.sizes) // 8 for r in rows], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    size = np.frombuffer(b"".join(bytes(r.sizes) for r in rows), "<i8")
    features = neighbours(np.frombuffer(b"".join(bytes(r.features) for r in rows), "<f4").reshape(-1, OWN).astype(float), np.repeat(np.arange(len(rows)), n))
    label = np.array([r.y for r in rows])
    # each document weighs the same, and so does each label
    weight = np.repeat(1 / np.maximum(n, 1) / np.where(label == 1, max(1, (label == 1).sum()), max(1, (label == 0).sum())), n)
    chain = fit_chain(features, first, label, weight)
    # the sample has as many of each label as it can; the calibration weighs them back to the shares of all
    chain.slope, chain.offset = _calibrate(chain.evidence(chain.nodes(features), size, first), label)
    p, q = (label == 1).mean(), base
    chain.offset += float(np.log(q / (1 - q)) - np.log(p / (1 - p))) if 0 < p < 1 else 0.0
    return chain


def score(df: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, from its whole text only; map-only.

    Null and empty texts are one empty line. Repeated rows score alike, whatever batch they are in. Columns other than the two named
    are not read.
    """
    schema = T.StructType([T.StructField("__id", df.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lines in _batch_lines(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.round(chain.scores(lines), 9), pa.float64())], names=["__id", "score"])

    scored = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(lean(run), schema)
    return scored.select(F.col("__id").alias(doc_id), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(df: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, whose text scores at least ``threshold``; map-only, texts don't travel."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lines in _batch_lines(batch, at):
                yield batch.slice(a, b - a).filter(pa.array(np.round(chain.scores(lines), 9) >= threshold))

    return df.mapInArrow(lean(run), df.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", HELD_OUT_FOLD) == HELD_OUT).alias("held_out"), "score", "predicted")
