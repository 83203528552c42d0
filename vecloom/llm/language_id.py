"""Language identification with language-bitmask n-gram filters.

An n-gram (bytes of lower-cased words with their edges) belongs to every language in whose training documents it is frequent enough.
All languages share one bit-sliced Bloom filter: a slot holds a bit per language, so the conjunction of an n-gram's slots names every
language that contains it at once. A text's n-grams are counted per language (popcounts of the answers' bit columns), each count is
corrected for the false positives that the language's filling leads to expect, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import LOWER, crc_mod, documents, lean, mix64, slices, string_bytes

#: Training documents per language: about so many are taken by a hash of the identifier.
TRAIN_DOCS = 2000
#: Share of a language's training documents that hold an n-gram of the language, and at least so many documents: names and loan words
#: of single documents say nothing about a language. A documented parameter of the model; all n-grams that reach it are kept.
LEAST_SHARE = 0.004
LEAST_DOCS = 2
SIZES = (2, 3, 4)
#: Slots of the filter per n-gram of the largest language; the number is rounded up to a power of two.
SLOTS_EACH = 16
HASHES = 3
HELD_OUT = 5

_TABLE = LOWER.copy()
_TABLE[:0x80][~np.array([chr(b).isalpha() for b in range(0x80)])] = 0x20

_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the rows' bytes as integers, and the row of each. An n-gram may begin or end with one word edge (a space)."""
    folded = _TABLE[data]
    n, rows = len(folded), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    space = folded == 0x20
    out, own = [], []
    value = folded.astype(np.uint64)
    inner = np.zeros(n, bool)  # a space within, so that the n-gram joins two words
    for k in range(2, max(SIZES) + 1):
        m = n - k + 1
        if m <= 0:
            break
        value = value[:m] << np.uint64(8) | folded[k - 1:].astype(np.uint64)
        inner = inner[:m] | space[k - 2:k - 2 + m] if k > 2 else inner[:m]
        if k in SIZES:
            keep = ~inner & ~(space[:m] & space[k - 1:]) & (rows[:m] == rows[k - 1:])
            out.append(value[keep])
            own.append(rows[:m][keep])
    return (np.concatenate(out), np.concatenate(own)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class SlicedFilter:
    """A Bloom filter for up to 64 languages per word: slots[s, w] has bit l of language 64 w + l."""

    def __init__(self, sets: dict[str, np.ndarray], sizes: dict[str, int] | None = None, slots: int = 0, hashes: int = HASHES):
        """``sizes``: training documents of each language; languages are in the order in which they win ties, the largest first."""
        self.languages, self.hashes = sorted(sets, key=lambda name: (-(sizes or {}).get(name, 0), name)), hashes
        slots = slots or 1 << max(10, (SLOTS_EACH * max(map(len, sets.values()), default=1) - 1).bit_length())
        self.slots = np.zeros((slots, (len(sets) + 63) // 64 or 1), np.uint64)
        for i, name in enumerate(self.languages):
            for at in self._slots(np.asarray(sets[name], np.uint64)):
                self.slots[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        fill = np.array([((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))])
        #: how often an n-gram that a language doesn't have is found in it
        self.false = fill ** hashes

    def _slots(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix64(keys)
        for i in range(self.hashes):
            yield ((h >> np.uint64(20 * i)) ^ (h >> np.uint64(43))) & np.uint64(len(self.slots) - 1)

    def answer(self, keys: np.ndarray) -> np.ndarray:
        """One row of language words per key."""
        found = None
        for at in self._slots(keys):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def counts(self, keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each row's n-grams in each language (n, languages), and the number of n-grams."""
        answer = self.answer(keys)
        total = np.bincount(rows, minlength=n)
        share = np.zeros((n, len(self.languages)))
        for i in range(len(self.languages)):
            bit = (answer[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(rows, weights=bit, minlength=n)
            share[:, i] = (hits / np.maximum(total, 1) - self.false[i]) / (1 - self.false[i])
        return np.clip(share, 0, 1), total


def train(df: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", fold: int = HELD_OUT) -> SlicedFilter:
    """Learn from text and non-null lang of rows whose crc32(doc_id) mod fold isn't 0.

    The sample is about TRAIN_DOCS rows per language, by a hash of identifier and text; all of each text is read. What reaches the
    driver is one row per language and the n-grams that enough of the sample's documents hold: of a text of m distinct n-grams on
    average no more than m / LEAST_SHARE. Rows that repeat one identifier and text are all in the sample or all not, and count as one
    document. Columns other than the three named are not read.
    """
    rows = df.where((crc_mod(doc_id, fold) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return SlicedFilter({})
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, TRAIN_DOCS / n)))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    sample = rows.where(drawn).groupBy("lang", F.xxhash64("id", "text").alias("h")).agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            data, offsets = string_bytes(batch.column(1))
            for a, b in slices(offsets):
                keys, own = grams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                for name in set(names[a:b]):
                    mine = (names[a:b] == name)[own]
                    order = np.lexsort((own[mine], keys[mine]))
                    k, o = keys[mine][order], own[mine][order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                    gram, docs = np.unique(k[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(docs, pa.int64())], names=["lang", "gram", "docs"])

    counted = sample.mapInArrow(lean(count), "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    drawn_docs = {k: max(1.0, min(n, TRAIN_DOCS)) for k, n in sizes.items()}
    least = F.create_map(*[x for k, n in drawn_docs.items() for x in (F.lit(k), F.lit(max(float(LEAST_DOCS), LEAST_SHARE * n)))])
    found = counted.where(F.col("docs") >= F.element_at(least, F.col("lang"))).select("lang", "gram").toArrow()
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    own = np.asarray(found.column("gram").combine_chunks()).astype(np.uint64) if found.num_rows else np.zeros(0, np.uint64)
    return SlicedFilter({k: np.sort(own[names == k]) for k in sizes}, sizes)


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row of UTF-8 bytes holds a letter; only rows without an ASCII one are looked at by themselves."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=total[1:])
    found = total[offsets[1:]] > total[offsets[:-1]]
    np.cumsum(data >= 0x80, out=total[1:])
    for i in np.flatnonzero(~found & (total[offsets[1:]] > total[offsets[:-1]])).tolist():
        found[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode())
    return found


def identify(df: DataFrame, model: SlicedFilter, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text only.

    ``score`` is the share of the text's n-grams that the language is found to hold, 0 to 1. A text that is null or has no letter is
    ``und`` with score 0, as is every text if no language was learnt; ties go to the language with more training documents. Repeated
    rows are judged alike; columns other than the two named are not read.
    """
    schema = T.StructType([T.StructField("__id", df.schema[doc_id].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            best, scores = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for a, b in slices(offsets, 1 << 19):
                part, cut = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                if model.languages:
                    share, _ = model.counts(*grams(part, cut), b - a)
                    best[a:b] = np.where(lettered(part, cut), share.argmax(axis=1), -1)
                    scores[a:b] = np.where(best[a:b] >= 0, share.max(axis=1), 0.0)
            names = np.array([*model.languages, "und"], dtype=object)[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["__id", "lang_pred", "score"])

    return df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(lean(run), schema).withColumnRenamed("__id", doc_id)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs)).select("doc_id", (crc_mod("doc_id", HELD_OUT) == 0).alias("held_out"), "lang_pred", "score")
