"""SimHash near-dedup: fingerprints, and links between fingerprints by a self-join of a binary trie.

Equal fingerprints become one class first, so the join sees each once. The bits are cut into budget + j blocks; two fingerprints with
at most ``budget`` differing bits agree on j of them, so each choice of j blocks deals the fingerprints out by its value (j grows
with their number, so that groups stay small), and within a group the remaining bits form a trie, whose nodes are ranges of the
sorted fingerprints. Node pairs are traversed together from the root, both children of one with both of the other, adding up
differing bits and dropping a pair as soon as its sum exceeds the budget. A group that is too large for one task is split into node
pairs of the trie, each with the budget that it has left, until every part fits. A task returns a spanning star of each cluster it
finds, not all pairs, and connected components are found over those links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import LOWER, Words, checkpointed, documents, lean, mix64, pieces, release, slices, staged, string_bytes, text_bytes, windows

SHINGLE = 3
SEED = 42
BUDGET = 3
#: Fingerprints that one task joins; larger groups are split at the trie's next SPLIT_BITS bits.
GROUP_ROWS = 8192
SPLIT_BITS = 6
#: Rows of the groups that one call joins side by side.
CELL_ROWS = 1 << 16
#: Node pairs that are expanded at a time.
PAIR_BLOCK = 1 << 15

#: Words of a shingle of the sets, and bytes of text that are expanded at a time for them.
WIDE_SHINGLE = 5
WIDE_SLICE = 1 << 17

#: Near copies are texts whose sets of five-word shingles have a Jaccard similarity of at least SIMILAR[0] / SIMILAR[1].
SIMILAR = (4, 5)
#: Documents (about) whose shingles are counted to tell frequent ones, the count in them from which one is frequent, and how many are
#: broadcast at most (16 bytes each). They order the shingles and spread the load; the result doesn't depend on them.
SAMPLED_DOCS = 8192
FREQUENT = 3
MOST_FREQUENT = 200_000
#: Rows of shingles that a task looks through for shared ones, and pairs that are compared at a time.
SHARED_ROWS = 1 << 18
PAIRS_AT_A_TIME = 1 << 18
#: 64-bit words of a set's sketch.
SKETCH_WORDS = 8
#: Rounds that link the rows of a shingle to one of them before all pairs that are still apart are compared.
STAR_ROUNDS = 2
#: Rows of one or two numbers that are broadcast at most.
BROADCAST_ROWS = 500_000


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint long): bit b is 1 if it is set in over half the XXH64 of the word shingles, repeats included.

    A-Z are lower-cased; a text with fewer words has one shingle, one without words (empty, null) the fingerprint zero.
    """
    schema = T.StructType([T.StructField(doc_id, T.LongType()), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        one = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            prints = []
            for a, b in slices(offsets):
                words = Words(LOWER[data[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a])
                joined, cuts = words.kept(np.ones(len(words), bool))
                joined = joined.tobytes()
                size = words.ends - words.starts
                run = np.concatenate([[0], np.cumsum(size + 1)])
                begin = cuts[words.doc] + run[:-1] - run[words.first[words.doc]]  # of each word in the joined bytes
                end = begin + size
                first = words.first
                n = np.diff(first)
                counts = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
                long_ = np.flatnonzero(n >= shingle)
                at = np.concatenate([[0], np.cumsum(counts)])
                starts, ends = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
                if len(long_):
                    doc = np.repeat(long_, counts[long_])
                    i = np.arange(len(doc)) - np.repeat(np.cumsum(counts[long_]) - counts[long_], counts[long_])
                    starts[at[doc] + i] = begin[first[doc] + i]
                    ends[at[doc] + i] = end[first[doc] + i + shingle - 1]
                short = np.flatnonzero((n > 0) & (n < shingle))
                starts[at[short]] = begin[first[short]]
                ends[at[short]] = end[first[short] + n[short] - 1]
                hashes = np.fromiter((one(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
                for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    votes = np.zeros(64, np.int64)
                    for lo in range(s, e, 65536):
                        votes += np.unpackbits(hashes[lo:min(e, lo + 65536)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    prints.append(int(np.packbits(2 * votes > e - s, bitorder="little").view("<i8")[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=[doc_id, "fingerprint"])

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lean(run), schema)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _components(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of u and v in label (the smallest position of each component)."""
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return
        u, v = u[open_], v[open_]
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while not np.array_equal(jumped := label[label], label):
            label[:] = jumped


def trie_join(prints: np.ndarray, budget: int, groups: np.ndarray | None = None) -> np.ndarray:
    """Component label of each fingerprint, linked where at most ``budget`` bits differ.

    Fingerprints are 64-bit integers or rows of several, the first of a row the most significant. They ascend and are distinct; with
    ``groups`` (bounds of n + 1 ranges) they do so within each range, and each range is a trie of its own.

    Traverses pairs of nodes (ranges of prints that share their bits above a level), level by level on a stack of blocks so that
    memory stays bounded. Neighbours in the order, and each print and the first of its range, are compared beforehand; a node pair
    whose prints are in one component already has nothing to add and is left.
    """
    prints = prints.reshape(len(prints), -1)
    n, width = prints.shape
    label = np.arange(n)
    groups = np.array([0, n]) if groups is None else groups

    def link(u: np.ndarray, v: np.ndarray) -> None:
        for lo in range(0, len(u), PAIR_BLOCK):
            a, b = u[lo:lo + PAIR_BLOCK], v[lo:lo + PAIR_BLOCK]
            apart = np.zeros(len(a), np.int64)
            for w in range(width):
                apart += _popcount(prints[a, w] ^ prints[b, w])
                if w + 1 < width:
                    open_ = apart <= budget
                    a, b, apart = a[open_], b[open_], apart[open_]
            _components(label, a[apart <= budget], b[apart <= budget])

    first = np.repeat(groups[:-1], np.diff(groups))
    inner = np.flatnonzero(first != np.arange(n))
    link(inner - 1, inner)
    link(first[inner], inner)
    roots = np.stack([groups[:-1], groups[1:], groups[:-1], groups[1:], np.zeros(len(groups) - 1, np.int64)], axis=1)
    stack = [(64 * width, roots[roots[:, 1] - roots[:, 0] > 1])]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > PAIR_BLOCK:
            stack += [(level, pairs[i:i + PAIR_BLOCK]) for i in range(0, len(pairs), PAIR_BLOCK)]
            continue
        turns = np.cumsum(np.append(0, label[1:] != label[:-1]))
        joined = (turns[pairs[:, 0]] == turns[pairs[:, 1] - 1]) & (turns[pairs[:, 2]] == turns[pairs[:, 3] - 1]) & (label[pairs[:, 0]] == label[pairs[:, 2]])
        pairs = pairs[~joined]
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        link(pairs[single, 0], pairs[single, 2])
        pairs = pairs[~single]
        if not len(pairs) or not level:
            continue
        bit = np.uint64(1) << np.uint64((level - 1) % 64)
        ones = np.concatenate([[0], np.cumsum((prints[:, width - 1 - (level - 1) // 64] & bit) > 0)])
        cut = lambda lo, hi: hi - (ones[hi] - ones[lo])  # noqa: E731  where the one child begins
        a0, a1, b0, b1, bits = pairs.T
        am, bm = cut(a0, a1), cut(b0, b1)
        same = a0 == b0
        made = [np.stack(x, axis=1) for x in ((a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1))]
        other = np.stack((am, a1, b0, bm, bits + 1), axis=1)[~same]  # of a node with itself the mixed pair comes once
        made = np.concatenate([*made, other])
        stack.append((level - 1, made[(made[:, 0] < made[:, 1]) & (made[:, 2] < made[:, 3]) & (made[:, 4] <= budget)]))
    return label


def _keys(n: int, budget: int) -> list[int]:
    """Masks of the bits by which n fingerprints are dealt out; two within the budget agree on all bits of one of the masks.

    64 bits in budget + j blocks, of which any j are a key: at least j blocks have no differing bit. More blocks make longer keys, and
    more of them; j is the least for which a key's groups hold GROUP_ROWS / 8 rows on average.
    """
    for j in range(1, 64 - budget):
        cuts = [64 * i // (budget + j) for i in range(budget + j + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if n <= GROUP_ROWS // 8 << 64 * j // (budget + j) or 64 // (budget + j + 1) < 8:
            return [sum(x) for x in combinations(blocks, j)]
    return [0]


def _long(x: int) -> int:
    """A 64-bit pattern as a signed number."""
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """From distinct fingerprints: links (a, b) that connect all those within ``budget`` differing bits, a star per cluster and part.

    A part of a split group is a pair of nodes at SPLIT_BITS further bits; a fingerprint meets the nodes that differ from its own in no
    more bits than its part of the trie has left of the budget.
    """
    n = prints.count()
    masks = _keys(n, budget)
    keyed = prints.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(_long(m))).alias("value"), F.lit("").alias("part"), F.lit(budget).alias("left")) for i, m in enumerate(masks)])).alias("k")).select("fingerprint", "k.*")
    ready, keys = None, ["band", "value", "part"]
    for at in (*range(0, 64, SPLIT_BITS), 64):
        large = checkpointed(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS))
        if large.isEmpty() or at == 64:  # when no bits are left to split by, a part has few fingerprints
            ready = keyed if ready is None else ready.unionByName(keyed)
            break
        fine = keyed.join(large, keys, "left_anti")
        ready = fine if ready is None else ready.unionByName(fine)
        width = min(SPLIT_BITS, 64 - at)
        node = F.expr(f"CAST(shiftrightunsigned(fingerprint, {at}) & {(1 << width) - 1}L AS INT)")
        near = F.filter(F.array(*[F.lit(x) for x in range(1 << width) if bin(x).count("1") <= budget]), lambda x: F.bit_count(x) <= F.col("left"))
        split = keyed.join(large, keys, "left_semi").withColumn("node", node).withColumn("apart", F.explode(near)).withColumn("other", F.col("node").bitwiseXOR(F.col("apart")))
        split = split.withColumn("part", F.concat_ws(".", "part", F.least("node", "other"), F.greatest("node", "other"))).withColumn("left", F.col("left") - F.bit_count("apart"))
        keyed = checkpointed(split.select("fingerprint", *keys, "left"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(table: pa.Table) -> pa.Table:
        own = np.asarray(table.column("fingerprint").combine_chunks()).view(np.uint64)
        group = np.asarray(table.column("group").combine_chunks())
        order = np.lexsort((own, group))
        own, group = own[order], group[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (group[1:] != group[:-1])
        own, group = own[new], group[new]
        label = trie_join(own, budget, np.append(np.flatnonzero(np.diff(group, prepend=group[0] - 1)), len(own)))
        ends = np.flatnonzero(label != np.arange(len(own)))
        return pa.Table.from_arrays([pa.array(own[label[ends]].view(np.int64)), pa.array(own[ends].view(np.int64))], schema=out)

    # a cell holds whole groups, as many as a task joins side by side; two groups whose hashes agree only meet needlessly
    cells = pieces(n * len(masks), CELL_ROWS, 32)
    ready = ready.select(F.xxhash64("band", "value", "part").alias("group"), "fingerprint").withColumn("cell", F.pmod("group", F.lit(cells)))
    return ready.groupBy("cell").applyInArrow(join, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node of its component: large-star and small-star
    rounds until nothing changes; each round is checkpointed, and only a count reaches the driver."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per row of df: id, fingerprint (16 lowercase hexadecimal digits), component_id (the smallest id reachable over
    links of at most ``budget`` differing bits, itself included).

    Texts without words (null, empty) have fingerprint zero and are linked like any other; a null id is never a component_id unless
    the component has no other. Repeated rows share their fingerprint. Columns other than the two named are not read.
    """
    prints = checkpointed(fingerprints(df, doc_id, text, shingle))
    classes = checkpointed(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("low"), F.count(F.lit(1)).alias("n")))
    roots = connected(links(classes.select("fingerprint"), budget))
    lows = classes.join(roots, classes.fingerprint == roots.node).groupBy("root").agg(F.min("low").alias("component_id"))
    linked = roots.join(lows, "root").select(F.col("node").alias("fingerprint"), "component_id")
    known = classes.where("n > 1").join(linked, "fingerprint", "left_anti").select("fingerprint", F.col("low").alias("component_id")).unionByName(linked)
    return prints.join(known, "fingerprint", "left").select(
        doc_id, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", doc_id).alias("component_id"))


def shingle_sets(words: Words, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, ...]:
    """Hashes of the distinct word shingles by row and ascending, the row of each, and where each row with words begins and its count.

    A-Z are lower-cased; a text with fewer words has one shingle.
    """
    hashes, n = words.hashes(lower=True), np.diff(words.first)
    h, within = windows(hashes, words.doc, shingle)
    shingles, docs = [h[within]], [words.doc[:len(h)][within]]
    for k in range(1, shingle):
        h, _ = windows(hashes, words.doc, k)
        few = np.flatnonzero(n == k)
        shingles.append(h[words.first[few]] if len(few) else h[:0])
        docs.append(few)
    h, doc = np.concatenate(shingles), np.concatenate(docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc = h[new], doc[new]
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    return h, doc, begin, np.diff(np.append(begin, len(h)))


def _sets(df: DataFrame, doc_id: str, text: str, schema: str, make) -> DataFrame:
    """Rows that ``make`` (ids, hashes, row of each, begin and size of each row's set) returns as arrays, for slices of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            data, offsets = string_bytes(batch.column(1))
            for a, b in slices(offsets, WIDE_SLICE):
                h, doc, begin, size = shingle_sets(Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
                if len(h):
                    made = make(ids[a:b], h, doc, begin, size)
                    yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return df.select(F.col(doc_id).cast("long"), F.col(text)).where(F.col(doc_id).isNotNull()).mapInArrow(lean(run), schema)


def shingle_arrays(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, shingles array<long>): distinct five-word shingles; rows without words or id are left out."""
    return _sets(df, doc_id, text, "id long, shingles array<long>", lambda ids, h, doc, begin, size: {
        "id": pa.array(ids[doc[begin]]), "shingles": pa.ListArray.from_arrays(pa.array(np.append(begin, len(h)), pa.int32()), pa.array(h.view(np.int64)))})


def _frequent(df: DataFrame, doc_id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their counts in a sample of the documents."""
    parts = max(1, df.count() // SAMPLED_DOCS)
    sample = shingle_arrays(df.where(F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(parts)) == 0), doc_id, text)
    counts = sample.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = np.asarray(top.column("h").combine_chunks()).view(np.uint64), np.asarray(top.column("n").combine_chunks())
    order = np.argsort(h)
    return h[order], n[order]


def shared_shingles(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, id, n, at): those of a row's rarest shingles that other rows may have among theirs.

    All sets (n shingles) are sorted alike, rare shingles first. By the prefix filter two sets within the similarity t share a shingle
    among the first n - ceil(t n) + 1 of both, and, of the smaller set, among the first n - ceil(2 t / (1 + t) n) + 1; ``at`` is its
    place. Shingles that no other row has there are left out.
    """
    top, under = SIMILAR
    frequent = df.sparkSession.sparkContext.broadcast(_frequent(df, doc_id, text))
    cells = pieces(text_bytes(df, text) // 24, SHARED_ROWS, 32)

    def make(ids, h, doc, begin, size):
        own, counts = frequent.value
        count = np.zeros(len(h), np.int64)
        if len(own):
            where = np.minimum(np.searchsorted(own, h), len(own) - 1)
            count = np.where(own[where] == h, counts[where], 0)
        order = np.lexsort((h, count, doc))
        n, at = np.repeat(size, size), np.arange(len(h)) - np.repeat(begin, size)
        keep = under * (n - at) >= top * n
        return {"token": pa.array(h[order][keep].view(np.int64)), "id": pa.array(ids[doc[keep]]), "n": pa.array(n[keep], pa.int32()), "at": pa.array(at[keep], pa.int32()), "often": pa.array(count[order][keep] > 0)}

    schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])

    def several(table: pa.Table) -> pa.Table:
        token, often = (np.asarray(table.column(c).combine_chunks().cast(pa.int64())) for c in ("token", "often"))
        order = np.argsort(token, kind="stable")
        same = np.diff(token[order]) == 0
        keep = np.empty(len(token), bool)
        keep[order] = np.append(same, False) | np.append(False, same)
        return table.select(schema.names).filter(pa.array(keep | (often > 0))).cast(schema)

    # frequent shingles have other rows, so theirs needn't meet and are spread
    rows = _sets(df, doc_id, text, "token long, id long, n int, at int, often boolean", make)
    rows = rows.withColumn("cell", F.pmod(F.when(F.col("often"), F.xxhash64("token", "id")).otherwise(F.col("token")), F.lit(cells)))
    return rows.groupBy("cell").applyInArrow(several, "token long, id long, n int, at int")


def _smaller(n: str, at: str) -> str:
    """Whether a shingle is among those that the smaller set of a pair has to share."""
    return f"({sum(SIMILAR)}L * ({n} - {at}) >= {2 * SIMILAR[0]}L * {n})"


def _possible(x: str, y: str) -> str:
    """Whether two sets that share this shingle as their first can be similar."""
    return f"{sum(SIMILAR)}L * least({x}.n - {x}.at, {y}.n - {y}.at) >= {SIMILAR[0]}L * ({x}.n + {y}.n)"


def all_pairs(shared: DataFrame, sketch: DataFrame) -> DataFrame:
    """(a, b): pairs of different components (``root``) that may be similar, also by their sketches, from rows (token, id, n, at, root).

    The rows of a token meet in parts of at most about GROUP_ROWS rows of each side: those that may be the smaller set of a pair are
    dealt out one way and all rows the other way, and each part of the one meets each part of the other. None is dropped.
    """
    top, under = SIMILAR
    sizes = shared.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum(F.expr(f"int({_smaller('n', 'at')})")).alias("s"), (F.min("root") < F.max("root")).alias("open")).where("open AND s > 0")
    limit = F.lit(GROUP_ROWS)
    names = [f"s{k}" for k in range(SKETCH_WORDS)]
    own = checkpointed(shared.join(sketch.select(F.col("id"), F.col("n").cast("int").alias("n"), *names).distinct(), ["id", "n"]).join(sizes.select("token", F.ceil(F.col("s") / limit).alias("us"), F.ceil(F.col("m") / limit).alias("vs")), "token"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    x = own.where(_smaller("n", "at")).select("*", F.lit(True).alias("small"), deal("us").alias("u"), F.explode(F.expr("sequence(0L, vs - 1)")).alias("v"))
    y = own.select("*", F.lit(False).alias("small"), F.explode(F.expr("sequence(0L, us - 1)")).alias("u"), deal("vs").alias("v"))
    parts = x.unionByName(y)

    def join(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part, ids, n, at, root, small, *words = columns
        order = np.lexsort((ids, n, small, part))
        part, ids, n, at, root, small = (v[order] for v in (part, ids, n, at, root, small))
        bits = np.stack(words, axis=1)[order].view(np.uint64)
        big = np.flatnonzero(small == 0)
        little = np.flatnonzero(small)
        lo, hi = np.searchsorted(part[big], part[little], "left"), np.searchsorted(part[big], part[little], "right")
        ends = np.cumsum(hi - lo)
        i = 0
        while i < len(little):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_A_TIME, "right")))
            each = hi[i:j] - lo[i:j]
            p = np.repeat(little[i:j], each)
            q = big[np.repeat(lo[i:j], each) + np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each)]
            ok = (root[p] != root[q]) & (n[p] <= n[q]) & (under * n[p] >= top * n[q]) & ((top + under) * np.minimum(n[p] - at[p], n[q] - at[q]) >= top * (n[p] + n[q]))
            p, q = p[ok], q[ok]
            ok = (top + under) * np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) <= (under - top) * (n[p] + n[q])
            p, q = ids[p[ok]], ids[q[ok]]
            if len(p):
                pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ascend by part; whole parts are joined as soon as CELL_ROWS rows of them are there, and no more are held."""
        held = None
        for batch in batches:
            own = [np.asarray(batch.column(k).cast(pa.int64())) for k in range(batch.num_columns)]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            if len(held[0]) >= CELL_ROWS and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield from join([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from join(held)

    rows = parts.select(F.xxhash64("token", "u", "v").alias("part"), "id", "n", "at", "root", "small", *names)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(lean(run), "a long, b long").distinct()


def _sent(df: DataFrame) -> DataFrame:
    """df, which is at hand, broadcast if it has no more than BROADCAST_ROWS rows (of numbers)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _long_sketches(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """Parity bits of each set, as many as the next power of two from its size on, as 64-bit words; none for a set that SKETCH_WORDS
    words serve as well. The bits of half as many are those of both halves, added up without carry."""
    power = np.int64(1) << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    bits = np.where(size > 64 * SKETCH_WORDS, power, 0)
    ends = np.cumsum(bits)
    row = np.repeat(np.arange(len(size)), size)
    own = bits[row] > 0
    place = (mix64(h[own] ^ np.uint64(4)) & (bits[row[own]] - 1).view(np.uint64)).astype(np.int64) + (ends - bits)[row[own]]
    odd = (np.bincount(place, minlength=int(ends[-1])) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends // 64), pa.int32()), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def sketches(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, d, e, s0 …, wide): of each row's set of five-word shingles its size, a digest of 128 bits, and SKETCH_WORDS words of bits,
    each bit the parity of the shingles that hash to it; ``wide`` has more of them for larger sets. Rows without words or id are left
    out."""
    names = [f"s{k}" for k in range(SKETCH_WORDS)]

    def make(ids, h, doc, begin, size):
        d, e = (np.add.reduceat(mix64(h ^ np.uint64(salt)), begin).view(np.int64) for salt in (1, 2))
        place = mix64(h ^ np.uint64(3))
        bit, word = np.uint64(1) << (place & np.uint64(63)), (place >> np.uint64(32)) % np.uint64(SKETCH_WORDS)
        words = {c: pa.array(np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begin).view(np.int64)) for k, c in enumerate(names)}
        return {"id": pa.array(ids[doc[begin]]), "n": pa.array(size, pa.int64()), "d": pa.array(d), "e": pa.array(e)} | words | {"wide": _long_sketches(h, begin, size)}

    return _sets(df, doc_id, text, "id long, n long, d long, e long, " + ", ".join(f"{c} long" for c in names) + ", wide array<long>", make)


def near_by_sketch(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Those pairs (a, b) that may be similar by their sketches: two sketches differ in no more bits than the sets in shingles, so a
    pair whose bits exceed the budget of shingles isn't similar. Few bits say nothing about large sets, so the pairs that are left are
    judged by their long sketches too; of two sets that may be similar one has at most twice as many bits there, and is folded."""
    names = [f"s{k}" for k in range(SKETCH_WORDS)]
    x, y = (sketch.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), F.array(*names).alias(f"{c}s")) for c in "ab")
    apart = sum((F.bit_count(F.get("as", F.lit(k)).bitwiseXOR(F.get("bs", F.lit(k)))) for k in range(SKETCH_WORDS)), F.lit(0))
    budget = (SIMILAR[1] - SIMILAR[0]) * (F.col("an") + F.col("bn"))
    near = pairs.join(x, "a").join(y, "b").where(sum(SIMILAR) * apart <= budget).where(SIMILAR[1] * F.least("an", "bn") >= SIMILAR[0] * F.greatest("an", "bn")).select("a", "b", "an", "bn")
    large = sketch.where(F.size("wide") > 0)
    for c in "ab":
        near = near.join(large.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), F.col("wide").alias(f"{c}l")), [c, f"{c}n"], "left")
    m = F.least(F.size("al"), F.size("bl"))
    word = lambda i: reduce(lambda x, y: x.bitwiseXOR(y), [F.coalesce(F.get(c, k), F.lit(0).cast("long")) for c in ("al", "bl") for k in (i, i + m)])
    apart = F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0), lambda s, i: s + F.bit_count(word(i)))
    return near.where(F.col("al").isNull() | F.col("bl").isNull() | (sum(SIMILAR) * apart <= budget)).select("a", "b").distinct()


def similar(df: DataFrame, pairs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Those pairs (a, b) whose sets of five-word shingles have a Jaccard similarity of SIMILAR at least, by the sets themselves.

    Only texts of the pairs travel, and as texts: a set takes three times the bytes.
    """
    ids = checkpointed(pairs.select(F.col("a").alias("__i")).union(pairs.select("b")).distinct())
    texts = df.select(F.col(doc_id).cast("long").alias("__i"), F.col(text).alias("__x")).join(_sent(ids), "__i", "left_semi")
    both = pairs.join(texts.withColumnRenamed("__x", "x"), F.col("a") == F.col("__i")).drop("__i").join(texts.withColumnRenamed("__x", "y"), F.col("b") == F.col("__i")).drop("__i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [string_bytes(batch.column(k)) for k in (2, 3)]
            for a, b in slices(sides[0][1] + sides[1][1], WIDE_SLICE):
                sets = [shingle_sets(Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))[:2] for data, offsets in sides]
                sizes = np.bincount(np.concatenate([doc for _, doc in sets]), minlength=b - a)
                h, doc = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                common = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=b - a)
                ok = (sum(SIMILAR) * common >= SIMILAR[0] * sizes) & (sizes > 0)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long").distinct()


def similar_links(df: DataFrame, known: DataFrame, sketch: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b), ``known`` ones included, that connect all pairs of rows whose sets of five-word shingles are similar.

    Every link besides the known ones is a pair that ``similar`` has verified. First the rows of each shared shingle are compared with
    one of them, in rounds with another one each, so that large clusters are linked by few comparisons; then all pairs are that share
    one and aren't connected yet.
    """
    shared, links_ = staged(shared_shingles(df, doc_id, text), "shared"), checkpointed(known)
    for k in range(STAR_ROUNDS + 1):
        roots = connected(links_)
        shared = shared.drop("root").join(_sent(checkpointed(roots.withColumnRenamed("node", "id"))), "id", "left").withColumn("root", F.coalesce("root", "id"))
        tokens = shared.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max(F.expr(_smaller("n", "at"))).alias("any")).where("r < s AND any").select("token")
        shared = staged(shared.join(tokens, "token", "left_semi"), "shared")
        if shared.isEmpty():
            break
        if k < STAR_ROUNDS:
            pivot = shared.where(_smaller("n", "at")).groupBy("token").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "at", "root")).alias("p"))
            pairs = shared.withColumn("q", F.struct("n", "at")).join(pivot, "token").where(f"root <> p.root AND {_possible('p', 'q')} AND {SIMILAR[1]}L * least(n, p.n) >= {SIMILAR[0]}L * greatest(n, p.n)")
            pairs = pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
        else:
            pairs = all_pairs(shared, sketch)
        found = similar(df, checkpointed(near_by_sketch(pairs, sketch)), doc_id, text)
        links_ = checkpointed(roots.toDF("a", "b").unionByName(found))  # the stars of what is linked connect the same
        release(df.sparkSession)
    return links_


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id) of the rows whose texts are copies or near copies of others: fingerprints link as in near_groups, and so do
    all pairs whose sets of five-word shingles have a Jaccard similarity of at least SIMILAR, compared exactly.

    component_id is the smallest id reachable. Rows that nothing links, and rows with a null id, are left out.
    """
    narrow = near_groups(df, doc_id, text).where(f"`{doc_id}` <> component_id").select(F.col(doc_id).alias("a"), F.col("component_id").alias("b"))

    # equal sets of any number are linked beforehand
    sets = checkpointed(sketches(df, doc_id, text))
    release(df.sparkSession)
    classes = sets.groupBy("n", "d", "e").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    same = sets.join(classes, ["n", "d", "e"]).where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    return connected(similar_links(df, narrow.unionByName(same), sets.drop("d", "e"), doc_id, text)).select(F.col("node").alias(doc_id), F.col("root").alias("component_id"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
