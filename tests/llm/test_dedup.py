"""Exact dedup, SimHash and substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecloom.llm import exact_dedup, simhash, substring_dedup


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_exact(data):
    norm = {}
    for i, t in data:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in norm.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_exact_groups(frame, corpus):
    got = exact_dedup.exact_groups(frame(corpus))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(corpus)


def test_exact_groups_with_colliding_digests(frame, corpus):
    weak = lambda norm: F.concat(F.substring(F.sha2(norm, 256), 1, 1), F.lit("0" * 63))
    assert sorted(map(tuple, exact_dedup.exact_groups(frame(corpus), digest=weak).collect()), key=str) == brute_exact(corpus)


def test_exact_groups_odd_rows(frame):
    data = [(None, "a"), (3, "a"), (3, "a"), (None, "b b"), (None, "b  b"), (7, None), (8, ""), (9, "lone")]
    assert sorted(map(tuple, exact_dedup.exact_groups(frame(data)).collect()), key=str) == brute_exact(data)
    assert exact_dedup.exact_groups(frame([])).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1 << 17])
def test_exact_groups_of_null_ids_that_collide(frame, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", broadcast)
    data = [(None, "a"), (None, "b"), (None, "b"), (4, "b"), (4, "c"), (4, "c  d"), (5, "c d")]
    same = lambda norm: F.when(norm.isNotNull(), F.lit("0" * 64))
    assert sorted(map(tuple, exact_dedup.exact_groups(frame(data), digest=same).collect()), key=str) == brute_exact(data)


def test_hundreds_of_runs(frame, corpus, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 1)
    data = [(3 * i, f"text {i % 400}") for i in range(900)] + [(3 * i + 1, f"lone {i}") for i in range(100)] + corpus
    rows = frame(data, 6)
    assert sorted(map(tuple, exact_dedup.exact_groups(rows).collect()), key=str) == brute_exact(data)


def fingerprint(t, k=3):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, ids, budget=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash(frame, corpus):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(frame(corpus)).collect()}
    ids, prints = [i for i, _ in corpus], [fingerprint(t) for _, t in corpus]
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, components(prints, ids), strict=True)}


def test_simhash_odd_rows(frame):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(frame([(None, "x y z"), (5, "x  Y z"), (5, "x y z"), (None, "lone words here"), (9, None), (4, " ")])).collect()), key=str)
    assert got == sorted([(4, 4), (5, 5), (5, 5), (9, 4), (None, 5), (None, None)], key=str)
    assert simhash.near_groups(frame([])).count() == 0


@pytest.mark.parametrize("limit", [8192, 60])
def test_links_connect_what_is_near(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
    r = np.random.default_rng(1)
    prints = set()
    for centre in r.integers(0, 2**63, 30).tolist():
        for _ in range(12):
            x = centre
            for b in r.integers(0, 64, r.integers(0, 5)).tolist():
                x ^= 1 << b
            prints.add(x if limit > 1000 else x & ~(0xFFFF << 48) | 0x0123 << 48)
    prints = sorted(prints)
    roots = {x.node: x.root for x in simhash.connected(simhash.links(spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint long"))).collect()}
    want = components(prints, prints)
    found = {}
    for p, w in zip(prints, want, strict=True):
        s = int(np.uint64(p).view(np.int64))
        found.setdefault(roots.get(s, s), set()).add(w)
    assert all(len(x) == 1 for x in found.values()) and len(found) == len(set(want))


def test_keys_are_longer_for_more_fingerprints():
    r = np.random.default_rng(8)
    sizes = []
    for n in (10**3, 10**8, 10**9, 10**10, 10**12, 10**15):
        masks = simhash._keys(n, 3)
        sizes.append(min(bin(m).count("1") for m in masks))
        for _ in range(300):
            apart = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            assert any(apart & m == 0 for m in masks)
    assert sizes == sorted(sizes) and sizes[0] == 16 and len(simhash._keys(10**10, 3)) <= 20 and sizes[3] >= 24


def test_links_by_longer_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_keys", lambda n, budget, own=simhash._keys: own(10**11, budget))
    r = np.random.default_rng(9)
    prints = {int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)) for c in r.integers(0, 2**63, 40) for _ in range(8)}
    prints = sorted(prints)
    roots = {x.node: x.root for x in simhash.connected(simhash.links(spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint long"))).collect()}
    found = {}
    for p, w in zip(prints, components(prints, prints), strict=True):
        q = int(np.uint64(p).view(np.int64))
        found.setdefault(roots.get(q, q), set()).add(w)
    assert all(len(x) == 1 for x in found.values()) and len(found) == len(set(components(prints, prints)))


def test_trie_join_is_all_pairs():
    r = np.random.default_rng(2)
    prints = np.unique(r.integers(0, 2**12, 300, dtype=np.uint64) << np.uint64(20))
    label = simhash.trie_join(prints, 2)
    assert [int(prints[i]) for i in label] == components(prints.tolist(), prints.tolist(), 2)


def test_trie_join_of_wide_prints_is_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (12, 2), dtype=np.uint64)
    rows = {tuple(int(x) ^ int(y) for x, y in zip(b, f, strict=True)) for b in base for f in (np.uint64(1) << r.integers(0, 64, (25, 2), dtype=np.uint64))}
    rows |= {(a, b ^ 6) for a, b in rows}
    rows = sorted(rows)
    label = simhash.trie_join(np.array(rows, np.uint64), 3)
    flat = [(a << 64) | b for a, b in rows]
    assert [flat[i] for i in label] == components(flat, flat, 3)


def test_sketches_drop_no_similar_pair(spark, frame):
    r = np.random.default_rng(6)
    data = []
    for k in range(60):
        base = [f"w{x}" for x in r.integers(0, 2000, int(r.integers(1, 200)))]
        near = [w if r.random() > 0.03 else "other" for w in base]
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    sets = {i: shingle_set(t) for i, t in data}
    every = [(a, b) for a in sets for b in sets if a < b]
    kept = {(x.a, x.b) for x in simhash.near_by_sketch(spark.createDataFrame(every, "a long, b long"), simhash.sketches(frame(data))).collect()}
    want = {(a, b) for a, b in every if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0}
    assert want <= kept and len(want) > 10 and len(kept) < 0.2 * len(every)
    assert {(x.a, x.b) for x in simhash.similar(frame(data), spark.createDataFrame(sorted(kept), "a long, b long")).collect()} == want


def test_long_sketches_part_large_sets_and_drop_no_similar_pair(spark, frame):
    r = np.random.default_rng(8)
    data, near, far = [], set(), set()
    for k, n in enumerate((513, 700, 1020, 1030, 2049, 5000, 20_000)):
        base = [f"w{x}" for x in r.integers(0, 10**6, n)]
        for j, share in enumerate((0.0, 0.02, 0.08)):
            t = [w if r.random() >= share else f"new{r.integers(0, 10**9)}" for w in base]
            data.append((10 * k + j, " ".join(t[:int(n * (1 if j == 2 else 0.92 if j else 1))])))
        near.add((10 * k, 10 * k + 1))
        far.add((10 * k, 10 * k + 2))
    sets = {i: shingle_set(t) for i, t in data}
    every = [(a, b) for a in sets for b in sets if a < b]
    want = {(a, b) for a, b in every if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    kept = {(x.a, x.b) for x in simhash.near_by_sketch(spark.createDataFrame(every, "a long, b long"), simhash.sketches(frame(data))).collect()}
    assert want <= kept and want and want <= near and not kept & far and len(kept) <= len(near)


@pytest.mark.parametrize("limit", [8192, 20])
def test_near_copies(frame, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
    r = np.random.default_rng(4)
    data, cluster = [], {}
    for c in range(12):
        base = [f"w{x}" for x in r.integers(0, 5000, 400)]
        for _ in range(60 if c == 0 else 4):
            t = list(base)
            for at in r.integers(0, 400, 4):
                t[at] = f"new{r.integers(0, 10**6)}"
            cluster[len(data)] = c
            data.append((len(data), " ".join(t)))
    low = {c: min(i for i, x in cluster.items() if x == c) for c in cluster.values()}
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(data + [(None, data[0][1]), (10**6, data[5][1].upper()), (10**6, data[5][1]), (10**7, "alone"), (10**7 + 1, None), (10**7 + 2, " ")])).collect()}
    assert got == {i: low[c] for i, c in cluster.items()} | {10**6: 0, 10**7 + 1: 10**7 + 1, 10**7 + 2: 10**7 + 1}
    assert simhash.near_copies(frame([])).count() == 0


def shingle_set(t, k=5):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_copies_by_all_pairs(data):
    """Components over the narrow links and all pairs with a Jaccard similarity of 0.8 at least."""
    prints, sets = [fingerprint(t) for _, t in data], [shingle_set(t) for _, t in data]
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = [i for i, _ in data]
    low = {c: min(i for i, x in zip(ids, label, strict=True) if x == c) for c in label}
    return {i: low[c] for i, c in zip(ids, label, strict=True) if label.count(c) > 1}


def template_source(r, texts, edits):
    """Texts of one template, each with its own edits: a hot source."""
    base = [f"t{x}" for x in range(300)]
    out = []
    for _ in range(texts):
        t = list(base)
        for at in r.choice(300, edits, replace=False):
            t[at] = f"new{r.integers(0, 10**9)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("limit", "rounds"), [(4, 0), (8192, 3)])
def test_near_copies_of_a_hot_source_are_whole_whatever_its_size(frame, monkeypatch, limit, rounds):
    monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
    monkeypatch.setattr(simhash, "STAR_ROUNDS", rounds)
    r = np.random.default_rng(5)
    data = list(enumerate(template_source(r, 60, 4) + template_source(r, 40, 7)))
    for i, t in data[60:80]:  # partners at 0.8 or a little more
        w = t.split(" ")
        for at in r.choice(300, 6, replace=False):
            w[at] = f"own{i}x{at}"
        data.append((i + 1000, " ".join(w)))
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(data)).collect()}
    assert got == near_copies_by_all_pairs(data)


def brute_removed(data, size=13):
    first = {}
    for i, t in data:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k:k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in data:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                keep[k:k + size] = [False] * size
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [13, 5])
def test_substring_dedup(frame, corpus, size):
    data = corpus + [(None, corpus[10][1]), (50, corpus[12][1]), (50, corpus[12][1]), (2**40, corpus[30][1])]
    assert sorted(map(tuple, substring_dedup.remove_repeats(frame(data), window=size).collect()), key=str) == brute_removed(data, size)


@pytest.mark.parametrize("data", [
    [(1, " ".join(f"a{i}" for i in range(20)))], [(1, " ".join(f"a{i}" for i in range(20))), (2, " ".join(f"b{i}" for i in range(30)))],
    [(1, " ".join(["again"] * 60))], [(2, " ".join(f"a{i}" for i in range(20))), (1, " ".join(f"a{i}" for i in range(20)))],
    [(7, " ".join(f"a{i}" for i in range(20)))] * 3 + [(7, " ".join(f"c{i}" for i in range(20))), (None, " ".join(f"c{i}" for i in range(20)))], [(1, None)], []])
def test_substring_dedup_of_few_rows(frame, data):
    assert sorted(map(tuple, substring_dedup.remove_repeats(frame(data)).collect()), key=str) == brute_removed(data)


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_substring_dedup_tells_regular_words_apart(frame):
    """Thue-Morse words collide under any polynomial hash modulo a power of two, as letters of a word and as words of a window."""
    start = [f"s{i}" for i in range(12)]
    x, y = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    data = [(1, " ".join([*start, x])), (2, " ".join([*start, y])), (3, " ".join(thue_morse(4096, "a", "b"))), (4, " ".join(start + thue_morse(4096, "b", "a")))]
    assert sorted(map(tuple, substring_dedup.remove_repeats(frame(data)).collect()), key=str) == brute_removed(data)
    assert sorted(map(tuple, substring_dedup.remove_repeats(frame(data), window=16).collect()), key=str) == brute_removed(data, 16)


def test_substring_dedup_by_merged_runs(frame, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FAN", 4)
    monkeypatch.setattr(substring_dedup, "HELD_KEYS", 2000)
    data = corpus + [(None, corpus[10][1]), (50, corpus[12][1]), (50, corpus[12][1]), (2**40, corpus[30][1])]
    assert sorted(map(tuple, substring_dedup.remove_repeats(frame(data)).collect()), key=str) == brute_removed(data)


def test_digests_have_two_halves():
    from vecloom.llm import kernel

    words = kernel.Words(np.frombuffer(b"a b c d", np.uint8), np.array([0, 7]))
    first, second = words.digests()
    assert len(set(first.tolist())) == len(set(second.tolist())) == 4 and not set(first.tolist()) & set(second.tolist())
    run = {"key": np.array([5, 5, 5, 9], np.uint64), "rest": np.array([1, 1, 2, 2], np.uint64)}
    assert substring_dedup._groups(run).tolist() == [0, 2, 3]
