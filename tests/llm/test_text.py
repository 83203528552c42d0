"""Tokenising, language ID, quality, personal data and decontamination."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from vecloom.llm import byte_bpe, decontaminate, language_id, pii, quality
from vecloom.llm.kernel import Words, crc_mod, string_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(frame, corpus, reference):
    rows = byte_bpe.encode_decode(frame(corpus), RANKS, public_tokenizers.PATTERN).collect()
    texts = dict(corpus)
    assert len(rows) == len(corpus)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids), packed, hashlib.sha256(packed).hexdigest())
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()


def test_byte_bpe_of_odd_characters(reference):
    r = random.Random(1)
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x800), r.randrange(0x2000, 0x3000), 0x1F600, 10, 32])) for _ in range(40)) for _ in range(500)] + ["<|endoftext|>", "a" * 30_000]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == reference.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_offsets_hold_split_characters():
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    text = "né 😀𓀀 x"
    ids = own.encode([text])[0]
    spans = own.offsets(text, ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b for a, b in spans)
    assert all(text[a:b].encode().find(own.tokens[i]) >= 0 for i, (a, b) in zip(ids, spans, strict=True))


def test_no_documents(frame):
    assert byte_bpe.encode_decode(frame([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_language_id_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 50").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_id_odd_rows(spark):
    data = [(i, " ".join(["hello world this is text"] * 3), "en") for i in range(20)] + [(20 + i, "guten tag das ist ein text über öl", "de") for i in range(20)] + [(90, None, "en"), (91, "", None), (92, "123 !? \u00a0", "en"), (None, "hello world", "en"), (93, "Привет", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, language_id.train(df)).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0) and got[None][0] == got[3][0] == "en" and got[25][0] == "de" and got[93][0] in ("en", "de")
    empty = language_id.train(df.where("false"))
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"} and language_id.identify(df.where("false"), empty).count() == 0


def brute_grams(t, whole=True):
    """n-grams of 2 to 4 bytes of the lower-cased text, other ASCII than letters being spaces, that touch a word and don't go over its edge by more than one."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (t or "").encode())
    return [raw[i:i + k] for k in (2, 3, 4) for i in range(len(raw) - k + 1) if 32 not in raw[i + 1:i + k - 1] and raw[i:i + k].strip(b" ")
            and not (raw[i] == 32 and raw[i + k - 1] == 32)]


def test_language_id_is_that_of_plain_sets(spark, frame, corpus):
    r = random.Random(3)
    words = {"xx": ["kal", "mira", "toro", "öst", "ne"], "yy": ["kal", "bent", "zu", "orp", "Ä"], "zz": ["q", "wimp", "tor", "alle"]}
    text = lambda k: " ".join(r.choice(words[k]) for _ in range(30)) + "".join(r.choice(" abc!1") for _ in range(8))
    data = [(i, text(k), k) for i, k in enumerate(["xx"] * 60 + ["yy"] * 50 + ["zz"] * 40)] + [(500 + j, t, None) for j, (_, t) in enumerate(corpus)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("id", "gram", "docs", "h", "score")})
    model = language_id.train(df)
    import zlib

    sets, sizes = {}, {}
    for k in words:
        learnt = [t for i, t, x in data if x == k and zlib.crc32(str(i).encode()) % 5]
        docs = Counter(g for t in learnt for g in set(brute_grams(t)))
        sets[k], sizes[k] = {g for g, n in docs.items() if n >= 2}, len(learnt)
    own = {k: {int.from_bytes(g, "big") for g in v} for k, v in sets.items()}
    for j, k in enumerate(model.languages):
        every = np.array(sorted(set().union(*own.values())), np.uint64)
        held = (model.answer(every)[:, 0] >> np.uint64(j) & np.uint64(1)).astype(bool)
        assert own[k] <= set(every[held].tolist())  # and little else
        assert held.sum() - len(own[k]) <= 0.02 * len(every) + 2
    for x in language_id.identify(df, model).collect():
        t = next(t for i, t, _ in data if i == x.doc_id)
        grams = brute_grams(t)
        share = {k: sum(g in sets[k] for g in grams) / max(1, len(grams)) for k in words}
        if not any(c.isalpha() for c in t or ""):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            best = max(share.values())
            assert share[x.lang_pred] >= best - 0.02 and abs(x.score - share[x.lang_pred]) < 0.03


def test_language_id_of_rare_rows(spark):
    data = [(None, "alpha beta gamma", "en")] * 50 + [(1, "alpha beta gamma", "en")] * 5 + [(7, "delta eps", "fr"), (8, "delta eps", "fr"), (9, "x" * 3_000_000 + " alpha beta", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.train(df)).collect()
    assert len(got) == len(data) and {r.score for r in got if r.doc_id == 1} == {next(r.score for r in got if r.doc_id is None)}
    flags = language_id.lettered(*string_bytes(pa.array(["", "1 2", "é", "٣", "日本", "a", "…"])))
    assert flags.tolist() == [False, False, True, False, True, True, False]


def test_sliced_filter_answers_all_languages():
    r = np.random.default_rng(0)
    sets = {f"l{i:02}": r.integers(0, 2**40, 200, dtype=np.uint64) for i in range(70)}
    own = language_id.SlicedFilter(sets, slots=1 << 16)
    for i, name in enumerate(own.languages):
        assert (own.answer(sets[name])[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    share, total = own.counts(sets["l03"], np.zeros(200, np.int64), 1)
    assert total[0] == 200 and share[0].argmax() == own.languages.index("l03") and np.sort(share[0])[-2] < 0.2


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_odd_rows(spark, frame, corpus):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in corpus] + [(corpus[0][0], 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    chain = quality.train(frame(corpus), labels)
    got = quality.score(frame(corpus + [(None, "x\n\ny\n"), (1, "\n"), (1, "\n")]), chain).collect()
    assert len(got) == len(corpus) + 3 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.score for r in quality.score(frame(corpus), quality.train(frame(corpus), labels.where("quality = 1"))).collect()} == {0.999}
    assert quality.score(frame([]), quality.train(frame([]), labels.where("false"))).count() == 0
    kept = quality.keep_good(frame(corpus), chain)
    assert kept.columns == frame(corpus).columns and kept.count() == sum(r.predicted for r in quality.score(frame(corpus), chain).collect())


@pytest.mark.parametrize("block", [256, 2, 1])
def test_chain_marginals_are_those_of_all_paths(monkeypatch, block):
    monkeypatch.setattr(quality, "CHAIN_LINES", block)
    r = np.random.default_rng(3)
    chain = quality.Chain(np.ones(1), r.normal(size=(2, 2)))
    z, first = r.normal(size=14), np.array([0, 4, 5, 7, 14])
    got, pairs = chain.marginals(z, first, pairs=True)
    expected = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        weights, joint = np.zeros((b - a, 2)), np.zeros((2, 2))
        for path in np.ndindex(*[2] * (b - a)):
            s = np.exp(sum(z[a + t] * path[t] for t in range(b - a)) + sum(chain.transitions[p, q] for p, q in zip(path[:-1], path[1:], strict=True)))
            for t, p in enumerate(path):
                weights[t, p] += s
            for p, q in zip(path[:-1], path[1:], strict=True):
                joint[p, q] += s
        expected += joint / weights[0].sum()
        assert np.allclose(got[a:b], weights[:, 1] / weights.sum(axis=1))
    assert np.allclose(pairs, expected)


def brute_features(text):
    """Features of each line of a text, by its characters' bytes."""
    raw = (text or "").encode()
    lines = raw.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    split = [re.findall(rb"[^\x20\x09-\x0D]+", x) for x in lines]
    own = []
    for x, w in zip(lines, split, strict=True):
        size, some = max(1, len(x)), max(1, len(w))
        lower, upper, digit = (sum(a <= c <= b for c in x) for a, b in ((97, 122), (65, 90), (48, 57)))
        other, space, pipe, point = sum(c >= 128 for c in x), sum(c in b" \t\n\x0b\x0c\r" for c in x), x.count(b"|"), sum(c in b".,;:'\"()-?" for c in x)
        symbol = len(x) - lower - upper - digit - other - space - pipe - point
        own.append([1, np.log1p(len(x)) / 5, upper / max(1, lower + upper + other), digit / size, min(1, 8 * pipe / size), min(1, 4 * symbol / size), min(1, 4 * x.count(b"!") / size),
                    (size - space) / some / 10, sum(p == q for p, q in zip(w, w[1:], strict=False)) / some, other / size, point / some, bool(w) and split.count(w) > 1, len(w) <= 1, 1 - len(set(w)) / some])
    blank = [0] * quality.OWN
    return [len(x) for x in lines], [[*o, *(own[i - 1] if i else blank), *(own[i + 1] if i + 1 < len(own) else blank)] for i, o in enumerate(own)]


def brute_score(text, chain):
    sizes, features = brute_features(text)
    z, step = [float(np.dot(f, chain.weights)) for f in features], np.exp(chain.transitions)
    z = np.clip(z, -600, 600).tolist()
    alpha, beta = [np.exp([0, z[0]])], [np.ones(2)]
    for x in z[1:]:
        a = np.exp([0, x]) * (alpha[-1] @ step)
        alpha.append(a / a.sum())
    for x in z[:0:-1]:
        b = step @ (np.exp([0, x]) * beta[0])
        beta.insert(0, b / b.sum())
    good = [(a * b)[1] / (a * b).sum() for a, b in zip(alpha, beta, strict=True)]
    mean = np.clip(sum((s + 1e-3) * g for s, g in zip(sizes, good, strict=True)) / sum(s + 1e-3 for s in sizes), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-np.clip(chain.slope * np.log(mean / (1 - mean)) + chain.offset, -30, 30)))


def test_quality_scores_are_those_of_brute_force(frame, corpus, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_LINES", 7)
    monkeypatch.setattr(quality, "CHAIN_LINES", 5)
    r = np.random.default_rng(8)
    chain = quality.Chain(r.normal(size=3 * quality.OWN) / 3, r.normal(size=(2, 2)), 1.3, -0.2)
    odd = ["\n", "\n\n", "a\n\nb b\n", "\n".join(["same line", "other!!", "same  line", "x|y|z", "ÄÖ é", "1 2 3"] * 9), "no break", "\n" * 40 + "end"]
    data = corpus + list(enumerate(odd))
    want = [brute_score(t, chain) for _, t in data]
    got = {x.doc_id: x.score for x in quality.score(frame(data), chain).collect()}
    assert np.allclose([got[i] for i, _ in data], want, atol=1e-8)
    assert np.allclose(chain.scores(quality.Lines(*string_bytes(pa.array([t for _, t in data])))), want, atol=1e-8)


def test_many_line_breaks_take_little_memory():
    import tracemalloc

    text = np.full(2 << 20, 0x0A, np.uint8)
    chain = quality.Chain(np.ones(3 * quality.OWN), np.zeros((2, 2)))
    tracemalloc.start()
    chain.scores(quality.Lines(text, np.array([0, len(text)])))
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    count = lambda s: len(re.sub("[^0-9]", "", s))
    keep = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 12 <= count(s) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)), lambda s: 9 <= count(s) <= 15)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t or "") if keep[k](m.group()))


def test_base_spans():
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice(r.choice(["abz@@.", "0123456789.", "4 -", "+() .-09", "1.2.", "@a.b", "é\n٣ "])) for _ in range(r.randint(0, 50)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_find_pii(frame, corpus):
    secret = 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"'
    data = corpus + [(1, "mail a.b@x.example.com, ip 10.0.0.256 10.0.0.255 card 4111 1111 1111 1111 tel +1 (301) 555-0346"), (2, secret), (None, "é a@b.c"), (3, "a@b.c"), (3, "a@b.c"), (4, "version 12345678901234567890a")]
    model = pii.train(frame(data + [(10**6 + i, f"x {secret} y") for i in range(20)]))
    texts = dict(data)
    got = pii.find_pii(frame(data), model).collect()
    assert len(got) == len(data)
    for r in got:
        base = brute_pii(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    by = {r.doc_id: r for r in got}
    assert by[2].spans == "secret:9:49" and by[4].n_added == 0 and (by[1].n_email, by[1].n_ip, by[1].n_card, by[1].n_phone) == (1, 1, 1, 1)
    assert pii.find_pii(frame([]), pii.train(frame([]))).count() == 0


def brute_em(votes):
    """Posterior of every candidate by itself: two classes, independent labelers, beliefs worth PRIOR_VOTES votes."""
    belief = {-1: (0.5, 0.125), 0: (0.375, 0.375), 1: (0.125, 0.5)}
    q = [1 / (1 + np.exp(-1.5 * sum(v))) for v in votes]
    for _ in range(pii.ROUNDS):
        prior = (sum(q) + pii.PRIOR_VOTES / 2) / (len(q) + pii.PRIOR_VOTES)
        chance = [{(v, c): sum(p if c else 1 - p for x, p in zip(votes, q, strict=True) if x[j] == v) + pii.PRIOR_VOTES * belief[v][c] for v in belief for c in (0, 1)} for j in range(len(votes[0]))]
        total = [[sum(t[v, c] for v in belief) for c in (0, 1)] for t in chance]
        odds = [np.log(prior / (1 - prior)) + sum(np.log(t[v, 1] / n[1]) - np.log(t[v, 0] / n[0]) for v, t, n in zip(x, chance, total, strict=True)) for x in votes]
        q = [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds]
    return q


def test_votes_are_weighed_as_by_brute_force():
    r = random.Random(9)
    truth = [r.random() < 0.4 for _ in range(300)]
    right = (0.95, 0.8, 0.6, 0.55, 0.7, 0.9)
    votes = [tuple((1 if t == (r.random() < p) else -1) if r.random() < 0.8 else 0 for p in right) for t in truth]
    model = pii.aggregate_votes(Counter(f"4:1:{','.join(map(str, v))}" for v in votes))
    q = brute_em(votes)
    log = [np.log(model.reliability["secret"][np.arange(6), :, np.array(v) + 1]).sum(axis=0) for v in votes]
    prior = (sum(q) + pii.PRIOR_VOTES / 2) / (len(q) + pii.PRIOR_VOTES)
    assert np.allclose([1 / (1 + np.exp(-(x[1] - x[0] + np.log(prior / (1 - prior))))) for x in log], q, atol=1e-3)
    accepted = [model.probability(f"4:1:{','.join(map(str, v))}") >= pii.ACCEPT for v in votes]
    assert np.mean([a == (p >= 0.5) for a, p in zip(accepted, q, strict=True)]) > 0.95 and np.mean([a == t for a, t in zip(accepted, truth, strict=True)]) > 0.9


def test_added_spans_are_those_of_brute_force(frame):
    """The generator's spans outside the base ones, the earliest first, by a look at every pair of positions; those whose pattern is accepted."""
    r = random.Random(12)
    parts = ["key=" + "a1b2" * 9, "tok: " + "Zz9_" * 80, "joe (AT) site dot com", "joe[at]site (dot) com", "2001:db8::ff00:42:8329", "fe80:1:2:3:4:5:6:7", "4111 1111 1111 1112", "call 301 555-0346", "+1 301 555 0346", "a@b.c", "1.2.3.4", "plain words", "std::vector", "x" * 30]
    texts = [" ".join(r.choice(parts) for _ in range(6)) for _ in range(60)] + parts
    data = list(enumerate(texts))
    model = pii.train(frame(data))
    for row in pii.find_pii(frame(data), model).collect():
        t, base = texts[row.doc_id], brute_pii(texts[row.doc_id])
        every = [(a, kind, b) for kind, wide in pii._WIDE for a in range(len(t)) if (m := wide.match(t, a)) for b in (m.end(),)]
        every = [(a, k, b) for a, k, b in every if not any(x < b and a < y for x, _, y in base) and (k != 4 or (re.search("[0-9]", t[a:b]) and re.search("[A-Za-z]", t[a:b])))]
        free, added = -1, []
        for a, k, b in sorted(every):
            if a >= free:
                free = b
                pattern = f"{k}:{min(4, (b - a) // 12)}:" + ",".join(map(str, pii._votes(t, k, a, b)))
                added += [(a, k, b)] if model.probability(pattern) >= pii.ACCEPT else []
        assert row.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + added)), t
    kinds = {s.split(":")[0] for row in pii.find_pii(frame(data), model).collect() for s in row.spans.split(",")}
    assert {"secret", "email", "ip"} <= kinds


def test_long_texts_take_linear_time():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+" * 100_000, "+1" + "(" * 100_000, "@" * 100_000, "a@b." * 50_000):
        list(pii.candidates(t, pii.base_spans(t)))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination(spark, frame, corpus):
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(200)] + ["the"] * 40
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate([5, 6, 8, 12, 20, 35, 35, 50])] + [(90, "too short"), (91, None), (None, "a b c d e f g")]
    data = list(corpus)
    for k, t in items[:8]:
        w = t.split(" ")
        for e in range(0, len(w) // 5 + 3):
            x = list(w)
            for _ in range(e):
                p = r.randrange(len(x))
                x[p:p + r.choice([0, 1])] = [r.choice(vocabulary)] * r.choice([0, 1, 1])
                x = x or ["v1"]
            data.append((1000 + 50 * k + e, " ".join([r.choice(vocabulary) for _ in range(r.randint(0, 20))] + x + [r.choice(vocabulary) for _ in range(r.randint(0, 20))]).upper()))
    data += [(None, items[4][1]), (2000, items[5][1]), (2000, items[5][1]), (2001, "it is Too  short"), (2002, "too long or short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.distance, x.start_word) for x in decontaminate.leaks(frame(data), bench).collect()}
    want = {}
    for d, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for k, i in items:
            n = len((i or "").split())
            most = int(0.2 * n + 1e-9)
            if d is None or k is None or not n:
                continue
            own = Counter(i.split())
            for s in range(len(w)):
                x = w[s:s + n]
                # an edit changes the number of words in common by one at most
                if len(x) >= n - most and (own & Counter(x)).total() >= n - most and (e := levenshtein(x, i.split())) <= most:
                    want[d, k] = min(want.get((d, k), (99, 0)), (e, s))
    assert set(got) == set(want) and len(want) > 30 and any(n[1] == 90 for n in want)
    assert all(got[p][0] >= want[p][0] for p in got) and sum(got[p] != want[p] for p in want) <= 0.02 * len(want)
    assert decontaminate.leaks(frame([]), bench).count() == decontaminate.leaks(frame(data), bench.where("false")).count() == 0


@pytest.mark.parametrize("n", [5, 9, 15, 55, 130, 270, 502])
def test_every_window_at_the_largest_distance_is_found(n):
    r = random.Random(n)
    items = [[f"v{r.randrange(3000)}" for _ in range(n)] for _ in range(40)]
    most = decontaminate.edits_allowed(n, 0.8)
    texts = []
    for k, item in enumerate(items):
        w = list(item)
        moved = most // 2 if k % 2 else 0  # a deletion and an insertion each; the length stays
        for at in r.sample(range(n), most - 2 * moved):
            w[at] = "new"
        for _ in range(moved):
            del w[r.randrange(n)]
            w.insert(r.randrange(n), "more")
        texts.append(" ".join(["before"] * r.randrange(9) + w + ["after"] * n))
    held = decontaminate.Benchmark(list(range(40)), [" ".join(x) for x in items], 0.8)
    found = {(int(d), int(i)) for row, item, *_ in held.search(Words(*string_bytes(pa.array(texts)))) for d, i in zip(row, item, strict=True)}
    assert {(k, k) for k in range(40)} <= found


def found_in(texts, items, **settings):
    held = decontaminate.Benchmark(list(range(len(items))), items, 0.8, **settings)
    best = {}
    for row, item, dist, start, _ in held.search(Words(*string_bytes(pa.array(texts)), True)):
        for d, i, e, s in zip(row.tolist(), item.tolist(), dist.tolist(), start.tolist(), strict=True):
            best[d, i] = min(best.get((d, i), (e, s)), (e, s))
    return sorted((*p, *x) for p, x in best.items())


def test_long_items_and_long_lists_of_holders(monkeypatch):
    r = random.Random(4)
    items = [" ".join(f"v{r.randrange(5000)}" for _ in range(n)) for n in (1000, 10_000)]
    near = items[0].split(" ")
    near[100:200] = ["new"] * 100
    part = " ".join(items[1].split(" ")[:8100])  # what is left of the longer one at the end of a text
    assert found_in([part, "x y " + " ".join(near) + " z"], items) == [(0, 1, 1900, 0), (1, 0, 100, 2)]
    stock = [f"all of these items share this one line {k} a b c {k * 7}" for k in range(300)]
    texts = [" . ".join(stock[:40])] * 3 + [s + " and more" for s in stock[:20]]
    whole = found_in(texts, stock)
    monkeypatch.setattr(decontaminate, "EXPANDED", 100)
    monkeypatch.setattr(decontaminate, "COMPARED_WORDS", 1000)
    assert found_in(texts, stock) == whole and {(k, i) for k, i, e, _ in whole if not e} >= {(0, i) for i in range(40)} | {(3 + i, i) for i in range(20)}


def test_scripts_without_spaces_and_short_items():
    items = ["これは長い試験の文章です", "yes", "a b c", "", None]
    texts = ["前に。これは長い試験の文書です。後", "これは別の話", "yes he said", "A  b c", "a b d"]
    assert found_in(texts, items) == [(0, 0, 1, 3), (2, 1, 0, 0), (3, 2, 0, 0)]
    assert found_in(texts, items, least_words=5) == [(0, 0, 1, 3)]


def test_words_that_a_polynomial_hash_confuses():
    x, y = ("".join("ab"[bin(i).count("1") % 2 ^ f] for i in range(1024)) for f in (0, 1))
    start = [f"s{i}" for i in range(5)]
    assert found_in([" ".join(start + [y] * 7)], [" ".join(start + [x] * 7)]) == []


def test_closest_looks_at_few_and_misses_none():
    r = np.random.default_rng(6)
    for _ in range(200):
        n = int(r.integers(1, 400))
        begin, pair = np.arange(n) + 7, np.sort(r.integers(0, 3, n))
        d = np.cumsum(r.integers(-2, 3, n)) + int(r.integers(0, 30))
        d = d - min(0, d.min())
        asked = []
        i, e = decontaminate.closest(pair, begin, 20, lambda x: (asked.extend(x.tolist()), d[x])[1])
        want = {p: min((int(d[j]), j) for j in np.flatnonzero(pair == p)) for p in set(pair.tolist())}
        assert {int(pair[a]): (int(b), int(a)) for a, b in zip(i, e, strict=True)} == {p: v for p, v in want.items() if v[0] <= 20}
        assert len(asked) == len(set(asked))


def test_blocks_of_items_find_the_same(spark, frame, monkeypatch):
    r = random.Random(2)
    items = [(k, " ".join(f"u{r.randrange(500)}" for _ in range(12))) for k in range(20)]
    data = [(k, "x y " + t + " z") for k, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(frame(data), bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, decontaminate.leaks(frame(data), bench).collect())) == whole and len(whole) == 20


def test_folds(spark):
    import zlib

    df = spark.range(100).select(F.col("id").alias("doc_id"), crc_mod("doc_id", 5).alias("m"))
    assert all(r.m == zlib.crc32(str(r.doc_id).encode()) % 5 for r in df.collect())
