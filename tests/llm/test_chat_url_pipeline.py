"""Chat formatting, URL filter and the pipeline."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from vecloom.llm import chat_format, url_filter
from vecloom.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def against_duckdb(spark, name, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    tidy = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()), key=str)
    assert tidy(got) == tidy(want)


def test_oracles(spark, sf_dir):
    for name in ORACLE_SQL:
        against_duckdb(spark, name, sf_dir)


def brute_chats(rows):
    """Turns of each conversation in order; rows without a conversation are one each."""
    out = {}
    for k, (c, t, r, x) in enumerate(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))):
        out.setdefault((c, k if c is None else 0), []).append((r or "", x or ""))
    return out


def test_chats_read_back(spark):
    nasty = ["\\", "\\\\", "<|", "<\\|", "<|end|>", "<|turn|>user<|text|>hi", "a<", "|>", "<\\\\|", "é😀\n", "", None, "\\<|\\", "<<||"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (2, None, "sys<|tem", "x")]
    rows += [(None, 1, None, "lost"), (None, 1, None, "lost"), (None, 2, "assistant", "lost <| too"), (3, 0, "user", "no reply")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("piece", "formatted", "turns", "position", "begin", "r", "t", "head", "size", "alone", "target")})
    made = chat_format.format_chats(df)
    got = sorted(((r.conv_id, [tuple(t) for t in r.turns], r.targets) for r in chat_format.read_back(made).collect()), key=str)
    want = sorted(((c, turns, [x for r, x in turns if r == "assistant"]) for (c, _), turns in brute_chats(rows).items()), key=str)
    assert got == want
    whole = {r.conv_id: r.formatted for r in chat_format.conversations(made).where("conv_id IS NOT NULL").collect()}
    found = chat_format.examples(made).collect()
    assert len(found) == sum(len(t) for *_, t in want)
    for e in found:
        if not e.alone:
            assert whole[e.conv_id][e.target_start:e.target_end] == e.target and whole[e.conv_id][e.target_end:].startswith("<|end|>") and e.context_end == e.target_start
    written = chat_format.with_context(made).orderBy("conv_id", "position").collect()
    assert len(written) == len(found) and all(whole[r.conv_id].startswith(r.context + r.target + "<|end|>") for r in written if r.conv_id is not None)
    two = [r for r in written if r.conv_id == 2]
    assert [r.target for r in two] == ["first", "first"] and two[1].context.startswith(two[0].context + "first<|end|>")
    assert [r.context + r.target for r in written if r.conv_id is None] == ["<|turn|>assistant<|text|>lost <\\| too"]
    assert made.where("false").count() == chat_format.read_back(chat_format.format_chats(df.where("false"))).count() == 0


def test_every_reply_is_an_example_with_its_context(spark, monkeypatch):
    rows = [(1, 0, "assistant", "é<|"), (1, 1, "user", "😀 first"), (1, 2, "assistant", "日本\\"), (1, 3, "assistant", None), (1, 4, "user", "rest first"), (2, 0, "user", "first, no reply"), (None, 0, "assistant", "é lost"), (None, 1, "user", "first")]
    made = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    escaped = lambda x: (x or "").replace("\\", "\\\\").replace("<|", "<\\|")
    want, so_far = [], {}
    for c, t, r, x in rows:
        before = so_far.get(c, "") if c is not None else ""
        context = f"{before}<|turn|>{r}<|text|>"
        if r == "assistant":
            want.append((c, t, len(context), context, escaped(x)))
        so_far[c] = context + escaped(x) + "<|end|>"
    found = chat_format.examples(made).collect()
    assert sorted(((e.conv_id, e.position, e.context_end, e.context, e.target) for e in found), key=str) == sorted(want, key=str)
    # what the query reads comes from these examples
    exploded = chat_format._exploded
    monkeypatch.setattr(chat_format, "_exploded", lambda whole, conv_id: exploded(whole, conv_id).withColumn("context", F.replace("context", F.lit("first"), F.lit("other"))))
    read = {(r.conv_id, t.text) for r in chat_format.read_back(made).collect() for t in r.turns}
    assert {(1, "😀 other"), (1, "rest other"), (2, "other, no reply"), (None, "other"), (1, "日本\\"), (None, "é lost")} <= read and not any("first" in t for _, t in read)


def test_a_conversation_of_many_turns(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    r = chat_format.read_back(chat_format.format_chats(df)).first()
    assert len(r.turns) == n and r.targets == [f"t{i}" for i in range(1, n, 2)] and r.turns[-1].text == f"t{n - 1}"


def test_url_parts(spark):
    urls = ["http://A.Org/x?y", "https://b.com", "no scheme", None, "", "x://", "HTTP://É.COM/De/", "a://h?q/://z/p", "http://e.org#f/g", "u://x.org/a\nb?c"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).collect()]
    assert got == [("a.org", "/x"), ("b.com", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("É.com", "/De/"), ("h", ""), ("e.org", ""), ("x.org", "/a\nb")]


@pytest.mark.parametrize("most", [10**6, 0])
def test_marks_are_exact(spark, most):
    hosts = [f"h{i}.d{i % 50}.com" for i in range(3000)] + ["", "com", "a.b.c.d.e", ".".join(["x"] * 20_000)]
    table = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("key", F.lit("k"))
    for listed in ([f"h{i}.d{i % 50}.com" for i in range(0, 3000, 7)], ["d7.com"], [], ["com", "c.d.e"], ["b.c.d.e", "x.x", "", "h1.d1.com"], hosts[:3000]):
        marked, by_cascade = url_filter.mark_listed(table, spark.createDataFrame([(k,) for k in listed] + [("absent.org",), (None,)], "key string"), most)
        got = {r.host for r in marked.where("blocked").collect()}
        assert got == {h for h in hosts if any(h == k or h.endswith("." + k) for k in listed)}
        assert by_cascade or not most


def test_a_cascade_of_a_million_keys(spark):
    keys = spark.range(1_400_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") < 1_000_000).alias("own"))
    levels = url_filter.cascade(keys.where("own").select("key"), keys.where("NOT own").select("key"))
    assert keys.where(url_filter.member(levels, F.col("key")) != F.col("own")).count() == 0
    assert sum(x.bits for x in levels) < 8e6


def test_urls_odd_rows(spark):
    rows = [(1, "http://spam-farm.example.net/x"), (1, "http://spam-farm.example.net/x"), (2, None), (None, "http://a.spam-farm77.example.net/de/"), (3, "http://x.com/de/a"), (4, "http://org"), (5, "http://www.example.org/en/12"), (6, "http://notexample.org/es/"),
            (7, "http://" + "a." * 8000 + "casino-win5.example.com/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("k") for c in ("host", "key", "blocked", "path", "mark")})
    got = sorted(((r.page_id or 0, r.rule, r.verdict) for r in url_filter.judge_urls(df, url_filter.listed_domains(spark, 100)).collect()), key=str)
    assert got == sorted([(1, None, "block")] * 2 + [(2, None, "allow"), (0, None, "block"), (3, "com/de/", "block"), (4, None, "allow"), (5, "example.org/en/1", "block"), (6, "org/", "allow"), (7, None, "block")], key=str)
    assert url_filter.judge_urls(df.where("false"), url_filter.listed_domains(spark, 1)).count() == 0
    assert url_filter.listed_domains(spark).count() == 1_800_000


def test_pipeline_stages(spark, frame):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    leak = spark.read.parquet(f"{d}/benchmark.parquet").first().text
    odd = spark.createDataFrame([(10**6, "same text here", "en", "s", 1), (10**6 + 1, "same  text here", "en", "s", 1), (10**6 + 2, "start of it " + leak, "en", "s", 1), (10**6 + 3, None, None, None, None), (None, "unnamed text", "en", "s", 1), (10**6 + 4, "twice", "en", "s", 1), (10**6 + 4, "twice", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = stage(spark, docs, d)
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before), name
        if name == "exact_dedup":
            assert 10**6 in after and 10**6 + 1 not in after and kept.where(f"doc_id = {10**6 + 4}").count() == 1 and None in after
        if name == "benchmark_decontamination":
            assert 10**6 + 2 not in after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    assert {(r.doc_id, r.decoded_sha256) for r in out} == texts


def test_pipeline_runs(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 50 < len(rows) <= 200 and all(len(r.ids) == 4 * r.n_tokens for r in rows)
