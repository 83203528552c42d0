"""URL filters by a Bloom filter cascade, with DataFrame functions only.

The key universe is complete: every host of the corpus and every parent domain of one that has no more labels than some listed key.
Level 0 of the cascade holds the listed keys of the universe, level 1 the unlisted ones that level 0 admits, level 2 the listed ones
that level 1 admits, and so on until a level admits nothing wrong. A key's first level that rejects it says whether it is listed,
exactly, for every key of the universe; so a page is judged by arithmetic on its own row, without a join.

Level 0 has so low a false positive rate that about as many unlisted keys as listed ones pass, every later level one of a half: all
levels together stay within a fixed number of bits per listed key (beyond the logarithm of universe over listed). Each level is a
table of one row, an array of 64-bit words, which the plan holds as a scalar subquery: it is computed once and shipped once per
executor and stage. More than ``MAX_LISTED`` listed keys in the universe aren't shipped; hosts are then matched by an equality join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import checkpointed, documents

#: Listed keys of the universe that filters are made for: about 20 bits a key are shipped.
MAX_LISTED = 5_000_000
MAX_LEVELS = 64

#: (host, path, verdict), as the contract gives them.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Names of the query's list.
NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none or url is null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_domains(spark: SparkSession, numbers: int = 99_999) -> DataFrame:
    """(key): a made-up block list of the size of a real one: each name, alone and with the numbers from 1 on, under three domains."""
    number = spark.range(numbers + 1).select(F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("").alias("n"))
    named = number.select(F.explode(F.array(*map(F.lit, NAMES))).alias("name"), "n")
    return named.select(F.explode(F.array(*[F.concat("name", "n", F.lit(f".example.{top}")) for top in ("com", "net", "org")])).alias("key"))


def suffixes(host: Column, labels: int) -> list[Column]:
    """The domains of a host that have 1, 2, … ``labels`` labels; from the host itself on they are the host."""
    return [F.substring_index(host, ".", -i) for i in range(1, labels + 1)]


class Level:
    """A Bloom filter as 64-bit words in a table of one row; ``key`` is a string column."""

    def __init__(self, number: int, keys: DataFrame, n: int, rate: float):
        self.number = number
        self.bits = 64 * math.ceil(max(1, n) * math.log(1 / rate) / math.log(2) ** 2 / 64)
        self.hashes = max(1, round(math.log(1 / rate, 2)))
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("p"))
        full = at.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits"))
        every = keys.sparkSession.range(self.bits // 64).withColumnRenamed("id", "w").join(full, "w", "left").select("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        self.filter = checkpointed(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words")))

    def positions(self, key: Column) -> list[Column]:
        """Double hashing; both hashes are cut to 40 bits so that their sums stay within a long."""
        first, second = (F.pmod(F.xxhash64(F.lit(2 * self.number + i), key), F.lit(1 << 40)) for i in range(2))
        return [F.pmod(first + F.lit(i) * second, F.lit(self.bits)) for i in range(self.hashes)]

    def admits(self, key: Column) -> Column:
        words = self.filter.scalar()
        tests = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.positions(key)]
        return reduce(lambda x, y: x & y, tests)


def cascade(inside: DataFrame, outside: DataFrame) -> list[Level]:
    """Levels of the cascade for the listed and the unlisted ``key``s of a universe, distinct and not null; none without listed keys."""
    n, rest = inside.count(), outside.count()
    levels: list[Level] = []
    while n and len(levels) < MAX_LEVELS:
        level = Level(len(levels), inside, n, min(0.5, n / max(1, rest)) if not levels else 0.5)
        levels.append(level)
        wrong = checkpointed(outside.where(level.admits(F.col("key"))))
        inside, outside = wrong, inside
        n, rest = wrong.count(), n
    if n:
        raise ValueError("the cascade doesn't end; are listed and unlisted keys distinct?")
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the number of the first level that rejects it is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.admits(key), out).otherwise(F.lit(level.number % 2 == 1))
    return out


def mark_listed(hosts: DataFrame, listed: DataFrame, most: int = MAX_LISTED) -> tuple[DataFrame, bool]:
    """hosts (a table with a column ``host``) with ``blocked``, whether the host or a parent domain is a ``key`` of listed, and whether
    that was by the cascade. Null keys are not listed."""
    listed = listed.select("key").where("key IS NOT NULL").distinct()
    deepest = listed.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0
    universe = hosts.select("host").distinct().select(F.explode(F.array(*suffixes(F.col("host"), deepest)) if deepest else F.array().cast("array<string>")).alias("key")).distinct()
    marked = checkpointed(universe.join(listed.withColumn("mark", F.lit(True)), "key", "left").select("key", F.col("mark").isNotNull().alias("mark")))
    inside = marked.where("mark").select("key")
    if inside.count() <= most:
        levels = cascade(inside, marked.where("NOT mark").select("key"))
        found = reduce(lambda x, y: x | y, [member(levels, key) for key in suffixes(F.col("host"), deepest)]) if levels else F.lit(False)
        return hosts.withColumn("blocked", found), True
    keyed = hosts.select("host").distinct().select("host", F.explode(F.array(*suffixes(F.col("host"), deepest))).alias("key"))
    found = keyed.join(inside, "key").select("host").distinct().withColumn("blocked", F.lit(True))
    return hosts.join(found, "host", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False))).select(*hosts.columns, "blocked"), False


def judge_urls(df: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, most: int = MAX_LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row; ``listed`` has the domains to block as ``key``.

    ``rule`` is host and path of the longest rule that fits (host or parent domain, and start of the path), else null; without a rule
    the verdict is block if the host or a parent domain is listed, else allow. Null urls and urls without ``://`` have an empty host
    and path, fit no rule and are allowed (unless the empty host is listed). Hosts may have any number of labels. Repeated rows are
    judged alike. Other columns are not read.
    """
    pages = df.select(page_id, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    pages, _ = mark_listed(pages, listed, most)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("blocked"), "block").otherwise("allow")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return pages.select(page_id, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(documents(spark, sf_dir, "pages"), listed_domains(spark))


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h0, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     p AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
     r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
     m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
           FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, m.rule AS rule,
       coalesce(m.v, CASE WHEN regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)([1-9][0-9]{0,4})?\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
