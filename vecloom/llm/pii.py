"""Personal data by fixed patterns and weak supervision.

The base spans follow four fixed patterns and always stay. Further candidates (numbers, obfuscated addresses, long tokens) come from a
wide generator; labelers of three kinds vote on each: regular expressions on its shape, gazetteers of words near it, and its context.
Expectation-maximisation over the votes of all candidates of the corpus estimates each labeler's reliability in both classes; the
posteriors train the final span classifier, a logistic model of votes, kind and length, which decides what is added. Votes are
aggregated by pattern before they leave a task, and there is a fixed number of patterns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import documents, lean

KINDS = ("email", "ip", "card", "phone", "secret")
ACCEPT = 0.5
ROUNDS = 60
PRIOR_VOTES = 20

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# starting only where a run of digits starts gives the same matches and never scans a run twice
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @: its local part is all that can precede it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = at + 1  # no match goes over an @ that begins no domain
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind; null has none."""
    if not text or not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# --- candidates and labelers -----------------------------------------------------------------------------------------------------

_WIDE = (
    (0, re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]+)+", re.I)),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9A-Za-z+-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])")),
    (4, re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20,}(?![0-9A-Za-z_/+-])")),
)
#: What every candidate holds.
_CANDIDATE = re.compile(r"[0-9@]|[\[(]at[\])]|::", re.I)
_SHAPES = (
    re.compile(r"[a-z0-9._%+-]+.{0,3}at.{0,3}[a-z0-9-]+.*\.?[a-z]{2,6}$", re.I), re.compile(r"(?=.{6,39}$)(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|(?=.{6,39}$)[0-9a-f]{2,4}:[0-9a-f:]*::[0-9a-f:]+$", re.I),
    re.compile(r"[3-6][0-9]{3}(?:[\x20-]?[0-9]{4}){3}$"), re.compile(r"(?:\([0-9]{3}\)|[0-9]{3}[.-])\x20?[0-9]{3}[.-][0-9]{4}$"),
    re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|AKIA|xox)[A-Za-z0-9_-]{12,})$"),
)
_WORDS = (
    frozenset("email e-mail mail contact courriel correo kontakt adresse".split()), frozenset("ip host server address adresse adresa".split()),
    frozenset("card visa mastercard amex carte tarjeta karte credit".split()), frozenset("phone tel call mobile fax telefon teléfono téléphone".split()),
    frozenset("token key secret password passwd api bearer auth contraseña passwort clé".split()),
)
_AGAINST = frozenset("version license licence isbn doi issn rfc figure table page section".split())
_ABROAD = re.compile(r"\+[0-9]{1,3}[\x20.-]?$")
_NEAR = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def _votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains: shape, near words, words against, assignment or country code, character mix, checksum."""
    s = text[start:end]
    before = [w.lower() for w in _NEAR.findall(text[max(0, start - 40):start])][-4:]
    lead = text[max(0, start - 3):start].rstrip("\x20\"'")[-1:]
    digits = _digits(s)
    letters = sum(c.isalpha() for c in s)
    mixed = len(digits) * 5 >= len(s) and letters * 5 >= len(s)
    return (
        1 if _SHAPES[kind].match(s) else -1,
        1 if _WORDS[kind].intersection(before) else 0,
        -1 if _AGAINST.intersection(before) else 0,
        1 if lead and lead in "=:" or kind == 3 and _ABROAD.search(text, max(0, start - 6), start) else 0,
        (1 if mixed else -1) if kind == 4 else 0,
        (1 if luhn(digits) else -1) if kind == 2 else 0,
    )


def candidates(text: str | None, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, str]]:
    """(start, kind number, end, pattern) of what the generator finds outside the base spans, without overlaps."""
    if not text or not _CANDIDATE.search(text):
        return
    taken = sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in taken]
    reach: list[int] = []  # the furthest end so far: base spans may overlap
    for _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)
    found = []
    for kind, wide in _WIDE:
        for m in wide.finditer(text):
            a, b = m.span()
            if kind == 4 and not (any("0" <= c <= "9" for c in m.group()) and any(c.isalpha() for c in m.group())):
                continue
            i = bisect_right(starts, b - 1)
            if not i or reach[i - 1] <= a:
                found.append((a, kind, b))
    end = -1
    for a, kind, b in sorted(found):
        if a >= end:
            end = b
            votes = _votes(text, kind, a, b)
            yield a, kind, b, f"{kind}:{min(4, (b - a) // 12)}:" + ",".join(map(str, votes))


class SpanClassifier:
    """Decides by pattern; patterns that were never seen are scored by the same weights."""

    def __init__(self, weights: np.ndarray, reliability: dict[str, np.ndarray]):
        self.weights, self.reliability = weights, reliability

    @staticmethod
    def features(pattern: str) -> np.ndarray:
        kind, size, votes = pattern.split(":")
        votes = [int(v) for v in votes.split(",")]
        own = [1, *(v == 1 for v in votes), *(v == -1 for v in votes)]
        blank = [0] * len(own)
        return np.array([*(size == str(k) for k in range(5)), *(x for k in range(len(KINDS)) for x in (own if kind == str(k) else blank))], float)

    def probability(self, pattern: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(pattern) @ self.weights, -30, 30))))


def aggregate_votes(patterns: dict[str, int]) -> SpanClassifier:
    """EM over (pattern, count), kind by kind: class prior and P(vote | class) per labeler, then the classifier on the posteriors.

    Votes start out as right four times in five; PRIOR_VOTES says how many votes that belief is worth. Without candidates nothing is
    accepted.
    """
    names = sorted(patterns)
    n = np.array([patterns[k] for k in names], float)
    n_features = len(SpanClassifier.features("0:0:0,0,0,0,0,0"))
    if not names:
        return SpanClassifier(np.where(np.arange(n_features) < 5, -9.0, 0.0), {})
    kinds = np.array([int(k.split(":")[0]) for k in names])
    every = np.array([[int(v) for v in k.split(":")[2].split(",")] for k in names])
    q = 1 / (1 + np.exp(-1.5 * every.sum(axis=1)))
    reliability = {}
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        votes, m = every[own], n[own]
        labelers = np.arange(votes.shape[1])
        for _ in range(ROUNDS):
            prior = ((m * q[own]).sum() + PRIOR_VOTES / 2) / (m.sum() + PRIOR_VOTES)
            chance = np.empty((votes.shape[1], 2, 3))
            for j in labelers:
                for c, w in enumerate((m * (1 - q[own]), m * q[own])):
                    hits = np.array([w[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + PRIOR_VOTES * np.array([(0.5, 0.375, 0.125), (0.125, 0.375, 0.5)][c])
                    chance[j, c] = hits / hits.sum()
            log = np.log(chance[labelers, :, votes + 1]).sum(axis=1)  # (pattern, class)
            q[own] = 1 / (1 + np.exp(-np.clip(log[:, 1] - log[:, 0] + np.log(prior / (1 - prior)), -30, 30)))
        reliability[KINDS[kind]] = chance
    design = np.array([SpanClassifier.features(k) for k in names])
    w = np.zeros(n_features)
    weight = n * np.minimum(1, 1000 / np.bincount(kinds, weights=n)[kinds])  # no kind drowns the others
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - q)) + 0.05 * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(n_features)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return SpanClassifier(w, reliability)


def train(df: DataFrame, text: str = "text") -> SpanClassifier:
    """Learn from the votes on every candidate of every whole text; what reaches the driver is a count per vote pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                counts.update(c[3] for c in candidates(t, base_spans(t)))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    rows = df.select(text).where(F.col(text).isNotNull()).mapInArrow(lean(run), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return aggregate_votes({r.pattern: r.n for r in rows})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(df: DataFrame, model: SpanClassifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row, map-only.

    The counts and the hash are those of the base spans; ``spans`` has the accepted ones as well, in the same order (start, then kind),
    with positions in code points. Null and empty texts have none; columns other than the two named are not read.
    """
    schema = T.StructType([T.StructField("__id", df.schema[doc_id].dataType)] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]]
                          + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept: dict[str, bool] = {}
        for batch in batches:
            made: list[list] = [[] for _ in range(7)]
            for t in batch.column(1):
                t = t.as_py()
                base = base_spans(t)
                added = []
                for a, kind, b, pattern in candidates(t, base):
                    if pattern not in accept:
                        accept[pattern] = model.probability(pattern) >= ACCEPT
                    if accept[pattern]:
                        added.append((a, kind, b))
                for k in range(4):
                    made[k].append(sum(x[1] == k for x in base))
                made[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                made[5].append(_joined(sorted(base + added)))
                made[6].append(len(added))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=schema.names)

    return df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(lean(run), schema).withColumnRenamed("__id", doc_id)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_pii(docs, train(docs))
