"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A Latin text is cut by the rank file's pattern; each distinct piece of a batch that isn't in a bounded memo is encoded once by the
library, and the text's ids are those of its pieces in order. Other texts are cut by the library as well. A rank file lists byte strings in merge order. The encoder maps each byte to a printable character, rebuilds the merge of every
rank from the lower ranks and hands both to the library; the decoder keeps the inverse table from id to bytes. Characters that
are split over several ids are whole again once the bytes of all ids are joined, so decoding works on bytes, and ``offsets``
widens the span of an id that holds part of a character to that character.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import documents, lean

SCHEMA = "n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string"
#: Characters given to the library at a time.
BATCH_CHARS = 1 << 20
#: Pieces that a worker remembers, beside those of the texts at hand.
MEMO_PIECES = 100_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The pair whose merge makes token: what is left when it is merged by lower ranks only."""
    parts = [token[i:i + 1] for i in range(len(token))]
    most = ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], most))
        if ranks.get(parts[best] + parts[best + 1], most) >= most:
            raise ValueError(f"no merge leads to {token!r}")
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


#: ASCII and the Latin letters from U+00C0 on: in them, letters, digits and white space are plain ranges.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_BEYOND = re.compile(f"[^\x00-\x7f{_LATIN}]").search


def _latin_pieces(pattern: str):
    """Text -> pieces of a pattern of letters, numbers and white space, for texts in which these are the ranges above."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\t-\r {_LATIN}0-9]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
    return re.compile(out.replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")).findall


class Codec:
    """Encodes texts to ids and ids to bytes by a rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        name = lambda token: "".join(chars[b] for b in token)
        merges = [tuple(map(name, _merge_of(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        model = models.BPE(vocab={name(t): i for t, i in ranks.items()}, merges=merges)
        split, to_characters = pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library, self.whole = Tokenizer(model), Tokenizer(model)
        self.library.pre_tokenizer = to_characters  # of pieces
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([split, to_characters])  # of whole texts
        self.pieces = _latin_pieces(pattern)
        self.memo: dict[str, bytes] = {}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [None if _BEYOND(t) else self.pieces(t) for t in texts]
        new = list({p for pieces in cut if pieces for p in pieces if p not in self.memo})
        for i in range(0, len(new), 4096):  # pieces as the words of one call, which costs far less than a call each
            part = new[i:i + 4096]
            e = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            cuts = 4 * np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1))
            raw = np.array(e.ids, "<u4").tobytes()
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, cuts[:-1].tolist(), cuts[1:].tolist())), strict=True))
        known = self.memo.__getitem__
        rest = iter(self.whole.encode_batch_fast([t for t, pieces in zip(texts, cut, strict=True) if pieces is None], add_special_tokens=False))
        out = [np.array(next(rest).ids, "<u4").tobytes() if pieces is None else b"".join(map(known, pieces)) for pieces in cut]
        if len(self.memo) > MEMO_PIECES:  # full: what came first stays, which holds the frequent pieces
            for p in new:
                del self.memo[p]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(p, "<u4").tolist() for p in self.packed(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Character span of each id in text; an id that holds part of a character has the span of the whole character."""
        lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        char = np.cumsum(lead) - 1
        ends = np.cumsum([len(self.tokens[i]) for i in ids])
        return [(int(char[a]), int(char[b - 1]) + 1) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and rank file."""
    return Codec(path, pattern)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, n = [], 0
    for t in texts:
        if group and n + len(t) > BATCH_CHARS:
            yield group
            group, n = [], 0
        group.append(t)
        n += len(t)
    if group:
        yield group


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), store: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode every whole text and decode the ids again; map-only, one output row per input row, in bounded batches.

    Adds ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), ``decoded`` (bytes) and the SHA-256 of both; ``store`` says which
    of the two payloads are kept. Null texts are empty: no tokens. ``keep`` names the columns that stay beside them, so other
    columns cannot clash.
    """
    from pyspark.sql import types as T

    kinds = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.BinaryType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    names = [c for c in kinds if c in store or c not in ("ids", "decoded")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, kinds[c]) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = codec(path, pattern)
        for batch in batches:
            row = 0
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for group in _groups(texts):
                made: dict[str, list] = {c: [] for c in kinds}
                for packed in own.packed(group):
                    ids = np.frombuffer(packed, "<u4").tolist()
                    decoded = own.decode(ids)
                    made["n_tokens"].append(len(ids))
                    made["ids"].append(packed)
                    made["decoded"].append(decoded)
                    made["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    made["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                columns = [batch.column(i).slice(row, len(group)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(made[c], pa.int64() if c == "n_tokens" else pa.binary() if c in store else pa.string()) for c in names], names=[*keep, *names])
                row += len(group)

    return df.select(*keep, df[text].alias("__text")).mapInArrow(lean(run), schema)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, store=())
