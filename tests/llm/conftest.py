import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, chunk int, __id string, text_sha256 string, `group` string"


def rows():
    """Texts with everything that may be odd: null, empty, white space only, very long, not ASCII, repeated, near copies."""
    r = random.Random(7)
    vocabulary = ["w%d" % i for i in range(300)] + ["naïve", "Übung", "日本", "the", "of", "The"]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = sentence(60)
    texts = [None, "", "   \n\t ", "one", "one  two", "one two", "one\ttwo", sentence(12), sentence(13), sentence(14), passage, passage + "\x0b" + sentence(30), sentence(40) + "\n" + passage + " " + sentence(5),
             "😀 é\u00a0x\x00y", "x" * 50_000, " ".join(["the"] * 400), sentence(8_000)]
    base = [sentence(r.randint(5, 120)) for _ in range(40)]
    texts += base + base[:10] + [t.replace(" ", "  ") for t in base[:5]] + [t + " tail" for t in base[10:20]] + [" ".join(w.upper() for w in t.split(" ")) for t in base[20:22]]
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="session")
def corpus():
    return rows()


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text), with more columns whose names clash with those inside the operators."""
    def make(data, partitions=3):
        full = [(i, t, "en", "src", None, "a", 1, "b", "c", "d") for i, t in data]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)

    return make
