"""Small awkward tables shared by the tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n", T.LongType()),  # clashes with names inside the operators
        T.StructField("block", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)

VOCABULARY = "the of and one two red blue dog cat ran sat big old tree house sky rain sun wind road".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 40)) for _ in range(n))


def awkward_rows(seed: int = 1):
    """Nulls, empties, blanks, a very long word, a long text, ties, repeats and near copies."""
    rng = random.Random(seed)
    base = prose(rng, 60)
    words = base.split()
    rows = [
        (10, base),
        (11, base),  # equal text
        (11, base),  # repeated row
        (12, " ".join([*words[:30], "changed", *words[31:]])),
        (13, base.upper().replace(" ", "\n")),
        (14, "  " + " ".join(words[20:55]) + "\t" + prose(rng, 30)),
        (15, None),
        (16, ""),
        (17, " \t\n\x0b\f\r"),
        (18, "one"),
        (19, "one two three"),
        (20, "x" * 5000),
        (21, " ".join(["again"] * 70)),
        (22, " été Σίσυφος 中文 \U0001f600 é !! ### <|endoftext|> 12345"),
        (23, "12 34 !! 56"),
        (None, base + " tail of a row without an id"),
        (24, prose(rng, 3000)),
    ]
    rows += [(30 + i, prose(rng, rng.randint(5, 80))) for i in range(12)]
    langs = ["en", "de", None, "fr"]
    return [
        (i, t, langs[k % 4], None if k % 5 == 0 else f"src{k % 3}", len(t or ""), k, f"b{k}", None)
        for k, (i, t) in enumerate(rows)
    ]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def words_of(text, lower=False):
    raw = (text or "").encode()
    raw = raw.lower() if lower else raw  # bytes.lower maps A-Z only
    return [w.decode() for w in raw.split()]


def sets_of(text, size=5):
    w = words_of(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])
