"""Edge-case rows that every operator has to take, with clashing extra columns."""

import random

from pyspark.sql import functions as F

CLASHES = [
    "fingerprint", "component_id", "root", "node", "n_lines", "n_dropped", "kept_text", "pos", "row_hash", "n_tokens", "n_bytes", "kept", "n_words", "base_failed", "place",
    "block", "weight", "full", "cut", "uid", "piece", "start", "length", "offset", "sequence_id", "spans", "n_email", "licenses", "ids", "least", "fp", "mask", "value", "n", "quality",
]


def words(rng, n):
    return " ".join("".join(rng.choice("ba de ki lo mu ne ra si".split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edge_rows():
    rng = random.Random(4)
    long_text = "\n".join(words(rng, 12) for _ in range(3000))
    rows = [
        (1, "Hello there.\nA line that is long enough to count\nend"), (None, "A line that is long enough to count\nx"), (2, None), (3, ""), (4, " \n\t "), (5, long_text),
        (1, "Hello there.\nA line that is long enough to count\nend"), (6, "É a LINE that is long enough to count\t\n x"), (7, "a line THAT is long enough to count "), (8, "word"),
        (9, "x" * 5000), (None, None), (2**60 + 1, "big id \U0001f642 Σ"),
    ]
    return [(i, t, "en", None if i == 8 else "s1" if i != 5 else "s2", len(t or "")) for i, t in rows]


def edge_docs(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def no_docs(spark):
    return edge_docs(spark).limit(0)
