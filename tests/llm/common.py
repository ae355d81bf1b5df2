"""Small documents that hold the awkward cases every operator must survive."""

import random

from pyspark.sql import types as P

DATA = "/root/testdata/sf0.001"
DOCS = P.StructType([P.StructField("doc_id", P.LongType()), P.StructField("text", P.StringType()), P.StructField("lang", P.StringType()), P.StructField("source", P.StringType()), P.StructField("n_chars", P.LongType()), P.StructField("part", P.StringType()), P.StructField("blob", P.StringType()), P.StructField("key", P.StringType())])


def words(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocabulary)}" for _ in range(n))


def rows(seed: int = 1, n: int = 40):
    """(doc_id, text) with nulls, empty and long texts, ties, exact and near copies, shared passages, odd white space."""
    rng = random.Random(seed)
    passage = words(rng, 30, 400)
    out = []
    for i in range(n):
        text = words(rng, rng.choice([0, 1, 2, 8, 30, 90]), 300)
        if i % 4 == 1:
            text += " " + passage + "\n" + words(rng, 5)
        if i % 7 == 3 and out:
            text = out[rng.randrange(len(out))][1]
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n\x0b\r "), (n + 3, "é ü 日本 a b\x0bc " * 12), (n + 4, words(rng, 30000, 500)), (n + 5, "x" * 5000), (n + 6, passage.upper())]
    out += [out[1], (3, "another text under the same id " * 6), (None, "no id here"), (None, None)]
    return out


def docs(spark, data):
    """A table of documents, with extra columns whose names clash with inner ones."""
    full = [(i, t, "en" if (i or 0) % 2 else None, "src0", len(t or ""), "p", "b", "k") for i, t in data]
    return spark.createDataFrame(full, DOCS)
