"""Small documents with the cases that every operator has a defined result for."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n: int = 40, seed: int = 7) -> list[str | None]:
    """Invented prose, exact and near copies, shared passages, empty, null, one-word and very long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopéßñ") for _ in range(r.randint(2, 8))) for _ in range(900)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)) + "."
    passage = prose(60)
    out: list[str | None] = [prose(r.randint(20, 160)) for _ in range(n)]
    out += [out[0], out[0], out[1]]
    for i in range(6):
        words = out[2].split()
        words[r.randrange(len(words))] = f"changed{i}"
        out.append(" ".join(words))
    out += [prose(30) + "\n" + passage + "\n" + prose(10) for _ in range(4)]
    out += [None, "", "", " \t\n", "one", "One", "two words", "\x0b\x0c", "ab" * 300, prose(9000)]
    return out


def documents(spark, rows: list[str | None] | None = None, clash: bool = True):
    rows = texts() if rows is None else rows
    data = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, DOCUMENTS)
    if clash:
        from pyspark.sql import functions as F

        for name in ("size", "key", "id", "n", "length", "target", "copies", "score", "kept", "piece", "__no", "features"):
            df = df.withColumn(name, F.lit("other"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
