import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def frame(spark, texts, ids=None, parts=4):
    """Documents with these texts; a column that clashes with inner names comes along."""
    rows = [
        (ids[i] if ids else i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.repartition(parts)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Writes texts as a stored documents table and reads it back."""

    def make(texts, doc_ids=None, **extra):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        df = frame(spark, texts, doc_ids)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in words)


def mixed_texts(seed=1):
    """Ordinary, empty, null, repeated, near-equal, long, odd and multilingual texts."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randrange(1, 400)) for _ in range(30)]
    base = prose(rng, 300, 5000)
    words = base.split()
    out += [base, base, base.upper(), " ".join(words), " ".join(words[:200] + ["changed"] + words[201:])]
    out += [None, None, "", " \n\t ", "one", "a b  c", "\x1cx\x1cy z", "naïve Été ß İstanbul ΣΣ"]
    out += ["spam ham eggs " * 200, "#$% *** <b> | & " * 30, "line\nline\nLine\n\n \nline", "\U0001f600 \U0001f468‍\U0001f469 é " * 20]
    out += [prose(rng, 6000, 9000), "x" * 5000, " ".join(words[50:150]) + " tail", "   lead   and  trail   "]
    return out
