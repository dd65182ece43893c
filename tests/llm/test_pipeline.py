import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from kvartal.llm import queries, shared, tokens
from tests.llm.conftest import frame, prose
from tests.llm.test_near_duplicates import brute as brute_components
from tests.llm.test_quality_rules import WORD, base
from tests.llm.test_repeats import words_brute


def corpus():
    rng = random.Random(21)
    good = [prose(rng, rng.randrange(40, 300), 6000) for _ in range(60)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, 120, 6000).split()) for _ in range(25)]
    passage = " ".join(prose(rng, 50, 6000).split())
    shared = [f"{prose(rng, 70, 6000)} {passage} {prose(rng, 70, 6000)}" for _ in range(5)]
    words = good[0].split() + good[1].split()
    near = [" ".join(words), " ".join(words[:50] + ["other"] + words[51:])]
    texts = [*good, *junk, *shared, *near, good[2], good[2], None, "", "short text", "the same again " * 60]
    quality = [1] * 60 + [0] * 25 + [1] * (len(texts) - 85)
    return texts, quality


def test_each_stage_against_brute_force(spark, tmp_path):
    texts, quality = corpus()
    where = str(tmp_path)
    frame(spark, texts).write.parquet(f"{where}/documents.parquet")
    labels = [(i, q, 0) for i, q in enumerate(quality)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    docs, outs = spark.read.parquet(f"{where}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, where)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{where}/out{k}")
        docs = spark.read.parquet(f"{where}/out{k}")
        outs.append(docs.collect())
    one, two, three, four = ({r.doc_id: r.text for r in rows} for rows in outs[:4])
    assert one == {i: t for i, t in enumerate(texts) if not base(t)[-1]}
    assert set(two) == {i for i in one if quality[i]} and all(two[i] == one[i] for i in two)
    ids = sorted(two)
    heads = {c for _, c in brute_components([two[i] for i in ids], ids).values()}
    assert set(three) == heads and len(heads) < len(ids)
    ids = sorted(three)
    for i, (n, gone, kept) in zip(ids, words_brute([three[i] for i in ids]), strict=True):
        assert four[i] == (kept.decode() if gone else three[i]) and n
    assert sum(len(WORD.findall(t)) for t in four.values()) < sum(len(WORD.findall(t)) for t in three.values())
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokens.default_path("word_bpe_49k.json"))
    pieces: dict = {}
    for r in sorted(outs[4], key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert pieces == {i: [*coder.encode(t, add_special_tokens=False).ids, 2] for i, t in four.items()}
    ran = corpus_pipeline.run(spark, where)
    assert sorted(map(tuple, ran.drop("sequence_id").collect())) == sorted(map(tuple, docs.drop("sequence_id").collect()))


def test_registered():
    found = __spark_entry__.queries()
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert set(queries.ORACLE_SQL) <= set(found)


class Session:
    """A session with this master and this shared folder."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder)})


def test_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(Session("spark://somewhere", None), "x")
    assert shared.folder(Session("spark://somewhere", "file:///shared/"), "x").startswith("file:///shared/x-")
    assert shared.folder(Session("local[2]", None), "x").rsplit("/", 1)[1].startswith("x-")
