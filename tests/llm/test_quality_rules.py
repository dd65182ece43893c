import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from checks.compare import compare
from kvartal.llm import queries

from kvartal.llm import quality_rules as Q
from tests.llm.conftest import mixed_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def test_base_statistics(stored):
    texts = mixed_texts()
    got = {r.doc_id: r for r in Q.judge(stored(texts, row=F.lit("x"), words=F.lit(1))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), i


def boiler():
    rng = random.Random(5)
    texts = []
    for i in range(60):
        lines = [" ".join(f"w{rng.randrange(9000)}" for _ in range(12)) for _ in range(6)]
        if i % 3 == 0:
            lines.insert(2, "Accept  ALL cookies")
        if i >= 54:
            lines = lines[:2] + ["accept all cookies"] * 60
        texts.append("\n".join(lines))
    return texts


def test_frequent_lines_and_depleted(stored):
    texts = boiler()
    docs = stored(texts).withColumn("source", F.lit("one"))
    docs.write.mode("overwrite").parquet(path := docs.inputFiles()[0].rsplit("/", 1)[0] + "-one")
    docs = docs.sparkSession.read.parquet(path)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip().lower()
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            seen[norm(line)].add(i)
    hot = {line for line, ids in seen.items() if len(ids) > 10}
    assert hot == {"accept all cookies"}
    got = {r.doc_id: r for r in Q.judge(docs, max_docs=10).collect()}
    for i, t in enumerate(texts):
        gone = [x for x in t.split("\n") if norm(x) in hot]
        left = got[i].n_words - sum(len(WORD.findall(x)) for x in gone)
        assert got[i].n_removed_lines == len(gone)
        assert got[i].kept == (not base(t)[-1] and 100 * left >= 30 * got[i].n_words)
    assert not any(got[i].kept for i in range(54, 60))
    kept = {r.doc_id: r for r in Q.apply(docs, max_docs=10).collect()}
    assert set(kept) == {i for i in got if got[i].kept}
    for i, r in kept.items():
        assert r.text == "\n".join(x for x in texts[i].split("\n") if norm(x) not in hot)
        assert r.n_chars == len(r.text)


def test_copies_are_one_document(stored):
    text = "\n".join(prose(random.Random(i), 20, 9999).replace("\n", " ") for i in range(6))
    got = Q.judge(stored([text] * 50 + [text.replace("w1", "w2", 1)] * 3)).collect()
    assert all(r.kept and r.n_removed_lines == 0 for r in got)


def test_pages_of_many_shared_and_few_own_lines(stored):
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(12))
    shared = [line() for _ in range(20)]
    texts = ["\n".join([*shared, line()]) for _ in range(31)]
    texts += ["\n".join([*texts[0].split("\n")[:20], line()])] * 5  # copies: one more document
    docs = stored(texts, source=F.lit("one"))
    assert {r.n_removed_lines for r in Q.judge(docs, max_docs=31).collect()} == {20}
    assert {r.n_removed_lines for r in Q.judge(docs, max_docs=32).collect()} == {0}


def test_sql_counts_as_the_code_does(stored, spark, tmp_path):
    """Pages of many shared and few own lines, copies and pages of shared lines only, in several hosts."""
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(8))
    texts, hosts = [], []
    for host, pages, shared, own in (("a", 40, 20, 1), ("b", 30, 12, 3), ("c", 31, 8, 5), (None, 35, 6, 0)):
        common = [line() for _ in range(shared)]
        for _ in range(pages):
            texts.append("\n".join([*common, *(line() for _ in range(own))]))
            hosts.append(host)
    texts, hosts = [*texts, *texts[:9]], [*hosts, *hosts[:9]]
    path = str(tmp_path / "documents.parquet")
    rows = [(i, t, h) for i, (t, h) in enumerate(zip(texts, hosts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    key = "op1_quality_rules"
    state, n, _, detail = compare(spark, con, str(tmp_path), key, queries.QUERIES[key], queries.ORACLE_SQL[key])
    assert (state, n) == ("ok", len(texts)), detail
    got = {r.doc_id: r.n_removed_lines for r in Q.judge(spark.read.parquet(path)).collect()}
    assert (got[0], got[40], got[70], got[101]) == (20, 0, 8, 0)


def test_clashing_columns_keep_their_values(stored):
    docs = stored(boiler(), row=F.lit("r"), doc=F.lit("d"), removed=F.lit("x"), __row=F.lit(1), kept=F.lit("k"))
    rows = Q.apply(docs, max_docs=10).collect()
    assert rows and {(r.row, r.doc, r.removed, r["__row"], r.kept) for r in rows} == {("r", "d", "x", 1, "k")}


def test_empty_table(stored):
    docs = stored(["a"]).where("false")
    assert Q.judge(docs).count() == 0 and Q.apply(docs).columns == docs.columns
