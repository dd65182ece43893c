import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kvartal.llm import near_duplicates as N
from kvartal.llm.arrays import Words, least_in_windows, texts, windows
from kvartal.llm.components import components
from tests.llm.conftest import mixed_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts, ids):
    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = find(i), find(j)
                top[a] = b
    least = {}
    for i in range(len(texts)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)]) for i in range(len(texts))}


def families(seed):
    """Chains and stars of texts around the threshold, with ids in random order."""
    rng = random.Random(seed)
    out = mixed_texts(seed)
    for _ in range(6):
        words = prose(rng, 120, 3000).split()
        for k in range(12):  # a chain: each a little further from the first
            words = list(words)
            words[rng.randrange(len(words))] = f"n{k}"
            out.append(" ".join(words))
        base = prose(rng, 80, 3000).split()
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = f"m{k}"
            out.append(" ".join(copy))
    return out


def compare(stored, texts, ids):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.classify(stored(texts, ids, row=F.lit("x"), a=F.lit(1))).collect()}
    want = brute(texts, ids)
    wrong = {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert not wrong and len(got) == len(want), wrong


def test_components_of_families(stored):
    texts = families(4)
    ids = list(range(100, 100 + len(texts)))
    random.Random(9).shuffle(ids)
    compare(stored, texts, ids)


def test_blocks(stored, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 5)
    texts = families(7)
    compare(stored, texts, list(range(len(texts))))


def test_kept_and_repeated_rows(stored):
    texts = ["a b c d e f g"] * 3 + ["A B c d e f g", None, "", "z"]
    docs = stored(texts, [5, 5, None, 3, 1, 1, 9])
    rows = N.classify(docs).collect()
    assert sum(r.kept for r in rows) == 4
    assert {r.component_id for r in rows if r.n_shingles == 3} == {3}
    assert sorted(str(r.text) for r in N.apply(docs).collect()) == sorted(["A B c d e f g", "None", "", "z"])
    assert N.classify(docs.where("false")).count() == 0


def test_components_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1300)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {x: find(x) for x in top}
    alone = {x for x in want if all(u == v for u, v in edges if x in (u, v))}
    assert got == {x: c for x, c in want.items() if x not in alone}


def test_arrays():
    texts_ = [*mixed_texts(), "y" * 3000]
    for most in (50, 1 << 20):
        seen = []
        for first, data, offsets in texts(pa.array(texts_), most):
            words = Words(data, offsets)
            hashes = words.hashes()
            for k in range(len(offsets) - 1):
                a, b = words.before[k], words.before[k + 1]
                found = [data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)]
                assert found == WORD.findall(texts_[first + k] or "")
                seen += zip(found, hashes[a:b].tolist(), strict=True)
        assert len(dict(seen)) == len(set(seen)) == len({h for _, h in seen})
    values = np.arange(50, dtype=np.uint64) * np.uint64(7919) % np.uint64(101)
    for n in (1, 2, 3, 7, 35, 50, 51):
        full = [sum(int(values[i + j]) * pow(31, n - 1 - j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(51 - n)]
        assert windows(values, n, 31).tolist() == full
        if n <= 50:
            assert least_in_windows(values, n).tolist() == [min(values[i : i + n]) for i in range(51 - n)]
