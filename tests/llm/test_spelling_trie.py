import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kvartal.llm import spelling_trie as S
from kvartal.llm.groups import whole_groups
from tests.llm.conftest import mixed_texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(texts, ids):
    count = Counter()
    for i, text in zip(ids, texts, strict=True):
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def spelled(seed):
    """Texts over frequent words and rarer variants of them, in long chains too."""
    rng = random.Random(seed)
    letters = "abcdeilnorstyzéèÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(40)] + ["abcdefgh", "hgfedcba", "aaaaaaa", "aaaaaaaa"]
    pool = []
    for stem in stems:
        word, times = stem, rng.choice([2, 40, 400])
        while times:
            pool += [word] * times
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1 :]])
            times //= rng.choice([2, 10, 12])
        pool += [stem.upper(), stem.title()]
    rng.shuffle(pool)
    texts = [rng.choice([" ", "1", ", ", "-"]).join(pool[k : k + 60]) for k in range(0, len(pool), 60)]
    return texts + mixed_texts(seed)


def collect(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_brute_force(stored, monkeypatch):
    texts = spelled(3)
    ids = [None if i == 3 else i * 7 for i in range(len(texts))]
    want = brute(texts, ids)
    assert max(v[3] for v in want.values()) > 2 and sum(v[0] is not None for v in want.values()) > 20
    docs = stored(texts, ids, word=F.lit("x"), n=F.lit(1), key=F.lit(0))
    for block, leaf in ((32_768, 1024), (4, 1)):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "LEAF", leaf)
        assert collect(S.classify(docs)) == want


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(19)] + [("a", "w19"), ("b", "a")]
    got = dict(map(tuple, S.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w19" for w, _ in chain}
    assert S.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_odd_rows(stored):
    long = "ab" * 20000
    texts = [None, "", "short words", long, long, long[:-1] + "c", long[:-1] + "c", "Telephon Telephon", "telephone " * 40, "tele-phone1telephone"]
    docs = stored(texts, list(range(len(texts))))
    assert collect(S.classify(docs)) == brute(texts, range(len(texts)))
    assert S.classify(docs.where("false")).count() == 0


def test_budgets_reach_every_edit():
    """Of two near words exactly one asks where the other is, with enough budget."""
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(9))
        k, c = rng.randrange(9), rng.choice("abcdefghijklmnopqrstuvwxyzé")
        for b in (a[:k] + c + a[k:], a[:k] + c + a[k + 1 :]):
            if a == b:
                continue
            counts, lengths = S.vectors(pa.array([a, b]))
            over = counts[1] - counts[0]
            hits = 0
            for sign in (1, -1):
                step = sign * (int(lengths[1] - lengths[0]) << 48) + sum(int(sign * over[t]) << (8 * t) for t in range(S.TOP))
                rest = sign * over[S.TOP :]
                hits += sum(d == step and np.maximum(rest, 0).sum() <= s and np.maximum(-rest, 0).sum() <= m for d, s, m in S._ASKED)
            same_top = not over[: S.TOP].any() and len(a) == len(b)
            assert hits == 1 + same_top and S.one_edit(a, b)


def test_whole_groups():
    key = np.repeat(np.arange(40), np.random.default_rng(1).integers(1, 30, 40))
    batches = [pa.RecordBatch.from_pydict({"key": key[k : k + 7], "at": np.arange(k, min(k + 7, len(key)))}) for k in range(0, len(key), 7)]
    got = []
    for table, starts in whole_groups(iter(batches), 1):
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = table.slice(a, b - a)
            assert len(set(part.column("key").to_pylist())) == 1
            got.append((part.column("key")[0].as_py(), part.num_rows))
    assert got == list(zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True))
    assert list(whole_groups(iter([]), 1)) == []
