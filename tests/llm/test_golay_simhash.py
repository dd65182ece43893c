import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kvartal.llm import golay_simhash as G
from tests.llm.conftest import mixed_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, ids):
    top = list(range(len(ids)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
            top[b] = a
    return [ids[find(i)] for i in range(len(ids))]


def near_texts(seed):
    """Long texts with few changed words, so that fingerprints differ in few bits."""
    rng = random.Random(seed)
    out = mixed_texts(seed)
    for _ in range(5):
        words = prose(rng, 400, 3000).split()
        for k in range(25):
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"c{k}"
            out.append(" ".join(words))
    return out


def test_code():
    """Every 23-bit number lies within three errors of one codeword, as its index says."""
    v = np.arange(1 << 23, dtype=np.uint32)
    index = G.codeword(v)
    words = np.flatnonzero(G._ERROR[G._LOW[v & 0xFFF] ^ G._HIGH[v >> 12]] == 0).astype(np.uint32)
    assert len(words) == 4096 and sorted((words >> 11).tolist()) == list(range(4096))
    assert np.bitwise_count(words[index] ^ v).max() == 3


def test_every_pattern_of_errors_meets():
    """A link shows under a key that is an own one of its other end, whatever the three bits."""
    rng = np.random.default_rng(3)
    for start in rng.integers(0, 1 << 64, 2, dtype=np.uint64):
        places = [p for n in (1, 2, 3) for p in itertools.combinations(range(64), n)]
        places = [places[k] for k in rng.permutation(len(places))[:6000]] + places[:64]
        other = np.array([sum(1 << b for b in p) for p in places], dtype=np.uint64) ^ start
        _, mine, my_own = G.keys_of(np.array([start]))
        row, key, own = G.keys_of(other)
        met = np.isin(key, mine) & (own | np.isin(key, mine[my_own]))
        assert set(row[met].tolist()) == set(range(len(other)))
        assert len(np.unique(key + (row << 27))) == len(key)


def test_classes_against_brute_force(stored, monkeypatch):
    texts = near_texts(5)
    ids = list(range(50, 50 + len(texts)))
    random.Random(1).shuffle(ids)
    prints = [fingerprint(t) for t in texts]
    want = dict(zip(ids, zip((f"{p:016x}" for p in prints), brute(prints, ids)), strict=True))
    docs = stored(texts, ids, row=F.lit("x"), print=F.lit(1))
    assert len({c for _, c in want.values()}) < len(set(prints)) < len(texts)
    for block, small in ((2048, 16), (5, 3)):
        monkeypatch.setattr(G, "BLOCK", block)
        monkeypatch.setattr(G, "SMALL", small)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in G.classify(docs).collect()}
        assert got == want


def test_links_of_random_fingerprints(spark):
    """Balls of fingerprints around centres, chains included."""
    rng = random.Random(8)
    prints = []
    for _ in range(8):
        at = rng.getrandbits(64)
        for _ in range(60):
            prints.append(at)
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                at ^= 1 << b
    prints += [rng.getrandbits(64) for _ in range(200)] + [0, 1, 7, 15, (1 << 64) - 1]
    prints = sorted(set(prints))
    ids = list(range(len(prints)))
    want = brute(prints, ids)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    at = dict(zip(signed, ids, strict=True))
    top = list(ids)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for r in G.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect():
        assert (prints[at[r.u]] ^ prints[at[r.v]]).bit_count() <= 3
        a, b = sorted((find(at[r.u]), find(at[r.v])))
        top[b] = a
    assert [find(i) for i in ids] == want


def test_large_group_gives_a_forest():
    rng = np.random.default_rng(2)
    prints = np.unique(np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64) | np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    u, v = G.links_of(np.zeros(len(prints), dtype=np.int64), prints)
    assert len(u) == len(prints) - 1 and set(v.tolist()) | {int(u[0])} == set(prints.tolist())


def test_odd_rows(stored):
    texts = ["a b c d", "A  b\nc d", None, "", " \t", "z", "z", "e " * 30000]
    docs = stored(texts, [4, 3, 9, None, 7, 5, 5, 1])
    rows = G.classify(docs).collect()
    of = lambda i: {(r.fingerprint, r.component_id) for r in rows if r.doc_id == i}
    assert of(4) == of(3) and {c for _, c in of(4)} == {3}
    assert of(9) == of(7) == of(None) == {("0" * 16, 7)}
    assert {c for _, c in of(5)} == {5} and sum(r.kept for r in rows) == len(G.apply(docs).collect()) == 4
    assert {r.ROW for r in G.apply(docs.withColumn("ROW", F.lit(2))).collect()} == {2}
    assert G.classify(docs.where("false")).count() == 0
