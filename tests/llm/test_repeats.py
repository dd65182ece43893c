import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.llm import repeats, substring_dedup, suffix_dedup
from tests.llm.conftest import mixed_texts, prose


def corpus(seed):
    rng = random.Random(seed)
    out = mixed_texts(seed)
    passage = prose(rng, 60, 5000)
    for k in range(40):
        lead, tail = prose(rng, rng.randrange(0, 90), 5000), prose(rng, rng.randrange(0, 90), 5000)
        out.append(lead + passage[rng.randrange(0, 40) * (k % 3 == 0) :] + tail)
    out += [passage] * 5 + [prose(rng, 34, 5000), prose(rng, 35, 5000), "Erst, " * 300, "ab" * 90, "ab" * 49, "éà" * 60]
    return out


def words_brute(texts):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return out


def bytes_brute(texts, ids):
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
    seen, out = set(), {}
    for i in order:
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(data[k : k + 100])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("hot", [4096, 3])
def test_words(stored, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BUFFER", 1 << 21 if hot > 3 else 3000)
    texts = corpus(3)
    rows = {r.doc_id: r for r in substring_dedup.dedup(stored(texts, chunk=F.lit("x"), row=F.lit(1))).collect()}
    got = [(rows[i].n_words, rows[i].n_removed, bytes(rows[i].kept)) for i in range(len(texts))]
    assert got == words_brute(texts) and sum(g[1] for g in got) > 2000


@pytest.mark.parametrize("hot", [4096, 3])
def test_bytes(stored, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BUFFER", 1 << 21 if hot > 3 else 9000)
    texts = corpus(4)
    ids = list(range(500, 500 + len(texts)))
    random.Random(1).shuffle(ids)
    rows = {r.doc_id: r for r in suffix_dedup.dedup(stored(texts, ids, first=F.lit("x"), least=F.lit(1))).collect()}
    got = [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, bytes(rows[i].kept)) for i in ids]
    assert got == bytes_brute(texts, ids) and sum(g[1] for g in got) > 5000


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_twins_in_two_salts(monkeypatch, op):
    """Both passes over one partition, with unsalted groups that shift the buffers of the first."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "BUFFER", 2000)
    rng = random.Random(13)
    one = lambda: " ".join(prose(rng, 40, 5000).split()).encode()
    for lead in range(12):
        twin = one()
        rows = [(1, -1, one()) for _ in range(lead)] + [(2, s, t) for s in range(6) for t in (one(), twin)] + [(3, -1, one())]
        batch = pa.table({
            "least": pa.array([r[0] for r in rows], pa.int64()), "salt": pa.array([r[1] for r in rows], pa.int32()),
            "row": pa.array(range(len(rows)), pa.int64()), "doc_id": pa.array(range(len(rows)), pa.int64()),
            "first": pa.array([0] * len(rows), pa.int64()), "packed": pa.array([r[2] for r in rows], pa.binary()),
        }).combine_chunks().to_batches()[0]
        for size in (len(rows), 3):  # however Arrow cuts the partition
            batches = [batch.slice(k, size) for k in range(0, len(rows), size)]
            gone, sent = set(), []
            for group in repeats._groups(iter(batches)):
                v = op.judge(group)
                gone |= {(int(group.row[v.string[i]]), int(v.place[i])) for i in v.gone}
            for group in repeats._groups(iter(batches), salted=True):
                v = op.judge(group)
                sent += [(*d, group.order[v.string[i]], group.row[v.string[i]], v.place[i], m) for i, d, m in zip(v.sent, v.digest.tolist(), v.met, strict=True)]
            sent.sort(key=lambda x: x[:2])
            number = np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(sent, sent[1:], strict=False)])
            settled = op.settle(number, np.array([x[2:5] for x in sent], np.int64), np.array([x[5] for x in sent], bool))
            gone |= {(int(sent[i][3]), int(sent[i][4])) for i in settled}
            twins = [i for i, r in enumerate(rows) if r[2] == twin]
            assert {row for row, _ in gone} == set(twins if op is substring_dedup else twins[1:])
            windows = 6 if op is substring_dedup else len(twin) - 99
            assert len(gone) == windows * len({row for row, _ in gone})


def test_repeated_rows_and_null_ids(stored):
    text = prose(random.Random(8), 80, 5000)
    docs = stored([text] * 4 + [None], [1, 1, None, None, None])
    assert sorted(r.n_removed for r in suffix_dedup.dedup(docs).collect()) == [0, 0] + [len(text.encode())] * 3
    assert all(r.n_removed == r.n_words for r in substring_dedup.dedup(docs).collect())
    for op in (suffix_dedup, substring_dedup):
        assert op.dedup(docs.where("false")).count() == 0


def test_apply_keeps_columns(stored):
    rng = random.Random(11)
    shared = prose(rng, 40, 5000)
    texts = [prose(rng, 50, 5000), "a  b\nc", None, shared + " tail one", "lead " + shared]
    docs = stored(texts)
    rows = {r.doc_id: r for r in substring_dedup.apply(docs).collect()}
    assert [rows[i].text for i in range(3)] == texts[:3]
    assert rows[3].text == "tail one" and rows[4].text == "lead" and rows[4].n_chars == 4
    assert substring_dedup.apply(docs).columns == docs.columns


def test_suffix_ranks():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(600))
    ranks = suffix_ranks = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), 20)
    padded = data + bytes(20)
    keys = [padded[i : i + 20] for i in range(600)]
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    assert [place[k] for k in keys[:580]] == suffix_ranks[:580].tolist() or np.array_equal(
        np.argsort(np.argsort([place[k] for k in keys[:580]], kind="stable")), np.argsort(np.argsort(ranks[:580], kind="stable"))
    )


def test_smaller_positions():
    rng = random.Random(6)
    run = sorted(rng.randrange(20) for _ in range(200))
    position = rng.sample(range(1000), 200)
    before, after = suffix_dedup.smaller_before_and_after(np.array(run), np.array(position))
    for i in range(200):
        mine = [j for j in range(200) if run[j] == run[i] and position[j] < position[i]]
        assert before[i] == any(j < i for j in mine) and after[i] == any(j > i for j in mine)
