import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.llm import packing, simple8b, token_files, tokens, word_bpe
from tests.llm.conftest import mixed_texts

ODD = [" <|endoftext|> a", "x  <|endoftext|>  b c<|startoftext|>d", "<|endoftext|>", "a<|endoftext|", "a ", "a  ", " ", "  ", "a \nb", "\n a", " 's it 's\n's", "A\u0301 a\u0301. \u0338<", "a  \n  b", "x   y", "  z", "it's we'll  I'D", "é İ ΣΣ", "\t\ttab", "1 22 333", "lines.\nof words\nthat end\n", "\nfirst a", " lead a\nb ", "a\xa0b c\x85d e", "it's\n'tis we'll\nx"]


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_units_give_the_tokenizers_ids():
    texts = [*mixed_texts(), *ODD]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        ids = plain(name)
        for text, got in zip(texts, tokens.encoder(tokens.default_path(name), spaced).texts(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids(text), (name, text)


def test_marks_after_every_code_point():
    """Letters that lower-casing or composition takes apart keep what follows them."""
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        ids, encode = plain(name), tokens.encoder(tokens.default_path(name), spaced).texts
        points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        for marks in (".", tokens.MARKS):
            ends = points if marks == "." else [c for c in points if c < "\u0600" or c.isalpha() and c < "\u3000"]
            for k in range(0, len(ends), 2000):
                text = " ".join(f"{c}{marks} n{c}{marks}" for c in ends[k : k + 2000])
                assert np.frombuffer(next(encode([text])), "<u4").tolist() == ids(text), (name, marks, ends[k])


def test_random_mixes():
    rng = random.Random(6)
    some = [*"ab.,)|'é\u0130\u0307\u0958\u09dc\ufb1d\u01c5Σς中あ한\u1100\u1161\xa0\u0301\u0338<5\xbd\n\t", *"      ", "ing", "'s", "<|endoftext|>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice(some[:-1]) for _ in range(60)).replace("  ", " ") for _ in range(4000)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        ids = plain(name)
        for text, got in zip(texts, tokens.encoder(tokens.default_path(name), spaced).texts(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids(text), (name, text)


@pytest.mark.parametrize("most", [1, 2, 300, 50_000, 1 << 30, 1 << 60, 1 << 64])
def test_simple8b_round_trip(most):
    rng = random.Random(most)
    for n in (0, 1, 59, 1023, 1024, 1025, 5000):
        values = np.array([rng.randrange(rng.choice([1, 2, 5, most])) % most for _ in range(n)], dtype=np.uint64)
        words, offsets, exceptions = simple8b.encode(values)
        assert (simple8b.decode(words, offsets, exceptions, n) == values).all()
        assert len(offsets) == -(-n // 1024) + 1
        if most == 1 << 64 and n > 1000:
            assert len(exceptions)
    assert len(simple8b.encode(np.ones(6000, dtype=np.uint64))[0]) < 6000 / 50


def test_token_files(stored, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 3000)
    texts = [*mixed_texts(), *ODD]
    ids = [None, None, *[i * 7 % 50 for i in range(2, len(texts))]]
    path = str(tmp_path / "ids")
    token_files.write(stored(texts, ids, part=F.lit("x"), ids=F.lit(1)), path)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, (texts[i] or "").encode()))
    encode, start = plain("byte_bpe_50k.json"), 0
    assert len(rows) == len(texts)
    for i, r in zip(order, rows, strict=True):
        want = [*encode(texts[i]), 0]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (ids[i], start, len(want), want)
        start += len(want)
    token_files.write(stored(["a"]).where("false"), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_packing(stored):
    texts = [*mixed_texts(), *ODD]
    rows = packing.pieces(stored(texts, length=F.lit("x"), start=F.lit(1)), limit=1024).collect()
    encode = plain("word_bpe_49k.json")
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        want = [*encode(text), 2]
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert [r.start for r in mine] == [sum(r.length for r in mine[:k]) for k in range(len(mine))]
        assert all(r.doc_tokens == len(want) and r.offset == 0 and len(r.ids) == 4 * r.length for r in mine)
        assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 for r in mine)
        assert sorted((r.length for r in mine), reverse=True) == [r.length for r in mine]
    assert max(r.doc_tokens for r in rows) > 1024
    assert packing.pieces(stored(["a"]).where("false")).count() == 0


def test_word_bpe(stored, monkeypatch):
    import tiktoken
    from public_tokenizers import PATTERN

    monkeypatch.setattr(word_bpe, "CHUNK", 20_000)
    texts = [*mixed_texts(), *ODD]
    with open(tokens.default_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in word_bpe.decode(word_bpe.encode(stored(texts, chunk=F.lit("x"), words=F.lit(1)))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = np.frombuffer(rows[i].ids, "<u4").tolist()
        assert ids == coder.encode_ordinary(text or "") and rows[i].n_tokens == len(ids)
        assert bytes(rows[i].decoded) == (text or "").encode()
    assert word_bpe.encode(stored(["a"]).where("false")).count() == 0
