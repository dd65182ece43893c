"""Spelling variants: a trie of letter-group counts, searched with a budget of one each way.

1. Runs of letters become words, with their numbers of occurrences (Spark's own functions).
2. A word is a vector of counts of GROUPS letter groups. One replaced letter gives at most
   one surplus and one deficit, an inserted one a surplus. The first TOP counts and the
   length are the upper part of the trie: its nodes are the buckets that words are dealt to.
   A word is sent to its own bucket, and asks in each bucket that part of its budget can
   reach; of equally long words only one of the two asks, of others the shorter.
3. In a bucket the rest of the trie is searched depth first; all askers that have come to a node
   go on together, each spending what is left of its budget. Small nodes are leaves: whole
   vectors are compared there, then words letter by letter.
4. A word's form is its most frequent near word, if frequent enough; forms are followed to
   the root by pointer doubling.
Buckets with more than BLOCK words or askers are dealt out as pairs of blocks.

Defined results: a null text has no words; a null doc_id is written as the empty text
when occurrences are drawn; repeated rows count again; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm.groups import whole_groups
from kvartal.llm.shared import bounded_batches, written

#: Letters of runs.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
MIN_LENGTH, MIN_COUNT = 7, 2
#: One of so many occurrences loses a letter.
DRAWN = 31
#: A form is so many times as frequent.
TIMES = 10
#: Letter groups in the order of the trie's levels: letters of a group are GROUPS code points
#: apart, so y counts as a and z as b. Frequent letters come first, as they part words best.
ORDER = "eiarntosludcmghpvbfkwxjq"
GROUPS, TOP = len(ORDER), 6
#: Words, and askers, of a bucket that meet in one task.
BLOCK = 32_768
#: Pairs of words and askers from which on a node is searched further down.
LEAF = 1024
#: Words up to this length are compared many at once, TOGETHER pairs of them.
WIDE, TOGETHER = 64, 1 << 16
_RANK = np.array([ORDER.index(chr(97 + (c - 97) % GROUPS)) for c in range(GROUPS)], dtype=np.int64)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least MIN_LENGTH letters and MIN_COUNT occurrences."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"([{LETTERS}]{{{MIN_LENGTH},}})"), F.lit(1))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    low = F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run")
    drawn = docs.select(doc, F.explode(runs).alias("run")).select("doc", low)
    drawn = drawn.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DRAWN == 0, less).otherwise(F.col("run"))
    found = drawn.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """Counts of letter groups of each word, in the trie's order, and the words' lengths."""
    texts = column.to_pylist()
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    group = _RANK[points % GROUPS]
    row = np.repeat(np.arange(len(texts)), lengths)
    return np.bincount(row * GROUPS + group, minlength=len(texts) * GROUPS).reshape(-1, GROUPS), lengths


def _buckets() -> list[tuple[int, int, int]]:
    """(key difference, surplus, deficit left) of the buckets that a word asks in.

    A bucket's key is the sum of length << 48 and of count << 8 * level; differences of one
    word's buckets never agree, even where large counts wrap around. The budget is that
    of the sought word over the asking one.
    """
    level = [1 << (8 * k) for k in range(TOP)]
    same = [(0, 1, 1)] + [(a, 0, 1) for a in level]
    same += [(level[i] - level[j], 0, 0) for i in range(TOP) for j in range(i + 1, TOP)]
    return same + [((1 << 48) + d, s, 0) for d, s in [(0, 1), *((a, 0) for a in level)]]


_ASKED = _buckets()


def _deal(batches: Iterator) -> Iterator:
    """Each word once as a member (budgets -1) and once per bucket that it asks in."""
    import pyarrow as pa

    moves = np.array([0, *(d for d, _, _ in _ASKED)], dtype=np.int64)
    surplus = np.array([-1, *(s for _, s, _ in _ASKED)], dtype=np.int32)
    deficit = np.array([-1, *(d for _, _, d in _ASKED)], dtype=np.int32)
    for batch in batches:
        counts, lengths = vectors(batch.column(0))
        keys = lengths << 48
        for k in range(TOP):
            keys += counts[:, k] << (8 * k)
        n, m = len(keys), len(moves)
        rows = pa.array(np.repeat(np.arange(n), m))
        yield pa.RecordBatch.from_arrays(
            [pa.array((keys[:, None] + moves[None]).ravel()), pa.array(np.tile(surplus, n)), pa.array(np.tile(deficit, n)),
             batch.column(0).take(rows), batch.column(1).take(rows)],
            names=["key", "surplus", "deficit", "word", "n"],
        )


def one_edit(a: str, b: str) -> bool:
    """Whether one letter replaced makes b of a, or one inserted where b is longer by one."""
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) == len(b):
        return k < len(a) and a[k + 1 :] == b[k + 1 :]
    return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


class Letters:
    """Words of a table as rows of code points, for many comparisons at once."""

    def __init__(self, texts: list[str], lengths: np.ndarray) -> None:
        self.texts, self.lengths = texts, lengths
        short = lengths <= WIDE
        points = np.frombuffer("".join(t for t, s in zip(texts, short.tolist(), strict=True) if s).encode("utf-32-le"), np.uint32)
        size = np.where(short, lengths, 0)
        kind = np.uint8 if points.max(initial=0) < 256 else np.uint32
        # one more column, so that the shorter word's end counts as a difference
        self.points = np.zeros((len(texts), int(size.max(initial=0)) + 1), dtype=kind)
        start = np.cumsum(size) - size
        self.points[np.repeat(np.arange(len(texts)), size), np.arange(len(points)) - np.repeat(start, size)] = points

    def near(self, a: np.ndarray, b: np.ndarray, once: np.ndarray) -> np.ndarray:
        """Which pairs have one letter replaced, or one more in b; of those in ``once`` only a < b."""
        out = np.zeros(len(a), dtype=bool)
        for k in range(0, len(a), TOGETHER):
            part = slice(k, k + TOGETHER)
            out[part] = self._near(a[part], b[part], once[part])
        for k in np.flatnonzero((self.lengths[a] > WIDE) | (self.lengths[b] > WIDE)).tolist():
            x, y = self.texts[a[k]], self.texts[b[k]]
            out[k] = one_edit(x, y) and (x < y or not once[k])
        return out

    def _near(self, a: np.ndarray, b: np.ndarray, once: np.ndarray) -> np.ndarray:
        x, y = self.points[a], self.points[b]
        differ = x != y
        at, rows = differ.argmax(axis=1), np.arange(len(a))
        replaced = differ.sum(axis=1) == 1
        # without b's letter at the first difference, the rest must agree
        shifted = x[:, :-1] != y[:, 1:]
        last = np.where(shifted.any(axis=1), shifted.shape[1] - 1 - shifted[:, ::-1].argmax(axis=1), -1)
        longer = self.lengths[b] - self.lengths[a]
        found = np.where(longer == 0, replaced, (longer == 1) & (last < at))
        return found & (~once | (x[rows, at] < y[rows, at]))


class Trie:
    """Words of a bucket by their counts below the upper part."""

    def __init__(self, counts: np.ndarray) -> None:
        self.order = np.lexsort(counts[:, : TOP - 1 : -1].T) if len(counts) else np.zeros(0, np.int64)
        self.counts = counts[self.order]

    def search(self, asked: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asker, word) pairs whose whole vectors are within the budgets."""
        out = []
        todo = [(TOP, 0, len(self.counts), np.arange(len(asked)), surplus, deficit)]
        while todo:
            level, low, high, who, plus, minus = todo.pop()
            if not len(who) or low == high:
                continue
            if level == GROUPS or (high - low) * len(who) <= LEAF:
                out += self._leaf(level, low, high, asked, who, plus, minus)
                continue
            column = self.counts[low:high, level]
            edges = np.append(np.flatnonzero(np.diff(column, prepend=-1)), high - low)
            wanted = asked[who, level]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                over = column[a] - wanted
                here = (over == 0) | ((over == 1) & (plus > 0)) | ((over == -1) & (minus > 0))
                step = over[here]
                todo.append((level + 1, low + a, low + b, who[here], plus[here] - (step == 1), minus[here] - (step == -1)))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(a for a, _ in out)]), np.concatenate([none, *(w for _, w in out)])

    def _leaf(self, level: int, low: int, high: int, asked, who, plus, minus) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, 64 * LEAF // (high - low))
        for k in range(0, len(who), step):
            part = slice(k, k + step)
            over = self.counts[None, low:high, level:] - asked[who[part], None, level:]
            fits = (np.maximum(over, 0).sum(axis=2) <= plus[part, None]) & (np.maximum(-over, 0).sum(axis=2) <= minus[part, None])
            a, w = np.nonzero(fits)
            yield who[part][a], self.order[low + w]


def _meet(batches: Iterator) -> Iterator:
    """Near words of each bucket's pair of blocks; rows come sorted by bucket and blocks."""
    import pyarrow as pa

    for table, starts in whole_groups(batches, 3):
        texts, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        surplus, deficit = table.column("surplus").to_numpy(), table.column("deficit").to_numpy()
        counts, lengths = vectors(table.column("word"))
        letters, out = Letters(texts, lengths), []
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            member = surplus[low:high] < 0
            own, ask = low + np.flatnonzero(member), low + np.flatnonzero(~member)
            if len(own) and len(ask):
                asker, found = Trie(counts[own]).search(counts[ask], surplus[ask], deficit[ask])
                a, b = ask[asker], own[found]
                # words with one upper part ask each other
                near = letters.near(a, b, (surplus[a] == 1) & (deficit[a] == 1) & (lengths[a] == lengths[b]))
                out.append((a[near], b[near]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in out)]) for k in (0, 1))
        pick = lambda rows: pa.array([texts[r] for r in rows.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([pick(a), pa.array(n[a]), pick(b), pa.array(n[b])], names=["a", "n_a", "b", "n_b"])


def near(table: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of near words of (word, n), each pair once."""
    bounded_batches(table.sparkSession)
    rows = written(table.mapInArrow(_deal, "key long, surplus int, deficit int, word string, n long"), "trie-rows")
    member = F.col("surplus") < 0
    sizes = rows.groupBy("key").agg(F.count_if(member).alias("own"), F.count_if(~member).alias("ask")).where("own > 0 AND ask > 0")
    dealt = rows.join(sizes, "key")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("bigint")
    mine = lambda c: F.array(F.pmod(F.xxhash64("word"), blocks(c)))
    every = lambda c: F.sequence(F.lit(0).cast("bigint"), blocks(c) - 1)
    dealt = dealt.withColumn("x", F.explode(F.when(member, mine("own")).otherwise(every("own"))))
    dealt = dealt.withColumn("y", F.explode(F.when(member, every("ask")).otherwise(mine("ask"))))
    place = ("key", "x", "y")
    dealt = dealt.select(*place, "surplus", "deficit", "word", "n").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(_meet, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last one.

    Each round doubles the steps taken. A form is TIMES as frequent as its word, so a
    64-bit count allows 19 steps, five rounds.
    """
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("ended")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        now = written(
            now.join(ahead, F.col("root") == F.col("at"), "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNull().alias("ended")
            ),
            "roots",
        )
        if now.where("NOT ended").isEmpty():
            return now.select("word", "root")


def classify(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    table = written(words(docs), "words")
    pairs = written(near(table), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other"))
    )
    # the least of (-n, word): the largest count, ties to the first word in code-point order
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best")
    near_by = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    often = -F.col("best.less") >= TIMES * F.col("n")
    found = table.join(near_by, "word", "left").select(
        "word",
        F.when(often, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )
    found = written(found, "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
