"""Near-duplicates: MinHash bands, confirmed links on full shingle sets, components.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes) and a signature of
   BANDS x ROWS minima of universal hashes, whose parts are its band keys.
2. Texts with equal sets are one class; only a class's first document goes on.
3. A band key links its documents to the first of them (a star, not all pairs). Pairs
   whose signatures agree enough are confirmed on the full sets; components join what is
   confirmed.
4. Where a band key still holds several components, signatures tell which of its documents may
   have a link across them; their sets are compared. Large keys are dealt out as pairs of
   blocks. A task reports a spanning forest at most, not all pairs.
Signatures travel to the comparisons; full sets follow only those that agree.
So no link that a band key can show is lost, whatever the group's size. At a
similarity of 0.75 a pair shares no band key with a chance of 5e-6, and falls short of
AGREE with one of 4e-7.

Defined results: texts without words, empty or null, have the empty set and link with
nothing; shorter texts than five words are one shingle; repeated rows are linked; a
null doc_id comes after others; an empty table gives an empty result. ``docs`` must be
a stored table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.llm.arrays import Words, mix, texts, windows
from kvartal.llm.components import components
from kvartal.llm.shared import bounded_batches, numbered, row_id, written

WORDS = 5
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
BANDS, ROWS = 32, 4
#: Minima of a pair that must agree before its sets are compared: five deviations below SIMILAR.
AGREE = 72
#: Documents of a block where a band key is checked across components.
BLOCK = 1000
#: Bits by which wanted rows are known where texts are read; more rows than bits cost sets that nobody asks for.
MARKS = 1 << 26
_CHAIN = 0xA0761D6478BD642F
_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_A, _B = _KEYS[0] * np.uint64(2) + np.uint64(1), _KEYS[1] * np.uint64(2)
SKETCHES = "row long, doc_id long, n_shingles long, a long, b long, signature binary"
MEMBERS = "key long, x int, y int, row long, component long, block int, signature binary"


def shingle_sets(column) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column."""
    for _, data, offsets in texts(column):
        words = Words(data, offsets)
        hashes = words.hashes(lower=True)
        full = mix(windows(hashes, WORDS, _CHAIN))
        for a, b in zip(words.before[:-1].tolist(), words.before[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(full[a : b - WORDS + 1])
            elif b > a:
                yield mix(windows(hashes[a:b], b - a, _CHAIN) + np.uint64(b - a))
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of universal hashes (upper halves of a * x + b modulo 2**64)."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(shingles), 2048):
        part = shingles[None, k : k + 2048] * _A[:, None]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(_CHAIN) + rows[:, k])
    return keys


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted distinct arrays are linked."""
    if 100 * min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SIMILAR * (len(both) - common)


def _sketch(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        n, a, b, signatures = [], [], [], []
        rows = batch.column(0).to_pylist()
        for row, s in zip(rows, shingle_sets(batch.column(2)), strict=True):
            n.append(len(s))
            if len(s):
                a.append(int(mix(s).sum()))
                b.append(int(mix(s ^ np.uint64(_CHAIN)).sum()))
                signatures.append(signature(s).tobytes())
            else:
                a.append(row)
                b.append(0)
                signatures.append(b"")
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_pydict(
            {"row": batch.column(0), "doc_id": batch.column(1), "n_shingles": pa.array(n, pa.int64()),
             "a": signed(a), "b": signed(b), "signature": pa.array(signatures, pa.binary())}
        )


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS)


def _spread(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        keys = [band_keys(s) for s in _signatures(batch.column(1))]
        rows = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), "row": pa.array(rows)})


def _agree(batches: Iterator) -> Iterator:
    """Pairs whose signatures agree enough."""
    import pyarrow as pa

    for batch in batches:
        near = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(axis=1) >= AGREE
        yield pa.RecordBatch.from_pydict({"u": batch.column(0), "v": batch.column(1)}).filter(pa.array(near))


def _mark() -> Column:
    """The bit that stands for a row."""
    return F.pmod(F.xxhash64("row"), F.lit(MARKS))


def _sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets of the wanted rows, made where the texts are read, so that no text is shuffled.

    Wanted rows are known by MARKS bits, which come to the driver as one bitmap and go to all
    tasks. Rows that share a bit with a wanted one give their sets too, which no join asks for.
    """
    page = 1 << 15  # bits of a bitmap that Spark's function makes
    pages = wanted.select(_mark().alias("mark")).groupBy(F.floor(F.col("mark") / page).alias("page")).agg(
        F.bitmap_construct_agg(F.col("mark") % page).alias("bits")
    )
    marks = np.zeros((MARKS // page, page // 8), dtype=np.uint8)
    for r in pages.collect():
        marks[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(marks.reshape(-1))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            mark = batch.column(2).to_numpy()
            chosen = batch.filter(pa.array((held.value[mark >> 3] >> (mark & 7).astype(np.uint8) & 1).astype(bool)))
            sets = [s.tobytes() for s in shingle_sets(chosen.column(1))]
            yield pa.RecordBatch.from_pydict({"row": chosen.column(0), "shingles": pa.array(sets, pa.binary())})

    return written(rows.select("row", "text", _mark().alias("mark")).mapInArrow(run, "row long, shingles binary"), "sets")


def _confirm(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [
            similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
            for x, y in zip(batch.column(2), batch.column(3), strict=True)
        ]
        yield pa.RecordBatch.from_pydict({"u": batch.column(0), "v": batch.column(1)}).filter(pa.array(found, pa.bool_()))


def _open_pairs(group) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later rows) of a group that agree enough across components, and across blocks if there are two.

    A pair counts under the first of its shared band keys only.
    """
    part, side = group.column("component").to_numpy(), group.column("block").to_numpy()
    signatures = _signatures(group.column("signature"))
    band = int(np.flatnonzero(band_keys(signatures[0]).view(np.int64) == group.column("key")[0].as_py())[0])
    two_blocks = side.min() != side.max()
    for i in range(len(part)):
        same = signatures[i + 1 :] == signatures[i]
        agree = same.sum(axis=1)
        near = np.flatnonzero((agree >= AGREE) & (part[i + 1 :] != part[i]) & (not two_blocks or side[i + 1 :] != side[i]))
        near = near[~same[near, : band * ROWS].reshape(len(near), band, ROWS).all(axis=2).any(axis=1)]
        if len(near):
            yield i, near[np.argsort(-agree[near], kind="stable")] + i + 1


def _hopeful(group):
    """Members of a group that may have a link across components."""
    import pyarrow as pa

    some = np.zeros(group.num_rows, dtype=bool)
    for i, near in _open_pairs(group):
        some[i] = True
        some[near] = True
    return group.filter(pa.array(some))


def _across(group):
    """Links across the components of a group: a spanning forest of them at most."""
    import pyarrow as pa

    rows, part = group.column("row").to_numpy(), group.column("component").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("shingles")]
    joined = {c: c for c in part.tolist()}

    def top(c: int) -> int:
        while joined[c] != c:
            joined[c] = joined[joined[c]]
            c = joined[c]
        return c

    out: list[tuple[int, int]] = []
    for i, near in _open_pairs(group):
        for j in near.tolist():
            p, q = top(int(part[i])), top(int(part[j]))
            if p != q and similar(sets[i], sets[j]):
                joined[p] = q
                out.append((int(rows[i]), int(rows[j])))
    return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})


def _dealt(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of band keys, cut into blocks and repeated for each pair of blocks of their key."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.join(sizes, "key").withColumn("blocks", blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    # with one block it is a pair with itself; with more, pairs of different blocks and each with itself
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.col("key"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "row", "component", "block")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and row of every document.

    kept marks one row of each component: that of its smallest doc_id (of repeated rows
    with one doc_id, the first).
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(row_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = written(rows.mapInArrow(_sketch, SKETCHES), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = written(sketches.groupBy("a", "b").agg(first).withColumn("row", F.col("first.row")), "classes")

    signed = sketches.where("n_shingles > 0").select("row", "signature").join(classes.select("row"), "row", "left_semi")
    bands = written(signed.mapInArrow(_spread, "key long, row long"), "bands")
    shared = bands.groupBy("key").agg(F.min("row").alias("center"), F.count("row").alias("size")).where("size > 1")
    members = written(bands.join(shared, "key"), "members")
    stars = members.where("row <> center").select(F.col("row").alias("u"), F.col("center").alias("v")).distinct()
    likely = stars.join(signed.toDF("u", "x"), "u").join(signed.toDF("v", "y"), "v").select("u", "v", "x", "y")
    likely = written(likely.mapInArrow(_agree, "u long, v long"), "likely-links")

    sets = _sets_of(rows, likely.select(F.col("u").alias("row")).unionAll(likely.select(F.col("v").alias("row"))))
    pairs = likely.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").select("u", "v", "x", "y")
    links = written(pairs.mapInArrow(_confirm, "u long, v long"), "links")
    found = components(links)

    placed = members.join(found, members["row"] == found["node"], "left").select(
        "key", "row", F.coalesce("component", "row").alias("component")
    )
    open_ = placed.groupBy("key").agg(
        F.count("row").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high").select("key", "size")
    dealt = _dealt(placed, open_).join(signed, "row")
    hopeful = written(dealt.groupBy("key", "x", "y").applyInArrow(_hopeful, MEMBERS), "hopeful")
    if not hopeful.isEmpty():
        compared = hopeful.join(_sets_of(rows, hopeful), "row")
        more = compared.groupBy("key", "x", "y").applyInArrow(_across, "u long, v long")
        found = components(links.unionAll(written(more.distinct(), "more-links")))

    named = classes.join(found, classes["row"] == found["node"], "left").select(
        "a", "b", "first", F.coalesce("component", "row").alias("component")
    )
    named = written(named, "named")
    heads = named.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("head"))
    named = named.join(heads, F.col("component") == F.col("of")).select(F.col("a").alias("c"), F.col("b").alias("d"), "head")
    return sketches.join(named, (F.col("a") == F.col("c")) & (F.col("b") == F.col("d"))).select(
        "doc_id",
        "n_shingles",
        F.col("head.doc_id").alias("component_id"),
        (F.col("row") == F.col("head.row")).alias("kept"),
        "row",
    )


def apply(docs: DataFrame) -> DataFrame:
    """One document of each component, with its columns."""
    return numbered(docs).join(classify(docs).where("kept").select("row"), "row", "left_semi").select("doc.*")
