"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts are
neighbours and only a group larger than the tolerance is ever cut. Splitters are
sought together: each round counts the exact bytes below candidate boundaries (the
next ten bits of the key, inside the intervals that still hold a splitter), in one
aggregation over all partitions, and narrows the intervals until every boundary is
within tolerance of its target. Then every row goes once to its place.

Each shard consists of several ranges, found as splitters too, with known row counts;
slots are numbered inside a range and begin at its base, so no task holds a shard.

Defined results: a null text has no bytes (size 1) and a hash of its own; a null doc_id
sorts first; repeated rows are told apart by their row number; an empty table gives an
empty result. Only doc_id and text are read, so other columns may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.llm.shared import free_name, numbered, row_id, written

SHARDS = 8
#: Allowed distance of a shard boundary from its target, as a part of a shard's bytes.
TOLERANCE = 0.002
#: Ranges per shard: more for larger tables, as tasks number slots range by range.
RANGES = 8
DIGIT = 10
KEYS = ("k0", "k1", "k2")
LEAST = -(2**63)


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, k0, k1, k2): the narrow table that is sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.xxhash64(F.col("text")).alias("k0"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("k1"),
        row_id().alias("k2"),
    )


class _Search:
    """One splitter: bytes and rows below it, and the interval of keys that holds it.

    ``low``: values of the key columns before column ``at``, in which the interval
    begins at ``base`` and has ``bits`` open bits.
    """

    def __init__(self, target: float) -> None:
        self.target, self.below, self.rows, self.done = target, 0, 0, False
        self.at, self.low, self.base, self.bits = 0, (), LEAST, 64

    def interval(self) -> tuple:
        return self.at, self.low, self.base, self.bits

    def boundary(self) -> tuple[int, ...]:
        """Rows whose key is at least this lie above."""
        return (*self.low, self.base, LEAST, LEAST)[: len(KEYS)]

    def refine(self, counts: dict[int, tuple[int, int]], shift: int, slack: float) -> None:
        below, rows = self.below, self.rows
        for digit in sorted(counts):
            weight, n = counts[digit]
            if below + weight > self.target:
                break
            below, rows = below + weight, rows + n
        edge, after = self.base + (digit << shift), self.base + (digit + 1 << shift)
        over, under = below + weight - self.target, self.target - below
        if over <= slack and over < under and after < 2**63:
            self.base, self.below, self.rows, self.done = after, below + weight, rows + n, True
            return
        self.base, self.bits, self.below, self.rows, self.done = edge, shift, below, rows, under <= slack
        if not self.done and shift == 0:  # rows that are equal in this column: go on with the next
            self.low, self.at, self.base, self.bits = (*self.low, edge), self.at + 1, LEAST, 64
            self.done = self.at == len(KEYS)


def splitters(table: DataFrame, total: int, parts: int, slack: float, every: int, fine: float) -> list[_Search]:
    """``parts - 1`` splitters; each ``every``-th one is held to ``fine``, others to ``slack``.

    A round brings at most 1024 counts per open interval to the driver.
    """
    found = [_Search(total * j / parts) for j in range(1, parts)]
    while open_ := [s for s in found if not s.done]:
        intervals = {s.interval() for s in open_}
        at, bits = min((i[0], -i[3]) for i in intervals)
        now = {i for i in intervals if (i[0], -i[3]) == (at, bits)}
        shift = max(0, -bits - DIGIT)
        counts = _count(table, at, now, shift, -bits)
        for j, s in enumerate(found, 1):
            if not s.done and s.interval() in now:
                s.refine(counts.get(s.interval(), {}), shift, fine if j % every == 0 else slack)
    return found


def _count(table: DataFrame, at: int, intervals: set[tuple], shift: int, bits: int) -> dict:
    """Bytes and rows by interval and by the next digit of key column ``at``."""
    key = F.col(KEYS[at])
    prefix = F.shiftright(key, bits) if bits < 64 else F.lit(0).cast("bigint")
    digit = F.shiftright(key, shift) - (F.shiftleft(prefix, bits - shift) if bits < 64 else F.lit(-(1 << (64 - shift)) // 2))
    wanted = [(*low, base >> bits if bits < 64 else 0) for _, low, base, _ in intervals]
    fixed = [F.col(k) for k in KEYS[:at]]
    rows = table
    for k, column in enumerate([*fixed, prefix]):
        rows = rows.where(column.isin(sorted({w[k] for w in wanted})))
    groups = rows.groupBy(*fixed, prefix.alias("prefix"), digit.alias("digit")).agg(
        F.sum("size").alias("weight"), F.count("size").alias("n")
    )
    out: dict = {}
    for row in groups.collect():
        low, top = tuple(row[:at]), row["prefix"]
        base = top << bits if bits < 64 else LEAST
        out.setdefault((at, low, base, bits), {})[row["digit"]] = (row["weight"], row["n"])
    return out


def _place(bounds: list[tuple[int, ...]], first: int = 0) -> Column:
    """Number of boundaries at or below a row's key, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    a, b, c = bounds[mid]
    k0, k1, k2 = (F.col(k) for k in KEYS)
    above = (k0 > a) | ((k0 == a) & ((k1 > b) | ((k1 == b) & (k2 >= c))))
    return F.when(above, _place(bounds[mid + 1 :], first + mid + 1)).otherwise(_place(bounds[:mid], first))


def assign(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, with shards near equal in bytes."""
    table = written(keys(docs), "shard-keys")
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = shards * ranges if total else 1
    found = splitters(table, total, parts, total / parts / 4, ranges, total / shards * tolerance)
    bounds = sorted((s.boundary(), s.rows) for s in found)
    starts = [0, *(rows for _, rows in bounds)]
    placed = table.withColumn("range", _place([b for b, _ in bounds]))
    shard = F.floor(F.col("range") / ranges).cast("int")
    base = [starts[k] - starts[k - k % ranges] for k in range(parts)]
    within = F.row_number().over(Window.partitionBy("range").orderBy(*KEYS))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        shard.alias("shard"),
        (within - 1 + F.element_at(F.array(*map(F.lit, base)), F.col("range") + 1)).cast("bigint").alias("slot"),
        F.col("k2").alias("row"),
    )




def write(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write whole documents into one folder per shard; ``docs`` must be a stored table.

    The texts move once. Shards are cut into files by slot, so no task writes a whole one.
    """
    rows = numbered(docs).join(assign(docs, **options).select("row", "shard", "slot"), "row")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    rows = rows.select("doc.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows.write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)
