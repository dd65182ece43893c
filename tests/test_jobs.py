"""Alert stream, snapshots, and a few registered queries beside their SQL."""

import datetime as dt
import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from checks.registry import oracle_sql, queries
from kvartal.operators import claims as cl
from kvartal.operators import match as m
from kvartal.operators import state as st
from kvartal.sources import snapshots
from kvartal.streaming import alerts as al
from kvartal.streaming import keyed

SMALL = "/root/testdata/sf0.001"
KEYS = [
    "flagship_top_listings", "W3_clone_collapse", "E_feedback_fold", "S7_listing_upsert", "W9_recommendations", "L14_nearby_places",
    "A12_scoring_request", "K9_retention_purge", "L2_city_in_text", "P34_price_bounds", "P19_detail_merge", "K8_limiter", "S12_export_properties",
]


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, key):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    state, _, _, detail = compare(spark, connect(SMALL), SMALL, key, queries()[key], oracle_sql()[key])
    assert state == "ok", detail


def _listings(spark, ids, price=10):
    rows = [(i, "A", "sale", None, price, 2, 50.0, "x", "owner", "5/6", f"Lane {i if i.isdigit() else 0}") for i in ids]
    cols = (
        "external_id string, city string, deal_type string, rent_period string, price_kzt long, rooms int, area_m2 double,"
        " district_key string, posted_by string, floor string, address string"
    )
    return spark.createDataFrame(rows, cols).withColumn("published_at", F.lit("2026-01-01").cast("timestamp"))


def _targets(spark, users=(1,), owner_only=False, low=None):
    target = [(u, "A", "sale", None, low, 100, None, None, None, None, None, owner_only) for u in users]
    cols = (
        "user_id long, city string, deal_type string, rent_period string, min_price_kzt long, max_price_kzt long, rooms array<int>,"
        " districts array<string>, district_keys array<string>, min_area_m2 double, max_area_m2 double, owner_only boolean"
    )
    return spark.createDataFrame(target, cols)


def _folders(path):
    return al.Folders(*(f"{path}/{n}" for n in ("outbox", "seen", "touched", "listings")))


def _arrive(path, rows):
    """One more file of the listing stream."""
    rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return rows.schema


def _run(spark, path, targets, schema, check="check", **more):
    """Everything that has arrived, a file per batch."""
    folders = _folders(f"{path}/{check}-out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # each partition of the state starts a worker per batch
    try:
        al.run(stream, targets, folders, f"{path}/{check}", F.lit("2026-01-02").cast("timestamp"), **more)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    return folders


def _sent(spark, folders, batch=None):
    rows = spark.read.schema(f"{al.SEEN}, batch_id long").parquet(folders.seen)
    return sorted(r.external_id for r in rows.collect() if batch is None or r.batch_id == batch)


@pytest.mark.parametrize("batches", [1, 2, 10])
def test_no_listing_is_lost_however_batches_are_cut(spark, tmp_path, batches):
    everything = _listings(spark, [str(i) for i in range(10)])
    for k in range(batches):
        schema = _arrive(tmp_path, everything.where(F.col("external_id").cast("int") % batches == k))
    folders = _run(spark, tmp_path, _targets(spark), schema)
    assert _sent(spark, folders) == sorted(str(i) for i in range(10))
    sent = spark.read.parquet(folders.outbox)
    assert sum(r.listings for r in sent.collect()) == 10 and all(r.listings <= 6 for r in sent.collect())
    assert al.listing_upserts(spark.read.parquet(folders.listings)).count() == 10
    # a plain search leaves them alone while the claims last
    seen = spark.read.schema(f"{al.SEEN}, batch_id long").parquet(folders.seen)
    wanted = everything.select(F.lit("search").alias("namespace"), F.lit(1).cast("long").alias("user_id"), "external_id")
    assert cl.eligible(wanted, al.claims_of(seen), F.lit("2026-01-02").cast("timestamp")).count() == 0
    # and so do alerts of another job with the listings that a search delivered
    again = _run(spark, tmp_path, _targets(spark), schema, "other", delivered=al.claims_of(seen))
    assert spark.read.schema(al.NEWS + ", batch_id long").parquet(again.listings).count() == 0


def test_a_users_rows_are_judged_together(spark, tmp_path):
    """Clones, ranks and messages of a batch do not depend on how its rows are cut into chunks."""
    rows = _listings(spark, [str(i) for i in range(40)])
    clones = rows.withColumn("external_id", F.concat(F.lit("c"), "external_id")).withColumn("price_kzt", F.lit(9).cast("long"))
    schema = _arrive(tmp_path, rows.unionByName(clones))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folders = _run(spark, tmp_path, _targets(spark, users=(1, 2)), schema)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    got = spark.read.parquet(folders.listings).orderBy("user_id", "rank").collect()
    want = [f"c{i}" for i in sorted(map(str, range(40)))]
    assert [r.external_id for r in got] == want * 2
    assert [(r.rank, r.message) for r in got] == [(k + 1, k // 6) for k in range(40)] * 2


def test_seen_flats_live_in_the_state(spark, tmp_path):
    """Clones, repeats and restarts: nothing is alerted twice, and no batch needs the seen folder."""
    schema = _arrive(tmp_path, _listings(spark, ["1", "2"]))
    folders = _run(spark, tmp_path, _targets(spark), schema)
    assert _sent(spark, folders, 0) == ["1", "2"]
    os.rename(folders.seen, f"{tmp_path}/elsewhere")
    _arrive(tmp_path, _listings(spark, ["2", "3"]))
    _arrive(tmp_path, _listings(spark, ["1"]).withColumn("external_id", F.lit("9")))  # the flat of 1
    _arrive(tmp_path, _listings(spark, ["4"], price=500))
    _arrive(tmp_path, _listings(spark, ["4"]))
    _run(spark, tmp_path, _targets(spark), schema)
    assert [_sent(spark, folders, k) for k in range(1, 5)] == [["3"], [], [], ["4"]]
    # a new checkpoint starts from the seen table
    seen = spark.read.schema(al.SEEN).parquet(folders.seen).unionByName(spark.read.schema(al.SEEN).parquet(f"{tmp_path}/elsewhere"))
    seen.write.parquet(f"{tmp_path}/all-seen")
    _arrive(tmp_path, _listings(spark, ["5"]))
    again = _run(spark, tmp_path, _targets(spark), schema, "anew", seen=spark.read.parquet(f"{tmp_path}/all-seen"))
    fresh = spark.read.schema(al.NEWS + ", batch_id long").parquet(again.listings)
    assert sorted(r.external_id for r in fresh.collect()) == ["5"]


def test_a_replayed_batch_writes_the_same_files(spark, tmp_path):
    news = spark.createDataFrame([(1, "1", "f", 1, 0, "A", 10, 2, 50.0)], al.NEWS)
    folders, at = _folders(tmp_path), F.lit("2026-01-02").cast("timestamp")
    for _ in range(2):
        al.write_batch(news, 0, _targets(spark), folders, at)
    assert _sent(spark, folders) == ["1"] and spark.read.parquet(folders.outbox).count() == 1


def test_clones_collapse_inside_a_users_result(spark):
    agent = _listings(spark, ["agent"], price=10).withColumn("posted_by", F.lit("agent"))
    both = agent.unionByName(_listings(spark, ["owner"], price=12))
    pick = lambda t: [r.external_id for r in m.flats(t, both, ["published_at", "external_id"]).collect()]
    assert pick(_targets(spark)) == ["agent"]
    assert pick(_targets(spark, owner_only=True)) == ["owner"]
    assert pick(_targets(spark, low=11)) == ["owner"]


def test_snapshot_may_replace_what_it_is_made_from(spark, tmp_path):
    root = f"{tmp_path}/users"
    users = spark.createDataFrame([(1, "a"), (2, "b")], "telegram_user_id long, username string")
    assert snapshots.write(users, root) == 1
    new = spark.createDataFrame([(2, "", 1), (3, "c", 1)], "telegram_user_id long, username string, at int")
    merged = st.upsert_users(snapshots.read(spark, root), new, ["at"])
    assert snapshots.write(merged, root) == 2
    got = {r.telegram_user_id: r.username for r in snapshots.read(spark, root).collect()}
    assert got == {1: "a", 2: None, 3: "c"}
    os.makedirs(f"{root}/version=9")
    assert snapshots.versions(spark, root) == [1, 2]


def test_url_of_another_listing_is_rejected(spark):
    cols = "source string, external_id string, url string, price long, created_at int"
    old = spark.createDataFrame([("s", "1", "u1", 1, 0), ("s", "2", "u2", 1, 0)], cols)
    new = spark.createDataFrame([("s", "3", "u1", 5, 1), ("s", "2", "u9", 6, 1), ("s", "4", "u2", 7, 1)], cols)
    snapshot, rejects = st.upsert_listings(old, new, ["created_at"])
    assert sorted((r.external_id, r.url, r.created_at) for r in snapshot.collect()) == [("1", "u1", 0), ("2", "u9", 0), ("4", "u2", 1)]
    assert [r.external_id for r in rejects.collect()] == ["3"]


def test_stream_verdicts_do_not_depend_on_chunks(spark, tmp_path):
    rng = random.Random(4)
    ticks = sorted(rng.randrange(0, 1200) for _ in range(200))
    rows = [(1, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), k) for k, t in enumerate(ticks)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "user_id long, ts timestamp, seq long")
    want = {r.seq: r.verdict for r in cl.limiter(log, 3, 60).collect()}
    beat = spark.createDataFrame([(-1, dt.datetime(2026, 1, 3), -1)], "user_id long, ts timestamp, seq long")
    log.unionByName(beat).coalesce(1).write.parquet(f"{tmp_path}/in")
    keyed.use_rocksdb(spark)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = keyed.limiter(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), 3, 60)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(
            availableNow=True
        ).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    got = {r.seq: r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.user_id == 1}
    assert got == want


class _Marks:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return bool(self.held)

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_marks_of_a_batch_are_asked_for_by_entry():
    """However many flats a user's batch brings, the store is asked a bounded number of times; old marks are forgotten."""
    rule, marks, day = al.SeenRule(days=1), _Marks(), 86_400_000
    rule.seen = marks
    clock = lambda at: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: at)

    def batch(ids, at):
        frame = pd.DataFrame(
            {"external_id": ids, "city": "A", "price_kzt": 5, "rooms": 1, "area_m2": 40.0, "flat": [f"f{i}" for i in ids],
             "published": range(len(ids)), "fits": True, "taken": False}
        )
        return list(pd.concat(rule.handleInputRows((1,), iter([frame]), clock(at)))["external_id"])

    first = [str(i) for i in range(500)]
    assert batch(first, 0) == first and marks.calls <= 2 * al.SEEN_PARTS
    marks.calls = 0
    assert batch([*first, "new"], day - 1) == ["new"] and marks.calls <= 3 * al.SEEN_PARTS
    assert batch([*first, "new"], day) == first
