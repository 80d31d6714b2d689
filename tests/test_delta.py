"""A3 by buckets: only touched folders change, and a batch can be run again."""

import os

import pytest
from pyspark.sql import functions as F

from marketgrid.sources import delta as D

BUCKETS = 8


def files(path):
    return {os.path.join(r, f): os.path.getmtime(os.path.join(r, f)) for r, _, fs in os.walk(path) for f in fs
            if f.endswith(".parquet")}


def bucket(name):
    return name.split("bucket=")[1].split("/")[0]


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"o{k % 60}", k, "active") for k in range(300)]
    df = spark.createDataFrame(rows, "order_id string, item int, status string")
    return D.write_buckets(df, str(tmp_path / "items"), "order_id", BUCKETS)


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "order_id string")


def state(spark, path):
    return sorted((r.order_id, r.item, r.status) for r in D.read_buckets(spark, path).collect())


def flip(requests):
    def change(rows):
        hit = requests.withColumn("_h", F.lit(True))
        toggled = F.when(F.col("status") == "active", "removed").otherwise("active")
        return rows.join(hit, "order_id", "left").withColumn(
            "status", F.when(F.col("_h"), toggled).otherwise(F.col("status"))).drop("_h")
    return change


def test_only_touched_buckets_are_written(spark, table):
    before, was = files(table), state(spark, table)
    req = keys(spark, "o3", "o17")
    ids = D.write_delta(spark, table, "order_id", req, flip(req), "b1", BUCKETS)
    after = files(table)
    assert 1 <= len(ids) <= 2
    assert {n: t for n, t in before.items() if int(bucket(n)) not in ids} == \
        {n: t for n, t in after.items() if int(bucket(n)) not in ids}
    assert not {n for n in before if int(bucket(n)) in ids} & set(after)
    want = sorted((o, i, "removed" if o in ("o3", "o17") else s) for o, i, s in was)
    assert state(spark, table) == want


def test_running_a_batch_again_changes_nothing(spark, table):
    """The change is not idempotent (it toggles), and a later batch has touched the same order."""
    req = keys(spark, "o3")
    D.write_delta(spark, table, "order_id", req, flip(req), "b1", BUCKETS)
    once = state(spark, table)
    assert D.write_delta(spark, table, "order_id", req, flip(req), "b1", BUCKETS) == [] and state(spark, table) == once
    D.write_delta(spark, table, "order_id", req, flip(req), "b2", BUCKETS)
    twice = state(spark, table)
    assert twice != once
    D.write_delta(spark, table, "order_id", req, flip(req), "b1", BUCKETS)
    assert state(spark, table) == twice


def test_lost_between_staging_and_publishing(spark, table):
    """A run that dies while publishing is finished by the next one, from the staged rows."""
    was, req = state(spark, table), keys(spark, "o5", "o9")
    write, calls = D._write, []

    def dying(df, path, mode):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        write(df, path, mode)

    D._write = dying
    try:
        with pytest.raises(RuntimeError):
            D.write_delta(spark, table, "order_id", req, flip(req), "b", BUCKETS)
    finally:
        D._write = write
    assert state(spark, table) == was
    D.write_delta(spark, table, "order_id", req, lambda rows: 1 / 0, "b", BUCKETS)  # the change is not run again
    assert state(spark, table) == sorted((o, i, "removed" if o in ("o5", "o9") else s) for o, i, s in was)


def test_emptied_bucket_and_no_keys(spark, table):
    was = state(spark, table)
    assert D.write_delta(spark, table, "order_id", keys(spark, *[]), lambda r: r, "none", BUCKETS) == []
    assert state(spark, table) == was
    every = keys(spark, *{o for o, _, _ in was})
    gone = D.write_delta(spark, table, "order_id", every, lambda rows: rows.filter("order_id = 'o1'"), "all", BUCKETS)
    assert len(gone) >= 2 and {o for o, _, _ in state(spark, table)} == {"o1"}


def test_staged_buckets_are_published_without_a_shuffle(spark, table, monkeypatch):
    dealt = []
    by_bucket = D._by_bucket
    monkeypatch.setattr(D, "_by_bucket", lambda df: dealt.append(1) or by_bucket(df))
    req = keys(spark, "o1")
    D.write_delta(spark, table, "order_id", req, flip(req), "once", BUCKETS)
    assert len(dealt) == 1
