"""Tables in buckets: what is rewritten, who wins, who is refused."""

import pytest
from pyspark.sql import functions as F

from tourweave.sources import buckets as B, store


@pytest.fixture()
def table(spark, tmp_path):
    t = B.BucketTable(spark, str(tmp_path), "tours", "id long, v string", "id", buckets=8)
    t.upsert(spark.range(100).select("id", F.lit("old").alias("v")))
    return t


def content(t, version=None):
    return {r["id"]: r["v"] for r in t.read(version).collect()}


def test_the_last_write_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (2, "e")], "id long, v string").coalesce(1)
    assert sorted(map(tuple, store.upsert(old, new, "id").collect())) == [(1, "a"), (2, "e"), (3, "d")]
    assert sorted(map(tuple, store.upsert(old, new, "id", order=-F.ascii("v")).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_only_touched_buckets_are_rewritten(spark, table):
    before = table._manifest(1)
    assert len(before) == 8 and table.version() == 1
    assert table.upsert(spark.createDataFrame([(5, "x"), (5, "y"), (200, "z")], table.schema).coalesce(1)) == 2
    after = table._manifest(2)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert content(table) == {i: "old" for i in range(100)} | {5: "y", 200: "z"} and content(table, 1) == {i: "old" for i in range(100)}
    assert [tuple(r) for r in table.get(5).collect()] == [(5, "y")] and table.get(999).count() == 0
    assert table.delete(spark.range(90, 110).select("id")) == 3 and set(content(table)) == {*range(90), 200}
    assert table.delete(spark.range(0).select("id")) == 3


def test_two_writers_one_conflict_no_lost_row(spark, table):
    base = table.version()
    a = spark.createDataFrame([(1, "a"), (2, "a")], table.schema)
    b = spark.createDataFrame([(2, "b"), (3, "b")], table.schema)
    table.upsert(a, base)
    with pytest.raises(B.Conflict):
        table.upsert(b, base)
    assert content(table) == {i: "old" for i in range(100)} | {1: "a", 2: "a"}
    table.retry(lambda v: table.upsert(b, v))
    assert content(table) == {i: "old" for i in range(100)} | {1: "a", 2: "b", 3: "b"}


def test_a_writer_that_is_overtaken_while_it_writes(spark, table):
    """The rival publishes after the first writer has read and before it publishes."""
    publish, rival = table._publish, spark.createDataFrame([(7, "rival")], table.schema)
    other = B.BucketTable(spark, table.path.rsplit("/", 1)[0], "tours", table.schema, "id", buckets=8)
    tries = []

    def late(folders, base):
        if not tries:
            other.upsert(rival)
        tries.append(base)
        return publish(folders, base)

    table._publish = late
    assert table.retry(lambda v: table.upsert(spark.createDataFrame([(8, "own")], table.schema), v)) == 3 and tries == [1, 2]
    assert content(table) == {i: "old" for i in range(100)} | {7: "rival", 8: "own"}


def test_a_crash_before_publishing_changes_nothing(spark, table):
    def crash(folders, base):
        raise OSError("lost")

    good, table._publish = table._publish, crash
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(1, "x")], table.schema))
    assert table.version() == 1 and content(table) == {i: "old" for i in range(100)}
    table._publish = good
    assert table.upsert(spark.createDataFrame([(1, "x")], table.schema)) == 2
