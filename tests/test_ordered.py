"""A stream that puts late events where they belong."""

import random

import pytest
from pyspark.sql import functions as F

from tourweave.streaming import ordered, tours as live


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ordered.PROVIDER)
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("batches", [1, 4])
def test_any_split_gives_what_the_replay_gives(spark, tmp_path, rocks, batches):
    rng = random.Random(6)
    rows = [(rng.randint(1, 3), e, f"2024-01-01 0{rng.randint(0, 3)}:{rng.randint(0, 59):02d}:00", rng.choice(["done", "later", "not_delivered"])) for e in range(60)]
    schema = "tour_id long, event_id long, ts string, action string"
    make = lambda r: spark.createDataFrame(r, schema).withColumn("ts", F.to_timestamp("ts"))
    stops = spark.createDataFrame([(t, p, 10 * t + p, "pending") for t in (1, 2, 3) for p in range(7)], "tour_id long, pos long, stop_id long, status string")
    start = stops.groupBy("tour_id").agg(F.sort_array(F.collect_list(F.struct("pos", "stop_id", "status"))).alias("s")).select("tour_id", F.col("s.stop_id").alias("stop_ids"), F.col("s.status").alias("statuses"))
    source, schema_ = tmp_path / "in", make(rows[:1]).schema
    source.mkdir()
    stream = ordered.ordered_stream(spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(str(source)), start, late="5 hours")
    q = stream.writeStream.format("memory").queryName(f"ordered_{batches}").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    parts = [rows[i::batches] for i in range(batches)]  # every batch spans all hours
    parts[-1] = parts[-1] + rows[:5]  # sent twice
    # two marks far ahead let the watermark pass all other events
    for i, part in enumerate([*parts, [(3, 900, "2024-01-02 12:00:00", "mark")], [(3, 901, "2024-01-02 12:30:00", "mark")]]):
        make(part).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
    q.stop()
    last = spark.table(f"ordered_{batches}").groupBy("tour_id").agg(F.max_by(F.struct("stop_ids", "statuses", "current_index", "n_events", "n_navigations"), "n_events").alias("s")).select("tour_id", "s.*")
    assert sorted(map(str, last.collect())) == sorted(map(str, live.replay(stops, make(rows)).collect()))
