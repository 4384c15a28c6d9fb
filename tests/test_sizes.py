"""Partitions grow with the tables, so that a task's share does not."""

import datetime as dt

from kestrel.session import ensure_compiled, ensure_partitions
from kestrel.sources import fixtures as fx


def _tables(spark, at, balls=4000):
    spark.createDataFrame([(k, k % 30, "FO"[k % 2], 1e5 * k, dt.date(1995, 1, 1 + k % 28), "V") for k in range(balls // 4)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string") \
        .write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(k // 4, k % 70, k % 9, k % 4 + 1, float(k % 50), 0.01 * (k % 10), "NR"[k % 2]) for k in range(balls)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string") \
        .write.parquet(f"{at}/lineitem.parquet")


def test_a_large_ball_log_is_dealt_over_more_partitions(spark, scratch, monkeypatch):
    _tables(spark, scratch)
    held = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = fx.deliveries(spark, scratch)
    size = fx.table_bytes(spark, scratch, "lineitem")
    assert size > 0 and fx.table_bytes(spark, scratch, "none") == 0 and fx.input_parts(spark, scratch, "lineitem", "orders") == 1
    monkeypatch.setattr(fx, "PART_BYTES", -(-size // (5 * held)))
    many = fx.deliveries(spark, scratch)
    assert few.rdd.getNumPartitions() <= held < 4 * held <= many.rdd.getNumPartitions() <= 5 * held
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and many.count() == 4000


def test_a_task_takes_a_bounded_number_of_balls(spark, scratch, monkeypatch):
    """However few bytes they have, and though adaptive execution would join them."""
    _tables(spark, scratch)
    held = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(fx, "TASK_BALLS", -(-4000 // (6 * held)), raising=False)
    many = fx.deliveries(spark, scratch)
    assert 5 * held <= many.rdd.getNumPartitions() <= 6 * held and many.count() == 4000


def test_shuffles_begin_with_more_partitions_never_fewer(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    try:
        ensure_partitions(spark, 1)
        assert spark.conf.get(name, None) == before
        ensure_partitions(spark, 300)
        ensure_partitions(spark, 200)
        assert spark.conf.get(name) == "300"
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_methods_too_large_to_compile_are_not_one_stage(spark):
    """The stat validator's generated method is beyond what the JVM compiles."""
    from pyspark.sql import functions as F

    from kestrel.operators import quality
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    raw = spark.range(3).select(F.lit("P").alias("player_name"), *[F.col("id").cast("string").alias(f) for f, _ in quality.STAT_NUMERIC_FIELDS])
    try:
        spark.conf.set(name, "65535")
        ensure_compiled(spark)
        assert spark.conf.get(name) == "8000"
        assert all(r.is_valid and r.runs == int(r.economy) for r in quality.validate_player_stats(raw).collect())
        spark.conf.set(name, "5000")
        ensure_compiled(spark)
        assert spark.conf.get(name) == "5000"
    finally:
        spark.conf.set(name, before)
