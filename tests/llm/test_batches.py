"""Whole texts reach Python in small batches, and tables of seeds follow the number of seeds."""

import gc
import sys
import tracemalloc

import numpy as np

from kestrel.llm import common, decontaminate, periodic


def test_texts_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.range(3000).selectExpr("id doc_id", "concat('text ', id) text").coalesce(1)
        bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id int, text string")
        assert decontaminate.without_benchmark(docs, bench).count() == 3000
        assert int(spark.conf.get(name)) == common.BATCH_TEXTS
        sizes = docs.mapInPandas(lambda frames: (f.head(1).assign(doc_id=len(f)) for f in frames), "doc_id bigint, text string")
        most = sizes.selectExpr("max(doc_id)").head()[0]
        assert most <= common.BATCH_TEXTS
        spark.conf.set(name, "7")
        common.small_batches(spark)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)


def test_a_table_of_few_seeds_is_small_and_finds_the_same():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    seeds = decontaminate.Seeds("111011", words, np.arange(200), np.zeros(200, dtype=np.int64))
    assert len(seeds.slot) <= 1 << 14
    text = np.concatenate([rng.integers(0, 1 << 63, 50).astype(np.uint64), words[20:60]])
    own = decontaminate._seed_hashes(text, "111011")
    got = sorted((int(a), int(seeds.at[seeds.first[e]])) for at, entry in seeds.hits(text) for a, e in zip(at, entry))
    assert got == [(50 + k, 20 + k) for k in range(35)] and len(own) == 85


def test_run_search_lets_go_of_its_words_and_works_in_small_steps(spark):
    words = [bytes(f"word {k % 40}", "ascii") for k in range(400)]
    held = sys.getrefcount(words[7])
    gc.disable()
    try:
        assert periodic.runs_of([words]) == [[(0, 400, 40)]]
        now = sys.getrefcount(words[7])
        assert now == held      # no dictionary waits for the collector
    finally:
        gc.enable()
    rng = np.random.default_rng(3)
    text = [b"%d" % w for w in rng.integers(0, 50, 1 << 18)]
    tracemalloc.start()
    try:
        periodic.runs_of([text])
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.range(1200).selectExpr("id doc_id", "repeat('a b c ', 10) text").coalesce(1)
        rows = periodic.periodic_runs(docs).collect()
        assert len(rows) == 1200 and {tuple(r.runs[0]) for r in rows} == {(0, 30, 3)}
        assert int(spark.conf.get(name)) == common.BATCH_TEXTS
    finally:
        spark.conf.set(name, before)
