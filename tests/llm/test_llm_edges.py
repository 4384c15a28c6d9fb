"""Each operator and stage on awkward tables: nulls in any column, empty and
very long texts, ties, repeated rows, empty tables, clashing column names."""
import os

import pytest

import corpus_pipeline
from kestrel.llm import catalog

LONG = "the and of with " * 20_000
DOCS = [(1, "the cat and the dog went to the house of the man", "en", "s", 1), (1, "the cat and the dog went to the house of the man", "en", "s", 1),
        (2, "the cat and the dog went to the house of the man", None, None, None), (None, "un chat et le chien de la maison", "fr", "s", 1),
        (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "fr", "s", 0), (5, "!!! ???", "en", "s", 7), (6, LONG, "en", "s", 9),
        (7, LONG + "the end", "en", "s", 9), (8, "x" * 100_000, "en", "s", 9), (9, "这是 一个 测试", "zh", "s", 4),
        (10, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, lang_pred string, " \
           "_p string, _id string, shard int, root long, length long, path string"


def write(spark, folder, docs, schema=SCHEMA, pages=None):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    pages = [(1, "http://a.example.org/en/2", "<p>x</p>", 1), (1, "http://a.example.org/en/2", "<p>x</p>", 1), (2, None, None, 2),
             (None, "http://b.example.com/de/1", "", 2), (3, "no url", "<p>x</p>", None), (4, "http://c.net/" + "y" * 5000, "z" * 300_000, 5),
             (5, "http://d.example.com/fr/x", "q", 7)] if pages is None else pages
    spark.createDataFrame(pages, "page_id long, url string, html string, size long").write.parquet(f"{folder}/pages.parquet")
    items = [(1, "one two three four five six seven eight nine ten eleven"), (None, "a b c d e f g h"), (2, None), (3, "")] if docs else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("awkward")), DOCS)


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("clashing")),
                 [(*d, 1, 0.5, "xx", "p", "i", 3, 4, 5, "q/LICENSE") for d in DOCS], CLASHING)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), [], pages=[])


NAMES = list(catalog.QUERIES)
ROWS = {"op1_language_id": len(DOCS), "op2_warc": 7, "op3_sharding": len(DOCS), "op4_decontamination": 1, "op5_jaccard_join": len(DOCS),
        "op6_url_filter": 7, "op7_fingerprints": len(DOCS), "op8_license_scan": len(DOCS), "op9_token_counts": len(DOCS),
        "op11_source_mix": len(DOCS), "op12_periodic_runs": len(DOCS)}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, awkward, name):
    got = catalog.QUERIES[name](spark, awkward).collect()
    assert len(got) == ROWS.get(name, len(got)) and len(got) > 0
    if name == "op1_language_id":
        by = {(r.doc_id, r.lang_pred) for r in got}
        assert {(3, "und"), (4, "und"), (5, "und"), (6, "en")} <= by
    if name == "op4_decontamination":
        assert [(r.doc_id, r.item_id, r.n_words) for r in got] == [(10, 1, 11)]
    if name == "op5_jaccard_join":
        by = sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str)
        assert by.count((1, 1, 2)) == 2 and (2, 1, 2) in by and (3, 3, 0) in by and (5, 5, 0) in by
        assert by.count((None, None, 0)) == 2 and {b for b in by if b[0] in (6, 7)} == {(6, 6, 1), (7, 6, 1)}
    if name == "op10_packing":
        assert {(r.doc_id, r.length) for r in got if r.doc_id in (3, 4)} == {(3, 1), (4, 1)}


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_change_nothing(spark, awkward, clashing, name):
    one, two = catalog.QUERIES[name](spark, awkward), catalog.QUERIES[name](spark, clashing)
    assert one.columns == two.columns
    if name != "op7_fingerprints":
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    else:
        assert two.count() == len(DOCS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).count() == 0


def test_stages_on_awkward_clashing_and_empty_tables(spark, awkward, clashing, empty):
    for folder, n in ((awkward, len(DOCS)), (clashing, len(DOCS)), (empty, 0)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        assert docs.count() == n
        kept = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name == "packing":
                assert out.columns[0] == "doc_id"
            else:
                assert out.schema.names == docs.schema.names
            out = spark.createDataFrame(out.collect(), out.schema)
            kept.append(sorted((str(r.doc_id) for r in out.collect())))
            docs = out if name != "packing" else docs
        if n:
            assert "3" not in kept[0] and "5" not in kept[0] and kept[0].count("1") == 2
            assert kept[1].count("1") == 1 and "2" not in kept[1] and "6" in kept[1] and "7" not in kept[1]
            assert "10" in kept[1] and "10" not in kept[2] and "9" in kept[2]
            assert set(kept[3]) == set(kept[2])
    assert os.path.exists(f"{awkward}/documents.parquet")


def test_pipeline_against_its_parts(spark):
    import __spark_entry__
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bench = {r.doc_id for r in catalog.QUERIES["op4_decontamination"](spark, sf).collect()}
    first = {}
    for r in catalog.QUERIES["op5_jaccard_join"](spark, sf).collect():
        first[r.class_id] = min(first.get(r.class_id, r.doc_id), r.doc_id)
    assert all(any(c.isalpha() for c in d.text) for d in docs)
    got = {r.doc_id for r in __spark_entry__.queries()["pipeline"](spark, sf).collect()}
    assert got == set(first.values()) - bench
