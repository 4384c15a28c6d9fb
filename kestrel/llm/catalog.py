"""Queries of this folder: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import (decontaminate, fingerprints, jaccard_join, language_id, licenses, mixing, packing, periodic,
                         sharding, spelling, token_counts, url_filter, warc)
from kestrel.llm.oracle_sql import ORACLE  # noqa: F401  read by the driver entry
from kestrel.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES: dict[str, Query] = {fn.__name__: _query(fn) for fn in (
    language_id.op1_language_id,
    warc.op2_warc,
    sharding.op3_sharding,
    decontaminate.op4_decontamination,
    jaccard_join.op5_jaccard_join,
    url_filter.op6_url_filter,
    fingerprints.op7_fingerprints,
    licenses.op8_license_scan,
    token_counts.op9_token_counts,
    packing.op10_packing,
    mixing.op11_source_mix,
    periodic.op12_periodic_runs,
    spelling.op13_spelling_variants,
)}
