"""Keyed table maintenance without a row-level table format (K1, K5, K6, K7).

K1 upsert: insert new keys; for an existing key overwrite only the mutable
columns and keep the first-seen values of the others. Expressed as a union
of the current table and the incoming snapshots, then one aggregate per key:
``min_by`` (first seen) for immutable columns, ``max_by`` (latest) for mutable
ones. Both are partial aggregates, so a hot key costs one row per partition
before the shuffle.

Tables are written copy-on-write into versioned folders (``v00000042``),
never over the folder being read; the highest version is current.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_PREFIX = "v"


def upsert(current: DataFrame | None, incoming: DataFrame, key: Sequence[str], immutable: Sequence[str],
           mutable: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K1. ``order`` columns (present on both sides) rank the incoming snapshots and
    decide whether they are later than the table's row. First-seen values are those
    the table holds, else those of the first incoming snapshot; so a batch that is
    merged again changes nothing."""
    cols = [*key, *immutable, *mutable, *order]
    u = incoming.select(*cols, F.lit(1).alias("_new"))
    if current is not None:
        u = current.select(*cols, F.lit(0).alias("_new")).unionByName(u)
    seq = [F.col(c) for c in order]
    aggs = []
    if immutable:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in immutable]), F.struct(F.col("_new"), *seq)).alias("_first"))
    aggs.append(F.max_by(F.struct(*[F.col(c) for c in (*mutable, *order)]), F.struct(*seq, F.col("_new"))).alias("_last"))
    g = u.groupBy(*key).agg(*aggs)
    out = [F.col(k) for k in key]
    out += [F.col(f"_first.{c}").alias(c) for c in immutable]
    out += [F.col(f"_last.{c}").alias(c) for c in (*mutable, *order)]
    return g.select(*out)


def latest_snapshot(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K7: the latest row per key (``row_number() = 1`` by order desc),
    written as a partial ``max_by`` aggregate."""
    others = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*key).agg(last.alias("_l")).select(*key, *[F.col(f"_l.{c}").alias(c) for c in others])


def fk_split(child: DataFrame, parent: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists (left semi) and orphans (left anti)."""
    p = parent.select(key)
    return child.join(p, key, "left_semi"), child.join(p, key, "left_anti")


# ---- versioned copy-on-write storage (K1/K5 sinks) -------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions under ``path`` (a version counts once its
    ``_SUCCESS`` marker exists)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(VERSION_PREFIX) and name[1:].isdigit():
            if fs.exists(st.getPath().suffix("/_SUCCESS")):
                out.append(int(name[1:]))
    return sorted(out)


def version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/{VERSION_PREFIX}{version:08d}"


def read_current(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The highest committed version, or None when the table is empty."""
    vs = versions(spark, path)
    if not vs:
        return None
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(version_path(path, vs[-1]))


def write_version(df: DataFrame, path: str, version: int) -> str:
    """K5: write ``df`` as ``version`` (overwrite makes a retried batch
    idempotent; readers only see versions with a success marker)."""
    target = version_path(path, version)
    df.write.mode("overwrite").parquet(target)
    return target


def replace_table(df: DataFrame, path: str) -> str:
    """K5: replace a derived table by writing the next version."""
    vs = versions(df.sparkSession, path)
    return write_version(df, path, (vs[-1] + 1) if vs else 0)


def is_empty(df: DataFrame | None) -> bool:
    """Emptiness probe (reads at most one row)."""
    return df is None or df.isEmpty()


def load_once(target_path: str, spark: SparkSession, produce) -> bool:
    """K6: load a table only when it is empty; ``produce()`` returns the
    DataFrame to write. Returns whether a load happened."""
    if not is_empty(read_current(spark, target_path)):
        return False
    replace_table(produce(), target_path)
    return True


def append_rows(df: DataFrame, path: str, batch: int | None = None) -> None:
    """K2/K3: append lines to a table. With ``batch`` the rows land in their
    own ``batch=N`` folder written with overwrite, so a retried batch does not
    duplicate them."""
    w = df.write.option("compression", "zstd")      # lines pile up poll by poll
    if batch is None:
        w.mode("append").parquet(path)
    else:
        w.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch:08d}")


def merge_into_table(incoming: DataFrame, table: str, key: Sequence[str], mutable: Sequence[str],
                     order: Sequence[str]) -> None:
    """K1 on a catalog table with row-level operations (a table format with
    MERGE support): the same upsert as :func:`upsert`, but only the files
    holding matched keys are rewritten. Incoming snapshots are first reduced
    to one row per key (latest mutable values, first-seen others).

    Not exercised in this repository's tests: no row-level table format is
    installed here, so the copy-on-write versions above are what runs.
    """
    others = [c for c in incoming.columns if c not in (*key, *mutable, *order)]
    one = upsert(None, incoming, key, others, mutable, order)
    cond = " AND ".join(f"t.`{k}` = s.`{k}`" for k in key)
    (one.alias("s").mergeInto(table, F.expr(cond))
        .whenMatched().update({c: F.col(f"s.`{c}`") for c in (*mutable, *order)})
        .whenNotMatched().insertAll()
        .merge())
