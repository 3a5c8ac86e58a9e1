"""Helpers around the Spark session: shared scratch tables and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only after its row count was checked against this.
BROADCAST_ROWS = 100_000
SALTS = 64


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A small local session for tests, examples and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mektup")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is missing and the whole session
    runs on one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix="mektup-")
        spark.conf.set("spark.checkpoint.dir", path)
        return path
    raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


#: Paths made inside each open `scratch_scope`, the innermost last.
_SCOPES: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table through the Hadoop file system it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end; collect or write results before it."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            delete(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which the innermost open scope deletes at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a reader of the written table.

    This cuts the lineage with data that outlives any executor, so later iterations neither
    recompute the input nor depend on cached blocks. Inside a `scratch_scope` the table goes at its end.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread an input that arrives in fewer partitions than there are cores.

    A small file with one row group would otherwise keep a single core busy with all the text
    work. Inputs that already fill the cluster pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salt_from: Column | None = None,
) -> DataFrame:
    """Join ``rows`` to a lookup table on ``key`` without a hot key ending in one task.

    The lookup side is broadcast when its checked size allows it. Beyond that both sides are
    shuffled on (key, salt): ``rows`` draws its salt from ``salt_from`` (a hash of the whole row
    when not given) and every lookup row is repeated once per salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot do a {how} join")
    if is_small(dim, max_rows):
        return rows.join(F.broadcast(dim), key, how)
    source = salt_from if salt_from is not None else F.xxhash64(*[F.col(c) for c in rows.columns])
    salted = rows.withColumn("_salt", F.pmod(source, F.lit(SALTS)).cast("int"))
    spread = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
