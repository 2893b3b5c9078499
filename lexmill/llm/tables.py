"""Small helpers shared by the operators: reading tables, cutting lineage, running Arrow functions per batch."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that go to a Python worker at once (a longer row goes alone).
ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that is set, else the one the cluster names in `spark.checkpoint.dir`; one of our
    own only in local mode, as executors elsewhere could not read it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexmill-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside drops its shuffle files when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: a lost executor does not lose them. The shuffles that made
    them are dropped, as nothing reads them again."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a plan made here: it takes the setting from now


def n_rows(df: DataFrame) -> int:
    """The number of rows, without shuffle files left behind."""
    with shuffles_dropped(df.sparkSession):
        return df.count()


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Run `make` on each Arrow batch inside the tasks; it yields column dicts in the order of `schema`.

    The session's batch bounds are lowered where they are larger, never raised: Spark reads them when the query runs.
    """
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        have = _number(df.sparkSession.conf.get(key))
        if not 0 < have <= most:
            df.sparkSession.conf.set(key, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in make(batch):
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n", heavy: int = 256) -> DataFrame:
    """Inner join of `rows` with `counted`, which has one row a key and in `n` how many of `rows` have it.

    The `heavy` keys with most rows are broadcast (a fixed number); each of the others holds at most rows / heavy,
    so the shuffle that joins them has no hot task however a key is copied.
    """
    # Ties are broken by the keys: `top` is found twice, and both must be the same rows.
    top = counted.orderBy(F.desc(n), *keys).limit(heavy)
    small = rows.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(counted, keys)
    return small.unionByName(rows.join(F.broadcast(top), keys))


def running_sums(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Rows with `before_<c>` for each of `columns`: its sum over all rows that come earlier in `order`.

    Rows are dealt out by ranges of the order, so no task has them all; one number a range goes through one task.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(c).alias(c) for c in columns])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"before_{c}": F.sum(c).over(inside) - F.col(c) + F.col(f"_{c}") for c in columns}
    return dealt.join(F.broadcast(ranges), "_range").withColumns(sums).drop("_range", *[f"_{c}" for c in columns])


def frequent(rows: DataFrame, column: str, least: int = 6, most: int = 4096) -> DataFrame:
    """(column, frequent): the values that at least `least` of some sampled rows have, at most `most` of them.

    They only decide how rows are dealt out, never what is found.
    """
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return checkpointed(counts.orderBy(F.desc("n"), column).limit(most).select(column, F.lit(True).alias("frequent")))


def salted(rows: DataFrame, often: DataFrame, column: str, by: str, salts: int = 16) -> DataFrame:
    """Rows with `frequent` and a salt made of `by`, which is 0 for values that are not in `often` (of frequent())."""
    rows = rows.join(F.broadcast(often), column, "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    return rows.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0).cast("long")))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def _number(setting: str) -> int:
    digits = setting.strip().lower().removesuffix("b")
    return int(digits) if digits.lstrip("-").isdigit() else 0


def typed(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast where their type is another (so that equal plans stay equal)."""
    have = dict(df.dtypes)
    return df.select(*[df[c] if have[c] == t else df[c].cast(t).alias(c) for c, t in types.items()])
