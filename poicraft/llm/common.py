"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poicraft.session import scratch_path

#: Run length of the two-level prefix sums.
RUN = 256
#: Texts in one batch between the JVM and Python, at most. A batch is held several times
#: (by the JVM, as Arrow and as strings), and documents have kilobytes each.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of this session's Python functions from now on; a smaller setting stays."""
    rows = int(spark.conf.get(BATCH_CONF))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: later jobs, and tasks of a lost executor, reread the files
    instead of running the plan again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once; a lambda evaluates the
    expressions in it anew for each element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def total(values: Column) -> Column:
    """Sum of an array of bigint (0 if empty)."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def prefix_sums(values: Column) -> Column:
    """Exclusive prefix sums of an array of bigint, as an array of the same size.

    The array is cut into runs, so n values cost about n * RUN additions and
    n / RUN copies of the result, instead of n * n additions.
    """
    none = F.array().cast("array<bigint>")

    def add(acc, run):
        return F.struct((acc["off"] + total(run)).alias("off"), F.concat(acc["out"], F.transform(
            run, lambda _, i: acc["off"] + total(F.slice(run, F.lit(1), i)))).alias("out"))

    def sums(v):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")),
                           lambda r: F.slice(v, r * RUN + 1, F.lit(RUN)))
        start = F.struct(F.lit(0).cast("bigint").alias("off"), none.alias("out"))
        return F.when(F.size(v) > 0, F.aggregate(runs, start, add)["out"]).otherwise(none)

    return let(values, sums)


def rows_by_id(docs: DataFrame, keys: DataFrame, doc_id: str, key: str, how: str) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is (``left_semi``) or isn't (``left_anti``) in ``keys``.

    Always a shuffled join: the keys grow with the documents, so a plan that
    broadcasts them while they are few would change with the input's size.
    """
    d, k = docs.alias("d"), keys.select(F.col(key).alias("k")).hint("merge").alias("k")
    return d.join(k, F.col(f"d.`{doc_id}`") == F.col("k.k"), how)
