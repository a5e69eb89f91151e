"""What the text operators share: words, row carrying, materialising, slices of a global order."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seaglint.session import ensure_checkpoint_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a Python task holds as words at a time.
SLICE_BYTES = 2_000_000
#: Rows of an Arrow batch; a batch of very long texts stays small.
BATCH_ROWS = "512"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(blank, " "), "")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder of the session."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def prepare(spark: SparkSession) -> None:
    """Ship the package to the tasks and keep Arrow batches of long texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def give_back() -> None:
    """Return freed memory to the system, as a worker that waits for its next task still holds it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of texts with about ``limit`` bytes; a longer text has a run of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    docs: DataFrame,
    fn: Callable[[Iterator[list[bytes]]], Iterator[dict[str, list]]],
    schema: str,
    text_col: str = "text",
) -> DataFrame:
    """Adds to each row what ``fn`` computes from its text (UTF-8; null: empty).

    ``fn`` is called once for each task with runs of texts and yields a dict of equally long columns
    for each run. Columns of the input with a name of ``schema`` are replaced.
    """
    prepare(docs.sparkSession)
    added = T._parse_datatype_string(schema)
    keep = [c for c in docs.columns if c not in added.names]
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).cast("int").alias("row"),
        F.coalesce(F.encode(F.col(text_col), "utf-8"), F.lit(b"")).alias("bytes"),
    )
    out = T.StructType([held.schema["row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def runs():
            for b in batches:
                texts = b.column("bytes").to_pylist()
                for lo, hi in slices(texts):
                    rows.append(b.column("row").slice(lo, hi - lo))
                    yield texts[lo:hi]

        for found in fn(runs()):
            cols = [pa.array(found[f.name], type=ARROW[f.dataType.simpleString()]) for f in added.fields]
            yield pa.RecordBatch.from_arrays([rows.pop(0), *cols], names=["row", *added.names])
        give_back()

    made = held.mapInArrow(run, out)
    return made.select(*([f"row.`{c}`" for c in keep] + [f"`{f}`" for f in added.names]))


ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<double>": pa.list_(pa.float64()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def order_slices(df: DataFrame, *order: Column) -> DataFrame:
    """The rows cut into consecutive slices of a global order; ``_slice`` numbers them.

    The slices are written to the shared folder, so that every later reader sees the same ones.
    """
    return materialise(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the group up to and with this one, in ``order``.

    No group meets in one task: each slice of the global order sums its own rows, and slices are shifted
    by the totals of those before them (one row for each slice and group).
    """
    cut = order_slices(df, *[F.col(c) for c in [*group, *order]])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group, "_slice").agg(F.sum(value).alias("_total"))
    shift = totals.select(*group, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_slice"]]
    joined = cut.alias("a").join(shift.alias("b"), on=same, how="inner").select("a.*", "_before")
    return joined.withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_before", "_slice")
