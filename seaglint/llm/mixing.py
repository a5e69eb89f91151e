"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source puts its documents in a shuffled order (a hash of the document) and repeats that order up to
three times. A copy's virtual finish time is the words its source has sent up to and with it, divided by
the source's target. All copies are range-sorted by finish time and the mix ends at the total budget, so
every source comes within about one document of its target. Both running sums are cut into slices of the
global order; neither a hot source nor the whole mix meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaglint.llm.common import materialise, running_sum, space_words

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix"


def shuffle_key(id_col: Column, text: Column) -> Column:
    """A hash that puts documents in a random but repeatable order."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size and target of each source; sources by code point (null last) weigh ``weights``, repeating.

    Targets share the size of all sources by weight; one that would exceed ``max_copies`` times its source
    stops there and the others share the rest by weight. With sources ordered by size over weight, those
    that stop come first, so running sums over the sources give the level of the others.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name)
    weighed = sizes.select("*", number.alias("number"), F.element_at(F.array(*map(F.lit, weights)), (number - 1) % len(weights) + 1).cast("double").alias("weight"))
    cap = F.col("source_size") * max_copies
    ranked = Window.orderBy(cap / F.col("weight"), "number")
    level = weighed.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum(cap).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("rest"),
        F.sum("weight").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights"),
    )
    # The first source that does not stop sets the level; later ones would give a lower one.
    shared = F.max(F.when(F.col("rest") / F.col("weights") * F.col("weight") <= cap, F.col("rest") / F.col("weights"))).over(Window.partitionBy(F.lit(0)))
    return level.select("source", "source_size", "number", "weight", F.least(cap.cast("double"), shared * F.col("weight")).alias("target"))


def fair_queue(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents' sizes and shares of the mix: id, key, size, source_size, target, copies, taken.

    ``key`` is the shuffle key; rows of the same id and text share it, and the mix takes each as a document
    of its own. Size counts words ``[^\\x20\\x09-\\x0D]+`` (null: 0); documents of size 0 take no room and are
    not taken. A null source is a source of its own. ``copies`` (0 to ``max_copies``) says how often the
    mix has the document. An empty table gives an empty one.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.size(space_words(F.col(text_col))).cast("long").alias("size"),
            shuffle_key(F.col(id_col), F.col(text_col)).alias("key"),
        )
    )
    targets = source_targets(sized, weights, max_copies)
    sent = running_sum(sized, ["source"], ["key"], "size", "sent").alias("d")
    t = targets.alias("t")
    queued = materialise(sent.join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "number", "target"))

    room = F.nullif(F.col("target"), F.lit(0.0))
    finish = (F.col("sent") + F.col("copy") * F.col("source_size")) / room
    copies = queued.where("size > 0").select("number", "source_size", "target", "size", "sent", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))).alias("copy"))
    times = copies.select(finish.alias("finish"), "number", "size")
    # Two rows of fixed size reach the driver: the budget, and the last copy that fits into it.
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    filled = running_sum(times, [], ["finish", "number"], "size", "filled")
    last = filled.where(F.col("filled") <= budget).agg(F.max(F.struct("finish", "number")).alias("last")).first()["last"]
    end = F.struct(*[F.lit(v).cast(kind) for v, kind in zip(last or (None, None), ("double", "int"))])
    in_mix = lambda c: F.struct(((F.col("sent") + F.lit(c) * F.col("source_size")) / room).alias("finish"), F.col("number")) <= end
    taken = sum((F.when(in_mix(c), 1).otherwise(0) for c in range(1, max_copies)), F.when(in_mix(0), 1).otherwise(0))
    counted = queued.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0))
    return counted.select("id", "key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: each document as often as the mix takes it, with the columns of ``docs``."""
    columns = docs.columns
    queue = fair_queue(docs, text_col=text_col, id_col=id_col, source_col=source_col, **options)
    # Rows with the same key are the same text; each takes one entry of the key's list of copies.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), shuffle_key(F.col(id_col), F.col(text_col)).alias("_key"))
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))))
    listed = queue.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    joined = numbered.join(listed, "_key").withColumn("_times", F.element_at("_copies", F.col("_n")))
    return joined.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
