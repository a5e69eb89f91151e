"""Exact order statistics of string keys per group, by histograms of key prefixes.

Used to cut ordered groups into parts without sorting, numbering or copying their rows: a few passes over
group and key find the cut keys, and one narrow pass compares each row with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaglint.operators.ranking import _null_safe_join, numbered
from seaglint.session import ensure_checkpoint_dir

#: Keys of one range that are sorted in one array, and characters that a pass looks ahead.
SMALL, AHEAD = 10_000, 3
#: Groups up to which ranges and cuts are sent to all tasks, so that rows are not shuffled by group.
FEW_GROUPS = 10_000


def _common(low: Column, high: Column) -> Column:
    """How many characters all keys from ``low`` to ``high`` begin with alike."""
    n = F.least(F.length(low), F.length(high))
    same = F.sequence(F.lit(0), n)
    return F.aggregate(same, F.lit(0), lambda most, i: F.when(F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i), i).otherwise(most))


def cut_texts(rows: DataFrame, by: list[str], key: str, places: list[Column], small: int = SMALL) -> DataFrame:
    """For each group and each of ``places`` the key at that place of the group's order.

    ``places`` are whole numbers given by expressions of ``n``, the rows of the group. Returns ``by``, n and,
    for place i, ``key_i`` and ``take_i``: of the rows with this very key, ``take_i`` of ``equal_i`` belong
    to the first ``places[i]`` rows. Places of 0 have null keys. Keys must not be null; they order as text.

    A range of keys that holds a place is cut by the next characters after those that all its keys share;
    counts are combined before the shuffle, so a group may hold all rows. A range that is small enough, or
    has one key only, ends the search. Each pass reads ``by`` and ``key`` only. Up to ``FEW_GROUPS`` groups
    the ranges come to the rows, as a few large groups would each meet in one task.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    slim = rows.select(*by, F.col(key).alias("_text"))
    stats = [F.count("*").alias("_n"), F.min("_text").alias("_low"), F.max("_text").alias("_high")]
    groups = slim.groupBy(*by).agg(*stats).withColumn("n", F.col("_n")).checkpoint()
    few = _few(groups)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("_place"), p.cast("bigint").alias("_need")) for i, p in enumerate(places)])).alias("_w")
    open_ranges = groups.select(*by, "_n", "_low", "_high", wanted).select(*by, "_n", "_low", "_high", "_w._place", "_w._need").where("_need > 0")
    found = []
    while True:
        one_key = F.col("_low") == F.col("_high")
        found.append(open_ranges.where(one_key).select(*by, "_place", F.col("_low").alias("_cut"), F.col("_need").alias("_take"), F.col("_n").alias("_equal")))
        short = open_ranges.where(~one_key & (F.col("_n") <= small))
        keys = _in_range(slim, short, by, few).groupBy(*by, "_place", "_need").agg(F.sort_array(F.collect_list("_text")).alias("_texts"))
        cut = F.get("_texts", (F.col("_need") - 1).cast("int"))
        listed = keys.withColumn("_cut", cut)
        before = F.size(F.filter("_texts", lambda k: k < F.col("_cut")))
        equal = F.size(F.filter("_texts", lambda k: k == F.col("_cut")))
        found.append(listed.select(*by, "_place", "_cut", (F.col("_need") - before).alias("_take"), equal.cast("bigint").alias("_equal")))
        long = open_ranges.where(~one_key & (F.col("_n") > small))
        if long.isEmpty():
            break
        shared = long.withColumn("_shared", _common(F.col("_low"), F.col("_high")))
        part = F.substring(F.col("_text"), F.col("_shared") + 1, F.lit(AHEAD)).alias("_part")
        counts = _in_range(slim, shared, by, few).groupBy(*by, "_place", "_need", part).agg(*stats)
        upto = F.sum("_n").over(Window.partitionBy(*by, "_place").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        open_ranges = placed.select(*by, "_n", "_low", "_high", "_place", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")).checkpoint()
    cuts = reduce(DataFrame.unionByName, found)
    columns = []
    for i in range(len(places)):
        here = F.col("_place") == i
        columns += [F.max(F.when(here, F.col(c))).alias(f"{name}_{i}") for c, name in (("_cut", "key"), ("_take", "take"), ("_equal", "equal"))]
    return _null_safe_left_join(groups.select(*by, "n"), cuts.groupBy(*by).agg(*columns), by).checkpoint()


def _few(groups: DataFrame) -> bool:
    return groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS


def _in_range(slim: DataFrame, ranges: DataFrame, by: list[str], few: bool) -> DataFrame:
    """The keys that lie in a range of their group, beside the columns of the range."""
    return _null_safe_join(slim, F.broadcast(ranges) if few else ranges, by).where(F.col("_text").between(F.col("_low"), F.col("_high")))


def _null_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys], F.lit(True))
    return left.join(renamed, same, "left").drop(*[f"_r{k}" for k in keys])


def cut_groups(rows: DataFrame, by: list[str], key: Column, places: list[Column], names: list[str], out: str, small: int = SMALL) -> DataFrame:
    """``rows`` with ``out``: the first of ``names`` for the rows up to the first place, and so on.

    ``names`` has one entry more than ``places``, which ascend. Null keys come first. Rows with the very key
    of a cut are told apart by a hash of all their columns; only if some of them stay on each side are
    these rows numbered.
    """
    groups = [*by, "_all"] if not by else list(by)
    keyed = rows.withColumn("_all", F.lit(0)) if not by else rows
    keyed = keyed.withColumn("_text", F.coalesce(key.cast("string"), F.lit("")))
    cuts = cut_texts(keyed, groups, "_text", places, small)
    torn = [F.col(f"take_{i}") < F.col(f"equal_{i}") for i in range(len(places))]
    joined = _null_safe_join(keyed, F.broadcast(cuts) if _few(cuts) else cuts, groups)
    at = reduce(lambda a, b: a | b, [F.coalesce(t & (F.col("_text") == F.col(f"key_{i}")), F.lit(False)) for i, t in enumerate(torn)])
    nth = F.lit(None).cast("bigint")
    if not cuts.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in torn])).isEmpty():
        whole = joined.where(~at).withColumn("_nth", nth)
        tied = numbered(joined.where(at).withColumn("_mix", F.xxhash64(*rows.columns)), [*groups, "_text"], ["_mix"], "_nth").drop("_mix")
        joined = whole.unionByName(tied)
    else:
        joined = joined.withColumn("_nth", nth)
    choice = F.lit(names[-1])
    for i in reversed(range(len(places))):
        k = F.col(f"key_{i}")
        inside = (F.col("_text") < k) | ((F.col("_text") == k) & F.coalesce(F.col("_nth") <= F.col(f"take_{i}"), F.lit(True)))
        choice = F.when(F.coalesce(inside, F.lit(False)), names[i]).otherwise(choice)
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], choice.alias(out))
