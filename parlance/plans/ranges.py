"""Ordered work over rows of a key when one key may hold most rows: sampled ranges and a carry.

``repartitionByRange`` samples ``(keys..., order)`` and deals the rows into ranges of about equal size,
whatever the values are and however many rows a key has. The ranges are written once as a table
bucketed by the range's number, so one assignment holds for all later steps and retries, and windows
inside a range need no further exchange: the rows cross the network once. What has to pass from one
range to the next is a row per range (``partitions`` rows, a setting): the first row of the next
range, or the running value at the end of the ones before.

``(keys..., order)`` should identify a row; rows that tie lie in one range, in the order of ``tie``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.io import materialize_buckets

PART = "_part"


def in_ranges(df: DataFrame, order: list[str], name: str = "ranges", partitions: int | None = None) -> DataFrame:
    """``df`` with its range's number ``_part``, written and bucketed by it."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id())
    return materialize_buckets(dealt, name, [PART], n)


def _same(a: Column, b: Column, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def next_row(df: DataFrame, keys: list[str], order: list[str], fields: list[str], out: str = "_next",
             tie: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: a struct of ``fields`` of the next existing row of the same ``keys`` in
    ``order``, null at a key's last row."""
    sort = [*keys, *order]
    r = in_ranges(df, sort, "next-row", partitions)
    by = [F.col(c) for c in [*sort, *(tie or [])]]
    own = F.struct(F.struct(*keys).alias("k"), F.struct(*fields).alias("f"))
    following = F.lead(own).over(Window.partitionBy(PART).orderBy(*by))
    heads = r.groupBy(PART).agg(F.min_by(own, F.struct(*by)).alias("_head"))
    # a row per range: its window runs over them alone
    after = heads.select(PART, F.lead("_head").over(Window.orderBy(PART)).alias("_head"))
    x = r.withColumn("_f", following).join(after, PART, "left").withColumn("_f", F.coalesce("_f", "_head"))
    same = _same(F.struct(*keys), F.col("_f.k"), keys)
    return x.withColumn(out, F.when(F.col("_f").isNotNull() & same, F.col("_f.f"))).drop(PART, "_f", "_head")


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]],
            partitions: int | None = None) -> DataFrame:
    """``df`` with running values over the rows of the same ``keys`` up to each row in ``order``.
    ``values``: ``{out: (column, how)}`` with ``how`` of ``sum``, ``max``, ``min`` (associative, so a range's total
    is enough to go on from); a null adds nothing."""
    how = {"sum": F.sum, "max": F.max, "min": F.min}
    merge = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
             "max": F.greatest, "min": F.least}  # both skip nulls
    r = in_ranges(df, [*keys, *order], "running", partitions)
    key = F.struct(*keys)
    # the range table: first and last key, and the totals of each key that ends or begins a range
    per_key = r.groupBy(PART, *keys).agg(*[how[h](c).alias(o) for o, (c, h) in values.items()])
    totals = F.struct(*values)
    ends = per_key.groupBy(PART).agg(F.min(key).alias("_first"), F.max(key).alias("_last"),
                                     F.max_by(totals, key).alias("_t"))
    # ranges that end in one key follow one another, so their totals add up over this table alone
    up_to = Window.partitionBy("_last").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select(PART, "_first", "_last", *[how[h](F.col(f"_t.{o}")).over(up_to).alias(f"_u_{o}")
                                                 for o, (_, h) in values.items()])
    before = Window.orderBy(PART)
    carry = ends.select(PART, "_first", F.lag("_last").over(before).alias("_before"),
                        *[F.lag(f"_u_{o}").over(before).alias(f"_c_{o}") for o in values])
    w = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = r.select("*", *[how[h](c).over(w).alias(o) for o, (c, h) in values.items()]).join(carry, PART, "left")
    goes_on = _same(key, F.col("_first"), keys) & _same(key, F.col("_before"), keys) & F.col("_before").isNotNull()
    for o, (_, h) in values.items():
        x = x.withColumn(o, merge[h](F.when(goes_on, F.col(f"_c_{o}")), F.col(o)))
    return x.drop(PART, "_first", "_before", *[f"_c_{o}" for o in values])


def joined_text(df: DataFrame, keys: list[str], order: list[str], text: str, sep: str, out: str = "text",
                partitions: int | None = None) -> DataFrame:
    """``keys, out``: the texts of a key joined in ``order``. Each range joins its rows, many tasks for a
    large key, and a key's row gathers one finished piece a range, not its rows."""
    r = in_ranges(df.select(*keys, *order, text), [*keys, *order], "joined-text", partitions)
    piece = F.array_join(F.col("_l._t"), sep)
    per = (r.groupBy(PART, *keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t")))).alias("_l"))
           .select(PART, *keys, piece.alias("_piece")))
    whole = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(PART, "_piece"))).alias("_p"))
    return whole.select(*keys, F.array_join(F.col("_p._piece"), sep).alias(out))


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int, out: str = "_rn") -> DataFrame:
    """The first ``k`` rows of every key with their number from 1. Spark limits groups before the
    shuffle too (``WindowGroupLimit``), so a task sends ``k`` rows of a key at most."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, n).where(F.col(out) <= k)
