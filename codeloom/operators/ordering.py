"""First-seen, first-N and first-N-per-group.

"First" needs an order, so every operator takes ``order_by``, columns in ascending order with null
before all else. Keys need not be unique or present: ties are broken arbitrarily, but a content
keeps one row and a first-N has N rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from codeloom.operators.bitmap import key_bitmap, marked
from codeloom.session import written

# About so many keys reach the driver at once while a bound is looked for.
SAMPLED = 20_000
# Rows of one group that a task may rank when groups are limited in lanes.
TASK_ROWS = 1_000_000


def key_list(order_by: str | Sequence[str]) -> list[str]:
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not keys:
        raise ValueError("order_by is required: 'first' has no meaning without an order")
    return keys


def first_seen_keys(df: DataFrame, same: Column, order_by: str | Sequence[str]) -> DataFrame:
    """Key of the first row for each value of ``same``, one row a value.

    A grouped minimum, so a value that holds a large share of the rows is reduced to one row per
    map task before the shuffle. As part of a struct, a null key counts as the smallest.
    """
    keys = key_list(order_by)
    found = df.select(same.alias("_same"), *keys).groupBy("_same").agg(F.min(F.struct(*keys)).alias("_first"))
    return found.select(*(F.col("_first")[k].alias(k) for k in keys))


def first_seen(
    df: DataFrame, same: Column, order_by: str | Sequence[str], unique_key: bool = False
) -> DataFrame:
    """Rows that are the first of their value of ``same``, exactly one a value.

    Values that come more than once are found on narrow rows and kept as a bitmap of a fixed 4 MB. Rows of
    other values go through as they are; rows of repeated values (and a few others that the bitmap lets
    pass) are reduced to one a value in each map task and then shuffled, once. ``df`` is read
    twice and has to give the same values both times.

    ``unique_key=True`` is the caller's word that ``order_by`` is never null and never shared. Then
    digests are settled on narrow rows and the wide ones are picked by a semi join on the key.
    """
    keys = key_list(order_by)
    if unique_key:
        first = first_seen_keys(df, same, order_by)
        return df.join(first, first.columns, "left_semi").select(*df.columns)
    rows = df.withColumn("_same", same)
    repeated = rows.groupBy("_same").agg(F.count("*").alias("n")).where("n > 1")
    both = marked(rows, "_same", key_bitmap(repeated, "_same"))
    near = both.where("_maybe").groupBy("_same").agg(F.min_by(F.struct(*df.columns), F.struct(*keys)).alias("_row"))
    return both.where("NOT _maybe").select(*df.columns).unionByName(near.select("_row.*"))


def content_digest(text: Column) -> Column:
    """MD5 as 16 bytes: the same equality as the hex digest in half the shuffle volume."""
    return F.unhex(F.md5(text))


def _literal(row: Row, like: DataFrame) -> Column:
    """A key found on the driver as a constant of the table's own types."""
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, like.schema)))


def _same(row: Row) -> tuple:
    """A key as Python compares it: a NaN is equal to itself."""
    return tuple("NaN" if isinstance(v, float) and v != v else v for v in row)


def nth_key(keys: DataFrame, n: int) -> tuple[Row | None, int, int]:
    """The ``n``-th smallest row of a narrow key table: (key, rows below it, rows equal to it).

    ``None`` if there are fewer than ``n``. Some 20,000 sampled keys give two bounds close around the
    ``n``-th. One pass of comparisons counts the rows below, at and between them and samples those between (or
    brings all, if they are that few), and so on: a pass leaves about a fortieth of the rows. So a count,
    a sample and a pass do for a million rows, and two passes more for a billion, whatever ``n`` is.
    Nothing is shuffled or sorted but the samples; equal keys, however many, are only counted.
    """
    key = F.struct(*keys.columns)
    inside, below, size, held = keys, 0, keys.count(), None
    while True:
        if n - below > size:
            return None, below, 0
        share = min(1.0, SAMPLED / max(1, size))
        if held is None:
            chosen = inside if share == 1 else inside.where(F.rand(17) < share)
            held = chosen.agg(F.sort_array(F.collect_list(key)).alias("keys")).first()["keys"]
        if len(held) >= size:
            found = held[n - below - 1]
            first = next(i for i, k in enumerate(held) if _same(k) == _same(found))
            return found, below + first, sum(_same(k) == _same(found) for k in held)
        if not held:
            held = None
            continue
        near = (n - below) / size * len(held)
        wide = 4 * (near * max(0.0, 1 - near / len(held))) ** 0.5 + 2
        # Beyond the ends of the sample there is no bound.
        lo = held[int(near - wide)] if near >= wide else None
        hi = held[int(near + wide)] if near + wide < len(held) else None
        none = F.lit(False)
        under, at = (none, none) if lo is None else (key < _literal(lo, keys), key == _literal(lo, keys))
        over, end = (none, none) if hi is None else (key > _literal(hi, keys), (key == _literal(hi, keys)) & ~at)
        between = ~(under | at | end | over)
        share = min(1.0, SAMPLED / max(1.0, 2 * wide / len(held) * size))
        counts = inside.withColumn("_draw", F.rand(18)).agg(
            *(F.count_if(c).alias(name) for name, c in (("under", under), ("at", at), ("between", between), ("end", end))),
            F.sort_array(F.collect_list(F.when(between & (F.col("_draw") < share), key))).alias("keys"),
        ).first()
        held = None
        if n <= below + counts["under"]:
            inside, size = inside.where(under), counts["under"]
            continue
        below += counts["under"]
        if n <= below + counts["at"]:
            return lo, below, counts["at"]
        below += counts["at"]
        if n <= below + counts["between"]:
            inside, size, held = inside.where(between), counts["between"], counts["keys"]
            continue
        below += counts["between"]
        if n <= below + counts["end"]:
            return hi, below, counts["end"]
        size -= counts["under"] + counts["at"] + counts["between"] + counts["end"]
        inside, below = inside.where(over), below + counts["end"]


def upto(df: DataFrame, keys: Sequence[str], bound: Row) -> DataFrame:
    """Rows whose key is ``bound`` or below; what follows for the first column reaches the scan."""
    first = F.col(keys[0])
    plain = first.isNull() if bound[0] is None else first.isNull() | (first <= F.lit(bound[0]).cast(df.schema[keys[0]].dataType))
    return df.where(plain & (F.struct(*keys) <= _literal(bound, df.select(*keys))))


def first_n(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``order_by``.

    The bound is looked up on narrow keys (small jobs, the same for every ``n``); the result is then a
    filter on the table, with no sort, join or shuffle. Only where rows beyond the ``n``-th share its key
    are rows of that one key counted off.
    """
    if n <= 0:
        return df.limit(0)
    keys = df.select(*key_list(order_by))
    return upto_nth(df, keys, n, *nth_key(keys, n))


def upto_nth(df: DataFrame, keys: DataFrame, n: int, bound: Row | None, below: int, equal: int) -> DataFrame:
    """The first ``n`` rows of ``df`` by the columns of ``keys``, given what ``nth_key`` says of them."""
    if bound is None:
        return df
    key, last, reached = F.struct(*keys.columns), _literal(bound, keys), upto(df, keys.columns, bound)
    if below + equal == n:
        return reached
    return reached.where(key < last).unionByName(df.where(key == last).limit(n - below))


def first_n_per_group(
    df: DataFrame, n: int, group: str | Sequence[str], order_by: str | Sequence[str], lanes: int | None = None
) -> DataFrame:
    """At most ``n`` rows of each group, first by ``order_by``.

    Groups are first limited in ``lanes`` of their own (as many as there are shuffle partitions), as the
    first ``n`` of a group are among the first ``n`` of each lane; so no task sorts a whole hot group.
    Spark limits small ``n`` in each map task as well. Where ``n`` rows of each lane would be more than
    ``TASK_ROWS`` for one task, the ``n``-th key of each group is looked up instead; see ``first_n_by_bounds``.
    """
    groups = [group] if isinstance(group, str) else list(group)
    keys = key_list(order_by)
    lanes = lanes or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n * lanes > TASK_ROWS:
        return first_n_by_bounds(df, n, groups, keys)

    def limited(rows: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
        return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")

    lane = F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(lanes))
    return limited(limited(df.withColumn("_lane", lane), [*groups, "_lane"]).drop("_lane"), groups)


def group_bounds(df: DataFrame, n: int, group: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``n``-th smallest key of each group with more than ``n`` rows: ``_group, _bound, _below, _equal``.

    Equal keys are counted first, in each map task and then once. What is left, narrow and without
    repeats, is dealt out by ranges of group and key and written, so that a hot group lies in many
    parts of even size; the counts of the parts tell in which one the ``n``-th key is, and only that part of
    each group is ranked. ``_below`` rows are smaller than the bound and ``_equal`` share it.
    """
    counted = (
        df.select(F.struct(*group).alias("_group"), F.struct(*order_by).alias("_key"))
        .groupBy("_group", "_key")
        .agg(F.count("*").alias("_n"))
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(parts, "_group", "_key").withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "group-keys")
    # At most one row a group and part.
    sums = dealt.groupBy("_group", "_part").agg(F.sum("_n").alias("_rows"), F.min("_key").alias("_least"))
    upto_here = F.sum("_rows").over(Window.partitionBy("_group").orderBy("_least"))
    place = sums.withColumn("_reached", upto_here).withColumn("_before", F.col("_reached") - F.col("_rows"))
    total = F.sum("_rows").over(Window.partitionBy("_group"))
    place = place.withColumn("_total", total).where(f"_total > {n} AND _before < {n} AND _reached >= {n}")
    place = place.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), "_before")
    near = dealt.join(place, dealt["_group"].eqNullSafe(place["_g"]) & (dealt["_part"] == place["_p"]))
    running = F.col("_before") + F.sum("_n").over(Window.partitionBy("_group", "_part").orderBy("_key"))
    ranked = near.withColumn("_upto", running).withColumn("_below", F.col("_upto") - F.col("_n"))
    return ranked.where(f"_below < {n} AND _upto >= {n}").select(
        "_group", F.col("_key").alias("_bound"), "_below", F.col("_n").alias("_equal")
    )


def first_n_by_bounds(df: DataFrame, n: int, group: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """At most ``n`` rows of each group, for any ``n``: a filter of ``df`` by the ``n``-th key of its group.

    The bounds are one row a group with more than ``n`` rows, so their number is at most the rows by ``n``. Wide
    rows are neither sorted nor ranked. Only where rows beyond the ``n``-th share its key are these rows
    written and counted off, part by part. ``df`` is read twice and has to give the same keys both times.
    """
    if n <= 0:
        return df.limit(0)
    bounds = written(group_bounds(df, n, group, order_by), "group-bounds").withColumnRenamed("_group", "_of")
    key = F.struct(*order_by)
    met = df.join(bounds, F.struct(*group).eqNullSafe(F.col("_of")), "left")
    whole = F.col("_bound").isNull() | (key < F.col("_bound"))
    tied = F.col("_below") + F.col("_equal") > n
    same = key == F.col("_bound")
    if bounds.where(tied).isEmpty():
        return met.where(whole | same).select(*df.columns)
    ties = met.where(same & tied).withColumn("_part", F.spark_partition_id())
    ties = written(ties.withColumn("_seq", F.monotonically_increasing_id()), "group-ties")
    # Rows of one map task are numbered within it, and tasks by what those before them hold.
    sums = ties.groupBy("_of", "_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_of").orderBy("_part")) - F.col("_rows")
    sums = sums.select(F.col("_of").alias("_g"), F.col("_part").alias("_p"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_of", "_part").orderBy("_seq"))
    numbered = ties.withColumn("_place", within).join(
        sums, ties["_of"].eqNullSafe(sums["_g"]) & (ties["_part"] == sums["_p"])
    )
    counted_off = numbered.where("_below + _before + _place <= " + str(n)).select(*df.columns)
    return met.where(whole | (same & ~tied)).select(*df.columns).unionByName(counted_off)
