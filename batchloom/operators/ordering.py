"""Positions, chunks and successors without a window over the whole table.

A row's position is counted in two steps. Rows fall into buckets that follow
the order; a small table of bucket sizes gives each bucket its offset; a window
then numbers the rows inside one bucket. No task sees more than one bucket, so
one input holding most of the rows is no harder than many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.session import materialized

BUCKET_BITS = 16  # positions per bucket: 65,536
RANGE_ROWS = 1 << 20  # rows of a range of names


def _offsets(sizes: DataFrame, group: Sequence[str], above: Callable[[Column], Column], bucket: str) -> DataFrame:
    """Sum of the sizes of all earlier buckets of the group: __offset_of, __offset.

    Buckets are added up in buckets of buckets, ``above`` them: 65,536 positions'
    buckets each, or the parts of one range. The last window sees one row of these.
    """
    key, before = F.col("__key"), (Window.unboundedPreceding, -1)
    placed = sizes.withColumn("__of", F.struct(*[key[g].alias(g) for g in group], above(key[bucket]).alias("__above")))
    tops = placed.groupBy("__of").agg(F.sum("__size").alias("__total"))
    of = F.col("__of")
    earlier = Window.partitionBy(*[of[g] for g in group]).orderBy(of["__above"]).rowsBetween(*before)
    tops = tops.select(of.alias("__top"), F.sum("__total").over(earlier).alias("__before"))
    inside = Window.partitionBy("__of").orderBy(key[bucket]).rowsBetween(*before)
    joined = placed.join(tops, placed["__of"] == tops["__top"], "left")
    total = F.coalesce("__before", F.lit(0)) + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    return joined.select(key.alias("__offset_of"), total.alias("__offset"))


def _high(bucket: Column) -> Column:
    return F.shiftright(bucket, BUCKET_BITS)


def _first_range(bucket: Column) -> Column:
    return bucket[0]


def _parts(part: Column) -> Column:
    """The part files of a list are added up at once: there are thousands, not millions."""
    return F.lit(0)


def _blocks(start: Column) -> Column:
    """Blocks of a file by their 64 GB."""
    return F.shiftright(start, 36)


def _sum_before(
    df: DataFrame,
    value: Column,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    name: str,
    above: Callable[[Column], Column] = _high,
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the group, bucket by bucket.

    Group and bucket are joined as one struct: nulls match each other, and the
    join and the window share one partitioning. Only buckets behind the first of
    their group have an offset, so the joined table holds large groups only.
    """
    keyed = df.withColumn("__key", F.struct(*group, bucket))
    sizes = keyed.groupBy("__key").agg(F.sum(value).alias("__size"))
    offsets = _offsets(sizes, group, above, bucket).filter(F.col("__offset") != 0)
    joined = keyed.join(offsets, keyed["__key"] == offsets["__offset_of"], "left")
    inside = Window.partitionBy("__key").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    total = F.coalesce("__offset", F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.select(*df.columns, total.cast("bigint").alias(name))


def sum_before(
    df: DataFrame, value: Column, pos: str, group: Sequence[str] = (), name: str = "offset"
) -> DataFrame:
    """Sum of ``value`` over the rows before this one; ``pos`` is an integer order."""
    marked = df.withColumn("__bucket", F.shiftright(F.col(pos).cast("bigint"), BUCKET_BITS))
    return _sum_before(marked, value, group, "__bucket", [pos], name).drop("__bucket")


def row_index(
    df: DataFrame, pos: str, group: Sequence[str] = (), name: str = "row_index"
) -> DataFrame:
    """0-based position of each row in its group; ``pos`` is a unique integer order."""
    return sum_before(df, F.lit(1), pos, group, name)


def ranges(df: DataFrame, keys: Sequence[str], most: int = RANGE_ROWS) -> DataFrame:
    """Rows written in ranges of the keys of at most ``most`` rows each, told by ``__bucket``.

    Range partitions that hold more are cut again, until none does; ``__tie`` tells
    equal rows apart, so a single key can be cut, too. A bucket is a list of range
    numbers, one per cut, and lists compare in the order of the keys.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    cut = tied.repartitionByRange(*keys, "__tie").withColumn("__bucket", F.array(F.spark_partition_id()))
    left, done = materialized(cut, "ranges"), None
    for depth in range(1, 40):
        # As many rows as there are ranges above the bound, a few per partition of the last cut.
        big = left.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()
        if not big:
            return left if done is None else done.unionByName(left)
        inside = F.col("__bucket").isin(*[F.array(*[F.lit(x) for x in r["__bucket"]]) for r in big])
        small = left.filter(~inside)
        done = small if done is None else done.unionByName(small)
        parts = sum(-(-r.n // most) for r in big) * 2 * depth
        again = left.filter(inside).repartitionByRange(parts, "__bucket", *keys, "__tie")
        again = again.withColumn("__bucket", F.concat("__bucket", F.array(F.spark_partition_id())))
        left = materialized(again, "ranges")
    raise ValueError("ranges cannot be cut below their bound")


def row_index_by(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "row_index", most: int = RANGE_ROWS
) -> DataFrame:
    """0-based position of each row in its group, for orders that are not integers, such as names.

    Buckets are ranges of bounded size, which are written once, so both steps see the same.
    """
    fixed = ranges(df, [*group, *order], most)
    placed = _sum_before(fixed, F.lit(1), group, "__bucket", [*order, "__tie"], name, _first_range)
    return placed.drop("__bucket", "__tie")


def line_numbers(df: DataFrame, group: str, block: str, order: str, name: str) -> DataFrame:
    """1-based line number in a file, from block starts and the order inside a block."""
    indexed = _sum_before(df, F.lit(1), [group], block, [order], name, _blocks)
    return indexed.withColumn(name, F.col(name) + 1)


def places_in_list(lines: DataFrame, part: str, of_list: Column, pos: str) -> DataFrame:
    """Positions over the parts of lists that are cut in several files.

    The parts of a list follow each other by name; ``pos`` is the place in a part.
    The result has the list in ``part`` and the place in the list in ``pos``.
    """
    keyed = lines.withColumn("__list", of_list)
    counted = _sum_before(keyed, F.lit(1), ["__list"], part, [pos], "__place", _parts)
    return counted.withColumn(part, F.col("__list")).withColumn(pos, F.col("__place") + 1).select(*lines.columns)


def chunks(df: DataFrame, batch_size: int, index: str = "row_index") -> DataFrame:
    """Add the chunk number and the offset of the chunk's first row."""
    number = F.expr(f"`{index}` div {int(batch_size)}")
    return df.withColumn("chunk", number).withColumn(
        "chunk_offset", F.col("chunk") * F.lit(int(batch_size)).cast("bigint")
    )


def _list_keys(job_list: DataFrame) -> list[str]:
    return ["uri"] if "uri" in job_list.columns else []


def successors(job_list: DataFrame) -> DataFrame:
    """For every label of a list: the entry listed after it.

    ``job_list`` has pos, label, config_uri, and uri where there are several
    lists; each list is on its own. The first place of a repeated label decides.
    The last entry has no successor. Inside a bucket the next row is found by a
    window; behind its last row comes the head of the next bucket, from the small
    table of bucket heads.
    """
    keys = _list_keys(job_list)
    entry = F.struct("pos", "label", "config_uri")
    placed = job_list.select(
        F.struct(*keys, F.shiftright(F.col("pos").cast("bigint"), BUCKET_BITS).alias("bucket")).alias("__key"),
        "pos", "label", "config_uri",
    )
    heads = placed.groupBy("__key").agg(F.min(entry).alias("__head"))
    lists = Window.partitionBy(*[F.col("__key")[k] for k in keys])
    behind = heads.select(
        F.col("__key").alias("__of"), F.lead("__head").over(lists.orderBy(F.col("__key")["bucket"])).alias("__head")
    )
    inside = Window.partitionBy("__key").orderBy("pos")
    following = F.coalesce(F.lead(entry).over(inside), F.col("__head"))
    steps = placed.join(behind, placed["__key"] == behind["__of"], "left").select(
        *[F.col("__key")[k].alias(k) for k in keys], "label", F.struct("pos", following.alias("next")).alias("step")
    )
    return (
        steps.groupBy(*keys, "label")
        .agg(F.min("step")["next"].alias("next"))
        .select(
            *keys,
            "label",
            F.col("next.label").alias("next_label"),
            F.col("next.config_uri").alias("next_config_uri"),
        )
    )


def first_entry(job_list: DataFrame) -> DataFrame:
    """The first entry of every list (of the one list, where there is no uri)."""
    keys = _list_keys(job_list)
    first = job_list.groupBy(*keys).agg(F.min(F.struct("pos", "label", "config_uri")).alias("e"))
    return first.where(F.col("e").isNotNull()).select(*keys, "e.pos", "e.label", "e.config_uri")
