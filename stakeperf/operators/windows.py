"""Scalable ordered scans.

A running total (or a lag) over one long ordered series cannot be a single
window: the whole series would land in one task.  The helpers here cut the
order into blocks that are monotone in it:

* ``prefix_sum`` totals each block with a partial aggregate, turns the
  (small) block totals into offsets with a window over blocks, and adds a
  window inside each block;
* ``blocked_lag`` lags inside each block and hands each block the last
  values of the previous one through a window over the block ends;
* ``ranged_lag`` does so over blocks of about equal size, cut by range over all
  keys at once, and reads its input once.

* ``affine_scan`` solves ``x = a x' + b`` along an order: maps of a block are
  composed to one map, blocks of blocks likewise, and the values flow back down.

Every task then holds at most one block, whatever the key skew; the joins
that bring block results back are sort-merge joins on the block key, which
the big side is already partitioned and sorted by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeperf.session import materialize


def prefix_sum(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[Column],
               block: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = running sum of ``value`` within ``keys`` in ``order``.

    ``block`` must be non-null and monotone in ``order`` (rows of a lower
    block come first); it bounds the rows per in-block window.
    ``inclusive=False`` excludes the current row.  NULL keys form their own
    group, as in a window.
    """
    tmp, kcols = null_safe_keys(df.withColumn("_blk", block).withColumn("_v", value), list(keys), "_p")
    totals = tmp.groupBy(*kcols, "_blk").agg(F.sum("_v").alias("_bt"))
    before = Window.partitionBy(*kcols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*kcols, "_blk", F.coalesce(F.sum("_bt").over(before), F.lit(0)).alias("_boff"))
    end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*kcols, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return (tmp.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
            .join(offsets.hint("merge"), [*kcols, "_blk"], "inner")
            .withColumn(out, F.col("_boff") + F.col("_in"))
            .drop(*kcols, "_blk", "_v", "_bt", "_boff", "_in"))


MIN_LONG = -(1 << 63)


def null_safe_keys(df: DataFrame, cols: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for possibly-NULL key columns: for each column a
    NULL flag and the value with NULL replaced.  Equal stand-ins mean equal
    (or both NULL) keys, so they can serve as plain equi-join keys and as
    window partition keys at the same time."""
    names = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType.simpleString()
        filler = {"string": F.lit(""), "double": F.lit(0.0), "float": F.lit(0.0)}.get(dt, F.lit(0))
        df = (df.withColumn(f"{prefix}{i}n", F.col(c).isNull())
                .withColumn(f"{prefix}{i}v", F.coalesce(F.col(c), filler.cast(dt))))
        names += [f"{prefix}{i}n", f"{prefix}{i}v"]
    return df, names


def blocked_lag(df: DataFrame, keys: Sequence[str], major: str, seq: str, values: Sequence[str],
                block_size: int) -> DataFrame:
    """``lag`` of ``values`` and a first-row flag within ``keys``, in the order
    (``major`` NULL last, ``seq``), without putting a whole key into one task.

    Rows are cut into blocks (keys, major, seq div block_size); blocks are
    monotone in the order.  Inside a block a window gives the lag; the first
    row of a block takes the last values of the previous block of its key,
    found by a window over the (small) table of block ends.  Adds
    ``_prev_<v>`` for each value and ``_first`` (first row of its key).
    """
    x, kcols = null_safe_keys(df, list(keys), "_k")
    x = (x.withColumn("_mn", F.col(major).isNull())
         .withColumn("_mv", F.coalesce(F.col(major), F.lit(0).cast(df.schema[major].dataType)))
         .withColumn("_sb", F.coalesce(F.floor(F.col(seq) / block_size), F.lit(MIN_LONG))))
    blk = [*kcols, "_mn", "_mv", "_sb"]
    w_in = Window.partitionBy(*blk).orderBy(F.col(seq).asc_nulls_first())
    x = x.withColumn("_i", F.row_number().over(w_in))
    for v in values:
        x = x.withColumn(f"_lag_{v}", F.lag(v).over(w_in))
    ends = (x.groupBy(*blk)
            .agg(F.max_by(F.struct(*[F.col(v) for v in values]), F.coalesce(F.col(seq), F.lit(MIN_LONG)))
                 .alias("_end")))
    w_blk = Window.partitionBy(*kcols).orderBy("_mn", "_mv", "_sb")
    ends = ends.select(*blk, F.lag("_end").over(w_blk).alias("_prev"))
    # ``ends`` has one row per block, so it grows with the data: sort-merge
    # (``x`` is already partitioned and ordered by the block key).
    x = x.join(ends.hint("merge"), blk, "inner")
    first_in_block = F.col("_i") == 1
    for v in values:
        x = x.withColumn(f"_prev_{v}", F.when(first_in_block, F.col("_prev")[v]).otherwise(F.col(f"_lag_{v}")))
    x = x.withColumn("_first", first_in_block & F.col("_prev").isNull())
    return x.drop(*kcols, "_mn", "_mv", "_sb", "_i", "_prev", *[f"_lag_{v}" for v in values])


def ranged_lag(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str],
               block_size: int | None = None) -> DataFrame:
    """``blocked_lag`` over blocks of about equal size: adds ``_prev_<v>`` and ``_first``.

    Rows are dealt by range of (``keys``, ``order``; NULLs first) and written once to the
    shared folder with the number of their range, so the input is read once and its
    blocks stay what they are if a task is run again.  A block may hold many keys, a key
    many blocks; ``block_size`` asks for about so many rows in a block (default: what the
    session's shuffle partitions, merged by size, hold).  Only the first key of a block
    can go on from an earlier one, and then it is the last key of every block it left:
    each block's first key asks, its last row gives, and a window per key over these two
    rows a block answers.
    """
    places = {f"_o{i}": c for i, c in enumerate(order)}
    by = [*keys, *places]
    ranges = [F.col(c).asc_nulls_first() for c in by]
    x = df.withColumns(places)
    if block_size is not None:
        dealt = x.repartitionByRange(max(1, -(-df.count() // block_size)), *ranges)
    else:
        dealt = x.repartitionByRange(*ranges)
    x = materialize(dealt.withColumn("_blk", F.spark_partition_id())).withColumn("_key", F.struct(*keys))
    end = F.max_by(F.struct("_key", F.struct(*values).alias("vals")), F.struct(*by))
    ends = x.groupBy("_blk").agg(F.min("_key").alias("_from"), end.alias("_end"))
    asks = F.struct(F.lit(0).alias("gives"), F.col("_from").alias("key"), F.lit(None).cast(ends.schema["_end"].dataType["vals"].dataType).alias("vals"))
    gives = F.struct(F.lit(1).alias("gives"), F.col("_end._key").alias("key"), F.col("_end.vals").alias("vals"))
    met = ends.select("_blk", F.inline(F.array(asks, gives)))
    earlier = Window.partitionBy("key").orderBy("_blk", "gives").rowsBetween(Window.unboundedPreceding, -1)
    carried = (met.withColumn("_prev", F.last("vals", ignorenulls=True).over(earlier))
               .where("gives = 0").select("_blk", "_prev"))
    w = Window.partitionBy("_blk").orderBy(*ranges)
    x = x.withColumn("_before", F.lag("_key").over(w)).withColumns({f"_lag_{v}": F.lag(v).over(w) for v in values})
    x = x.join(carried.hint("merge"), "_blk", "inner")
    head, same = F.col("_before").isNull(), F.col("_before").eqNullSafe(F.col("_key"))
    x = x.withColumns({f"_prev_{v}": F.when(head, F.col("_prev")[v]).when(same, F.col(f"_lag_{v}")) for v in values})
    x = x.withColumn("_first", F.when(head, F.col("_prev").isNull()).otherwise(~same))
    return x.drop("_blk", "_key", "_prev", "_before", *places, *[f"_lag_{v}" for v in values])


#: Places of a block, and of a block of blocks.
SCAN_SIZES = (64, 4096)


def affine_scan(maps: DataFrame, keys: Sequence[str], sizes: Sequence[int] = SCAN_SIZES) -> DataFrame:
    """(keys, place, before, after) of the recurrence ``after = a * before + b``, with
    ``before`` 0 at the first row and the last ``after`` elsewhere, for rows (keys, place,
    a, b) within non-null ``keys`` in the order of the integer ``place``.

    Affine maps compose to affine maps, and composing is associative: the rows of a block
    (``place div sizes[0]``) are folded to their prefixes, the blocks' maps are scanned in
    the same way with the other sizes, and each block starts from what came before it.
    A task holds the rows of one block, or one row per block of the largest size; nothing
    is divided, so a factor of 0 needs no care."""
    size, rest = (sizes[0], sizes[1:]) if sizes else (None, ())
    block = F.floor(F.col("place") / size) if size else F.lit(0)
    row = F.struct(F.col("place").cast("bigint").alias("place"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    rows = maps.select(*keys, block.cast("bigint").alias("_blk"), row.alias("_r")).groupBy(*keys, "_blk").agg(F.sort_array(F.collect_list("_r")).alias("_rows"))
    none = F.array().cast("array<struct<place:bigint,ea:double,eb:double,a:double,b:double>>")
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        mine = F.struct(x.place.alias("place"), acc.a.alias("ea"), acc.b.alias("eb"), x.a.alias("a"), x.b.alias("b"))
        return F.struct((acc.a * x.a).alias("a"), (acc.b * x.a + x.b).alias("b"), F.concat(acc.out, F.array(mine)).alias("out"))

    blocks = rows.select(*keys, "_blk", F.aggregate("_rows", start, step).alias("_s"))
    if size:
        sizes_left = [s // size for s in rest]
        sums = affine_scan(blocks.select(*keys, F.col("_blk").alias("place"), F.col("_s.a").alias("a"), F.col("_s.b").alias("b")), keys, sizes_left)
        begin = sums.select(*keys, F.col("place").alias("_blk"), F.col("before").alias("_from"))
        blocks = blocks.join(begin.hint("merge"), [*keys, "_blk"], "inner")
    else:
        blocks = blocks.withColumn("_from", F.lit(0.0))
    each = blocks.select(*keys, "_from", F.explode("_s.out").alias("_r"))
    before = F.col("_r.ea") * F.col("_from") + F.col("_r.eb")
    return each.select(*keys, F.col("_r.place").alias("place"), before.alias("before"), (F.col("_r.a") * before + F.col("_r.b")).alias("after"))
