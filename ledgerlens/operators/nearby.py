"""A tolerance join: does a value agree with a value of the same keys and another period?

Values fall into bands a little narrower than the tolerance: bands of the logarithm for the relative one, even
bands for the absolute one. Values that agree lie two bands apart at most. For each band the index holds,
of those below, within and above it, the nearest value and the nearest one of another period, and zeros apart:
eight values at most, so the join is an equi-join that adds no rows, whatever a key's or a band's size. In one band the
nearest value on either side agrees best; a zero, which has a tolerance of its own, stands in nobody's way.

A table against itself (`with_other_periods`) needs no index: its rows are sorted in their key, and what is nearest in
another period ends the run of equal periods before a row. That shuffles a row once, whatever is asked of it. Only keys
of so many rows that one task should not sort them are looked up in the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import ABSOLUTE, RELATIVE, values_agree

REACH, WIDEST = 2, 10**9
WIDTH = 0.98 * min(RELATIVE, ABSOLUTE)
#: Above this the absolute tolerance is within the relative one.
SMALL = 2 * ABSOLUTE / RELATIVE
#: Keys are counted by cells of their hash; those of a cell with more rows than HOT are looked up, for a task sorts a key.
CELLS, HOT = 1 << 16, 1 << 20


def _bin(x: Column) -> Column:
    return F.greatest(F.least(F.floor(x / WIDTH), F.lit(WIDEST)), F.lit(-WIDEST))


def _relative(bin: Column, value: Column) -> Column:
    return 4 * bin + F.when(value < 0, 1).otherwise(0)


def _absolute(bin: Column) -> Column:
    return 4 * bin + 2


def period_index(values: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """(keys, _band, _near): for each band of a key the values that can decide, as structs (period, value)."""
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v) & F.col(period).isNotNull()).select(*keys, F.col(period).alias("_period"), v.alias("_value"))
    steps = range(-REACH, REACH + 1)
    size = F.abs("_value")

    def targets(own: Column, key, rank: Column, zero: Column) -> Column:
        """side: -1 for values below the band, 1 for those above, 2 for zeros; near: the greater, the nearer."""
        return F.array(*[F.struct(key(own + s).alias("_band"), F.when(zero, 2).otherwise((s < 0) - (s > 0)).alias("_side"), (rank * (1 if s > 0 else -1)).alias("_rank")) for s in steps])

    by_log = targets(_bin(F.log(size)), lambda b: _relative(b, F.col("_value")), size, F.lit(False))
    even = targets(_bin(F.col("_value")), _absolute, F.col("_value"), F.col("_value") == 0)
    none = F.array().cast("array<struct<_band:bigint,_side:int,_rank:double>>")
    each = F.concat(F.when(F.col("_value") != 0, by_log).otherwise(none), F.when(size <= SMALL, even).otherwise(none))
    spread = rows.select("*", F.inline(each))
    place = [*keys, "_band", "_side"]
    ends = spread.groupBy(*place, "_period").agg(F.max(F.struct("_rank", "_value")).alias("_best"))
    w = Window.partitionBy(*place).orderBy(F.col("_best").desc(), "_period")
    two = ends.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    return two.groupBy(*keys, "_band").agg(F.collect_list(F.struct(F.col("_period").alias("period"), F.col("_best._value").alias("value"))).alias("_near"))


def with_other_period(rows: DataFrame, values: DataFrame, keys: list[str], period: str, value: str, unit: Column, name: str = "other_period", values_period: str | None = None, values_value: str | None = None) -> DataFrame:
    """`rows` with the boolean `name`: whether `values` hold, for the same keys and another period, a value that `value` agrees with.

    Null keys, periods and values agree with nothing; rows may repeat. Columns that begin with an underscore
    and the name of an inner one (_band, _near) are not allowed in `rows`.
    """
    index = period_index(values, keys, values_period or period, values_value or value)
    v = F.col(value).cast("double")
    probed = v.isNotNull() & F.col(period).isNotNull()
    apart = 4 * F.pmod(F.xxhash64(*keys, period, value), F.lit(WIDEST)) + 3  # a band that the index has not: rows that need none spread over all tasks
    near_zero = (F.abs(v) <= ABSOLUTE) | (unit == "USD/shares")
    bands = {"_by_log": F.when(probed & (v != 0), _relative(_bin(F.log(F.abs(v))), v)), "_even": F.when(probed & near_zero & (F.abs(v) <= SMALL + ABSOLUTE), _absolute(_bin(v)))}
    out, found = rows, F.lit(False)
    for at, band in bands.items():
        out = out.withColumn("_band", F.coalesce(band, apart)).join(index.withColumnRenamed("_near", at), [*keys, "_band"], "left").drop("_band")
        others = F.exists(at, lambda x: (x["period"] != F.col(period)) & values_agree(v, x["value"], unit))
        found = found | F.coalesce(others, F.lit(False))
    return out.withColumn(name, F.coalesce(found, F.lit(False))).drop(*bands)


def _beside(rows: DataFrame, keys: list[str], period: str, value: str, unit: Column, name: str, down: bool) -> DataFrame:
    """`rows` with the boolean `name`: whether the nearest value of another period on one side agrees, or a zero on that side.

    down: rows are passed from the greatest value to the least, in the exact reverse, so that of equal values each sees the others once.
    """
    v, e = F.col(value).cast("double"), F.col(period)
    held = v.isNotNull() & e.isNotNull()
    order = [F.col(x).desc() if down else F.col(x).asc() for x in (value, period)]
    w = Window.partitionBy(*keys).orderBy(*order)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.when(held & (v == 0), e)
    out = rows.withColumns({
        "_period": F.last(F.when(held, e), True).over(before),
        "_value": F.last(F.when(held, v), True).over(before),
        "_zero_least": F.min(zero).over(so_far),
        "_zero_most": F.max(zero).over(so_far),
    })
    out = out.withColumn("_value", F.last(F.when(held & (F.col("_period") != e), F.col("_value")), True).over(so_far))
    zeros = ((F.col("_zero_least") != e) | (F.col("_zero_most") != e)) & values_agree(v, F.lit(0.0), unit)
    found = held & (F.coalesce(values_agree(v, F.col("_value"), unit), F.lit(False)) | F.coalesce(zeros, F.lit(False)))
    for k in keys:
        found = found & F.col(k).isNotNull()
    return out.withColumn(name, found).drop("_period", "_value", "_zero_least", "_zero_most")


def with_other_periods(rows: DataFrame, keys: list[str], period: str, checks: dict[str, tuple[str, Column]], hot: int = HOT) -> DataFrame:
    """`rows` with a boolean for each of `checks` (name: value, unit), as `with_other_period` gives of `rows` and themselves.

    Values must be numbers. Columns of `rows` must not begin with an underscore. No result depends on `hot`.
    """
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64(*keys), F.lit(CELLS)))
    crowded = F.broadcast(dealt.groupBy("_cell").count().where(F.col("count") > hot).select("_cell"))
    few, many = (dealt.join(crowded, "_cell", how).drop("_cell") for how in ("left_anti", "left_semi"))
    few, looked_up = few.repartition(*keys), many  # here, so that only what `rows` have is shuffled
    for name, (value, unit) in checks.items():
        few = _beside(few, keys, period, value, unit, "_below", False)
        few = _beside(few, keys, period, value, unit, "_above", True)
        few = few.withColumn(name, F.col("_below") | F.col("_above")).drop("_below", "_above")
        looked_up = with_other_period(looked_up, many, keys, period, value, unit, name)
    return few.unionByName(looked_up)
