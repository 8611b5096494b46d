"""Numbers in a global order without putting a table into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.session import materialize


def running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to the row and with it, in order of the column ``order``, whose values are distinct.

    Rows are dealt by ranges of the order and summed up within them; only one sum a range is ordered globally."""
    dealt = materialize(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__before"))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(before, "__range").withColumn(name, F.col("__before") + F.sum(value).over(within)).drop("__range", "__before")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(by.., one column a name of ``wanted``): linearly interpolated quantiles of ``value``, of which nulls have no part; a null group is a group, one without values has no row.

    Equal values are counted first; ranks are running sums of the counts by ranges, so no task holds all values of a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    ranked = materialize(running(counts.withColumn("__at", F.struct(*by, value)), "__at", "__n", "__upto"))
    key = F.struct(F.lit(0), *by)
    groups = ranked.groupBy(key.alias("__of")).agg(F.min(F.col("__upto") - F.col("__n")).alias("__before"), F.sum("__n").alias("__total"))
    placed = ranked.join(groups, key.eqNullSafe(F.col("__of")))
    upto = F.col("__upto") - F.col("__before")

    def at(place: Column) -> Column:
        return F.max(F.when((place < upto) & (place >= upto - F.col("__n")), F.col(value)))

    place = {name: (F.col("__total") - 1) * q for name, q in wanted.items()}
    ends = [x for name, p in place.items() for x in (at(F.floor(p)).alias(f"__l_{name}"), at(F.ceil(p)).alias(f"__h_{name}"), F.max(p - F.floor(p)).alias(f"__f_{name}"))]
    found = placed.groupBy(*by).agg(*ends)
    return found.select(*by, *[(F.col(f"__l_{n}") + (F.col(f"__h_{n}") - F.col(f"__l_{n}")) * F.col(f"__f_{n}")).alias(n) for n in wanted])
