"""Running values over long ordered groups: a group is cut into pieces that are tasks of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.sources.workdir import stored


class Ordered:
    """Rows of `group` in the order of `order`, dealt by range, so that one group of all rows is as many tasks as any other.

    The rows get `_pos`, which grows along each group, and `_part`, the piece; ties keep the place that they got when the
    rows were stored. What a piece needs to know of the pieces before it is one row a piece. Only groups that lie in
    several pieces need it: at most parts - 1 groups and 2 * parts - 2 pieces, which is what bounds the broadcasts.
    Null is a group like others. Input columns must not be named `_pos` or `_part`.
    """

    def __init__(self, df: DataFrame, group: str, order: list, parts: int | None = None):
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
        # The upper bits of the number are the partition's; stored, both stay as they are if a task runs again.
        self.rows = stored(dealt.withColumn("_pos", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_pos", 33))
        self.group = group
        ends = self.rows.groupBy(F.col(group).alias("_g")).agg(F.min("_part").alias("lo"), F.max("_part").alias("hi"))
        self.cut = stored(ends.where("lo < hi").select("_g"), "cut-groups")
        self.so_far = Window.partitionBy(group, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)

    def _carried(self, df: DataFrame, each: Column, fold) -> DataFrame:
        """df with _carry: each of the pieces before the row's own, folded."""
        inside = df.join(F.broadcast(self.cut), df[self.group].eqNullSafe(self.cut["_g"]), "left_semi")
        pieces = inside.groupBy(F.col(self.group).alias("_g"), F.col("_part").alias("_p")).agg(each.alias("_v"))
        ahead = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        carry = stored(pieces.select("_g", "_p", fold("_v").over(ahead).alias("_carry")), "carried")
        return df.join(F.broadcast(carry), df[self.group].eqNullSafe(carry["_g"]) & (df["_part"] == carry["_p"]), "left").drop("_g", "_p")

    def sum_before(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """df with the sum of value over the group's rows before each row; nulls count as 0."""
        value = F.coalesce(value, F.lit(0))
        got = self._carried(df, F.sum(value), F.sum)
        return got.withColumn(name, F.coalesce(F.sum(value).over(self.so_far), F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_carry")

    def last_before(self, df: DataFrame, name: str, value: Column, where: Column | None = None) -> DataFrame:
        """df with the value of the group's last row before each row for which where holds; null if there is none."""
        told = F.struct("_pos", value.alias("v"))
        told = told if where is None else F.when(where, told)
        got = self._carried(df, F.max(told), F.max)
        return got.withColumn(name, F.coalesce(F.last(told, ignorenulls=True).over(self.so_far), F.col("_carry"))["v"]).drop("_carry")
