"""Deep pages: a table in the order of its pages, with the number of rows before each range."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scratch


class PageTable:
    """The rows of a table in one total order, in ranges with prefix counts. A page opens only the ranges it lies in, however
    deep it is; :func:`relational.page` sorts all rows for each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        row = spark.read.parquet(f"{folder}/about").first()
        self.schema, self.total = T.StructType.fromJson(json.loads(row["schema"])), row["total"]
        #: part, rows before it and rows of it: a line for each range, of which a build has a few for each task.
        self.ranges = [tuple(r) for r in spark.read.parquet(f"{folder}/ranges").orderBy("before", "part").select("part", "before", "n").collect()]

    @classmethod
    def build(cls, df: DataFrame, folder: str, sort_by: str, descending: bool = True, key: str = "id", allowed: tuple[str, ...] | None = None, ranges: int | None = None) -> PageTable:
        """Writes ``df`` sorted by a column, nulls last, then by the key, as :func:`relational.page` has it."""
        if allowed and sort_by not in allowed:
            raise ValueError(f"sort_by is one of {allowed}")
        spark = df.sparkSession
        order = [F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by), F.asc(key)]
        dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        at = F.monotonically_increasing_id()
        space = scratch.Scratch(spark, "pages")
        rows = space.table(dealt.sortWithinPartitions(*order).withColumn("__at", at), "rows")
        rows = rows.withColumns({"__part": F.shiftright("__at", 33).cast("int"), "__row": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")
        rows.repartitionByRange("__part", "__row").sortWithinPartitions("__part", "__row").write.partitionBy("__part").parquet(f"{folder}/rows")
        counts = rows.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n"))
        before, lines = 0, []
        for r in counts.orderBy("part").collect():  # a line a range
            lines.append((r["part"], before, r["n"]))
            before += r["n"]
        spark.createDataFrame(lines, "part int, before long, n long").coalesce(1).write.parquet(f"{folder}/ranges")
        spark.createDataFrame([(df.schema.json(), before)], "schema string, total long").coalesce(1).write.parquet(f"{folder}/about")
        space.drop()
        return cls(spark, folder)

    def parts(self, number: int, size: int) -> list[int]:
        """The ranges in which a page lies."""
        low, high = (number - 1) * size, number * size
        return [p for p, before, n in self.ranges if before < high and before + n > low]

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        if number < 1 or size < 1:
            raise ValueError("number and size are 1 or more")
        full = T.StructType([*self.schema.fields, T.StructField("__row", T.LongType()), T.StructField("__part", T.IntegerType())])
        low, high = (number - 1) * size, number * size
        held = F.lit(False)
        for p, before, n in self.ranges:
            if before < high and before + n > low:
                held = held | ((F.col("__part") == p) & F.col("__row").between(low - before, high - 1 - before))
        rows = self.spark.read.schema(full).parquet(f"{self.folder}/rows") if self.total else self.spark.createDataFrame([], full)
        return rows.filter(F.col("__part").isin(self.parts(number, size)) & held).orderBy("__part", "__row").select(*self.schema.names)
