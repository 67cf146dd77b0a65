"""Community corpora kept between runs (S11): term counts by month, so a later run tokenises only new months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import vectorizer_tokens

SCHEMA = "community string, term string, cnt long, month string"


class TermTable:
    """A Parquet table ``community, term, cnt`` partitioned by month under ``path``.

    Months are closed: texts of a month that the table holds are not read again unless they are to be recounted.  A
    month's partition is written whole or, when the job fails, not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def months(self) -> list[str]:
        return sorted(r["month"] for r in self.table().select("month").distinct().collect())

    def update(self, texts: DataFrame, community: str, text: str, month: str, recount: tuple[str, ...] = ()) -> list[str]:
        """Counts the terms of ``texts`` in months that the table lacks, or that are in ``recount``, and returns these
        months.  With ``texts`` partitioned by month only their files are read.  Null communities, months and texts
        give nothing."""
        known = set(self.months()) - set(recount)
        new = texts.where(F.col(month).isNotNull() & F.col(community).isNotNull())
        if known:
            new = new.where(~F.col(month).isin(*sorted(known)))
        terms = new.select(F.col(community).alias("community"), F.col(month).alias("month"), F.explode(vectorizer_tokens(F.col(text))).alias("term"))
        counts = terms.groupBy("community", "term", "month").agg(F.count(F.lit(1)).alias("cnt"))
        counts.select("community", "term", "cnt", "month").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.path)
        return [m for m in self.months() if m not in known]

    def counts(self, last_month: str | None = None) -> DataFrame:
        """``community, term, cnt`` over all months, or those up to ``last_month`` (others are not read)."""
        table = self.table() if last_month is None else self.table().where(F.col("month") <= last_month)
        return table.groupBy("community", "term").agg(F.sum("cnt").alias("cnt"))
