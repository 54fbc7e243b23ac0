"""The metrics file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.params import SOURCES

# The header of the metrics file, by column of the metrics row.
METRICS_HEADER = {
    "total_avg": "Total average sentiment",
    "total_nb": "Total number of comments",
    "accuracy": "Stocktwits sentiment accuracy",
}
for _source in SOURCES:
    METRICS_HEADER[f"avg_{_source}"] = f"Average sentiment for {_source}"
    METRICS_HEADER[f"nb_{_source}"] = f"Nb of comments for {_source}"


def metrics_schema() -> str:
    fields = ["stock STRING"]
    for column, title in METRICS_HEADER.items():
        kind = "BIGINT" if "nb" in column.split("_") else "DOUBLE"
        fields.append(f"`{title}` {kind}")
    return ", ".join(fields)


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    titled = metrics.select("stock", *[F.col(c).alias(title) for c, title in METRICS_HEADER.items()])
    titled.write.mode("overwrite").csv(path, header=True)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    titled = spark.read.schema(metrics_schema()).csv(path, header=True)
    return titled.select("stock", *[F.col(f"`{title}`").alias(c) for c, title in METRICS_HEADER.items()])
