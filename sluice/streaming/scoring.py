"""Applying a saved preparation and model to rows as they arrive."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.transforms import Chain
from ..plans import models, prepare


def stream(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """Parquet files of the shape of ``like`` as a stream."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def scored(arriving: DataFrame, chain: Chain, model: Model, features: list[str], labels: list[str] | None = None) -> DataFrame:
    """Arriving rows prepared and scored; works on streams and tables alike, as all state is fitted before."""
    return models.score(model, prepare.vectors(chain.transform(arriving), features), labels)


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores what has arrived, once, and stops; the checkpoint remembers what has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(arriving: DataFrame, chain: Chain, model: Model, features: list[str], path: str, checkpoint: str, columns: list[str]) -> StreamingQuery:
    return write(scored(arriving, chain, model, features).select(*columns), path, checkpoint)
