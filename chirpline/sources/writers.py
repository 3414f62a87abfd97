"""Sinks: documents, CSV tables, equal shards, summaries; and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirpline.operators.matching import equal_shards


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A table of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_gt(gt: DataFrame, path: str) -> None:
    """Ground-truth CSV per session, in order of time."""
    rows = gt.select("session", "name", (F.col("t0_us") / 1e6).alias("start_seconds"), (F.col("t1_us") / 1e6).alias("stop_seconds"))
    rows.repartition("session").sortWithinPartitions("session", "start_seconds", "stop_seconds").write.mode("overwrite").partitionBy("session").option("header", True).csv(path)


def documents(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """A document per (session, channel): its images and annotations, ids renumbered from 0.

    ``images`` has image_key, ``annotations`` refer to it. Rows of a document meet in one row: a
    recording's channel is the unit that readers take.
    """
    line = Window.partitionBy("session", "channel")
    i = images.withColumn("new_id", F.row_number().over(line.orderBy("image_key")) - 1)
    a = annotations.join(i.select("session", "channel", "image_key", F.col("new_id").alias("new_image")), ["session", "channel", "image_key"])
    a = a.withColumn("new_id", F.row_number().over(line.orderBy("new_image", "x", "y")) - 1)
    one = F.struct(F.col("new_id").alias("id"), F.col("new_image").alias("image_id"), F.lit(1).alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"), "score")
    img = F.struct(F.col("new_id").alias("id"), "file_name", "width", "height", "window_start_sec", "window_end_sec")
    left = i.groupBy("session", "channel").agg(F.array_sort(F.collect_list(img)).alias("images"))
    right = a.groupBy("session", "channel").agg(F.array_sort(F.collect_list(one)).alias("annotations"))
    out = left.join(right, ["session", "channel"], "left")
    none = F.array().cast(right.schema["annotations"].dataType)
    return out.withColumn("annotations", F.coalesce("annotations", none)).withColumn("categories", F.array(F.struct(F.lit(1).alias("id"), F.lit("vocalization").alias("name"))))


def write_documents(images: DataFrame, annotations: DataFrame, path: str) -> None:
    documents(images, annotations).write.mode("overwrite").partitionBy("session", "channel").json(path)


def write_shards(df: DataFrame, n: int, order: list[str], path: str) -> None:
    """Shards of exactly n rows; both arms of a row are columns, so they stay in step.

    A shard is a row group, found by its column ``shard``; a file holds many whole shards in order, as
    a folder for each would make more files than a store or the driver can list.
    """
    placed = equal_shards(df, n, order).repartitionByRange("shard").sortWithinPartitions("shard", "place")
    placed.write.mode("overwrite").option("parquet.block.row.count.limit", n).parquet(path)


def pending(wanted: DataFrame, done: DataFrame | None, overwrite: bool = False, key: tuple[str, ...] = ("session", "channel")) -> DataFrame:
    """The keys that have no output yet, or all of them."""
    return wanted if overwrite or done is None else wanted.join(done.select(*key).distinct(), list(key), "left_anti")
