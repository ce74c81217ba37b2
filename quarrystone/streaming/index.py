"""Streams: an index of chunks kept up to date, daily counts, and replies that arrive in pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrystone.operators.chunking import content_id, valid


def keep_index(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends each micro-batch's chunks of new content to the index table at ``path``.

    A batch written again after a failure adds nothing: its texts are already there. The first delivery of a text stays. The index is parted by the
    first letters of the content's hash, at most 256 parts, so that a batch reads the parts it falls into.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = valid(batch).withColumn("content", content_id(F.col("text"))).dropDuplicates(["content"]).withColumn("part", F.substring("content", 1, 2))
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            # Only the parts of the index that the batch falls into are read.
            parts = [r.part for r in new.select("part").distinct().toLocalIterator()]
            known = spark.read.schema(new.schema).parquet(path).filter(F.col("part").isin(parts)).select("part", "content")
            new = new.join(known, ["part", "content"], "left_anti")
        new.write.mode("append").partitionBy("part").parquet(path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def daily_counts(stream: DataFrame, late: str = "7 days", key: str | None = "id") -> DataFrame:
    """Counts of feedback by day and verdict of a stream; rows more than ``late`` behind are dropped by the watermark.

    Rows delivered again under one ``key`` and time count once, as in the batch counts; with ``key=None`` each row counts.
    """
    v = F.lower(F.trim("verdict"))
    marked = stream.withColumn("verdict", v).filter(v.isin("correct", "wrong", "unsafe")).withWatermark("created_at", late)
    once = marked if key is None else marked.dropDuplicates([key, "created_at"])
    return once.groupBy(F.window("created_at", "1 day").alias("w"), "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "verdict", "n")


TITLE = re.compile(r"^Right to Win:[ \t]*(.+)$", re.M)


def _points(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state has what is not settled yet: the title that waits for the next one and the text behind the last whole line."""
    waiting, rest, done = state.get if state.exists else ("", "", 0)
    ended = False
    for piece in pieces:
        piece = piece.sort_values("seq")
        rest += "".join(piece["delta"].fillna(""))
        ended |= bool(piece["last"].any())
    whole, _, rest = (rest, "", "") if ended else rest.rpartition("\n")
    titles = ([waiting] if waiting else []) + [m[1].strip() for m in TITLE.finditer(whole)]
    told = titles if ended else titles[:-1]
    if ended:
        state.remove()
    else:
        state.update((titles[-1] if titles else "", rest, done + len(told)))
    if told:
        yield pd.DataFrame({"stream_id": [key[0]] * len(told), "pos": range(done + 1, done + 1 + len(told)), "title": told})


def points(stream: DataFrame) -> DataFrame:
    """``(stream_id, pos, title)`` of replies in pieces ``(stream_id, seq, delta, last)``.

    A point is whole once the next title has come, the last one when the piece marked last has.
    """
    return stream.groupBy("stream_id").applyInPandasWithState(_points, "stream_id string, pos long, title string", "waiting string, rest string, done long", "append", GroupStateTimeout.NoTimeout)


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
