"""Telemetry as streams: windows, sessions, idempotent delivery, label caps.

Event time is the event's own; the watermark is one hour unless said otherwise.
Rows later than the watermark are dropped by Spark and counted in the query's
progress. Windows are an addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelore.session import ensure_checkpoint_dir

WATERMARK = "1 hour"
LABEL_CAP = 16


def file_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table's files as a stream, in order of arrival; zoneless times become event times of the session's zone."""
    batch = spark.read.parquet(f"{directory}/{name}.parquet")
    inside = any(f"/{name}.parquet/" in f for f in batch.inputFiles()[:1])
    reader = spark.readStream.schema(batch.schema)
    stream = reader.parquet(f"{directory}/{name}.parquet") if inside else reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in batch.dtypes if kind == "timestamp_ntz"})


def zoneless(df: DataFrame) -> DataFrame:
    """Event times back to the zoneless type of the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def windowed(events: DataFrame, time: str, by: list[str], value: str, width: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Counters and a histogram's moments per window and label."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, watermark).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("window_start"), *by, "n", "total", "least", "most")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Stage lifecycles: spans of activity with gaps below `gap`."""
    s = F.session_window(time, gap)
    return events.withWatermark(time, watermark).groupBy(s, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


def once(events: DataFrame, time: str, key: list[str], watermark: str = WATERMARK) -> DataFrame:
    """Append-only ledger: each key once within the watermark."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(key)


def paired(starts: DataFrame, finishes: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Start and finish events of one key, the finish within a bounded time (columns start_ts, finish_ts)."""
    a, b = starts.withWatermark("start_ts", WATERMARK).alias("a"), finishes.withWatermark("finish_ts", WATERMARK).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("finish_ts") >= F.col("start_ts")) & (F.col("finish_ts") <= F.col("start_ts") + F.expr(f"interval {within}"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), "start_ts", "finish_ts")


def capped_labels(events: DataFrame, key: str, label: str, cap: int = LABEL_CAP) -> DataFrame:
    """Events per key and label value; values beyond the first `cap` of a key count as dropped.

    The state of a key is at most `cap` values. Which values come first follows
    the order of arrival; inside one micro-batch, the order of the values.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: list[str] = list(state.get[0]) if state.exists else []
        counts: dict[str, int] = {}
        for b in batches:
            for value, n in b["label"].value_counts().items():
                counts[value] = counts.get(value, 0) + int(n)
        out = []
        for value in sorted(counts):
            if value not in seen and len(seen) < cap:
                seen.append(value)
            out.append((group[0], value if value in seen else None, counts[value]))
        state.update((seen,))
        yield pd.DataFrame(out, columns=["key", "label", "n"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label")).where("key is not null and label is not null")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, label string, n bigint", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def deliver(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Start an exporter: each micro-batch goes to `write(batch, id)`, which must be idempotent by id."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give the result as a batch.

    Batches land in the shared checkpoint folder, one directory for each id, so a
    repeated batch overwrites itself; in complete mode the last one holds all.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        done.append(number)

    query = deliver(stream, write, f"{base}/state", mode)
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{base}/out/{max(done)}"] if mode == "complete" else [f"{base}/out/{n}" for n in sorted(set(done))]
    return spark.read.schema(stream.schema).parquet(*paths)
