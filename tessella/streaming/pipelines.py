"""Streams: summaries under a watermark, deduplication with bounded memory, idempotent stores, and state machines by key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark, path: str, like: DataFrame, files: int = 50) -> DataFrame:
    """A stream over the parquet files of a folder, or over one file by its name in its folder, `files` to a batch."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def windowed_counts(stream: DataFrame, at: str, keys: list[str], window: str, late: str, failed: Column) -> DataFrame:
    """Rows and failures by key and window of event time; a window is given out once no row that `late` allows can come."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed")).select(
        F.col("window.start").alias("from_at"), *keys, "n", "failed"
    )


def without_repeats(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Repeats with the same keys left out if they come within `late` of event time; older keys are forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def store(stream: DataFrame, folder: str, checkpoint: str, partition: str | None = None):
    """Writes each batch to its own subfolder, replacing it if the batch is run again after a failure: each row once."""
    def write(batch: DataFrame, number: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and returns what it wrote below `folder`."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def breaker(stream: DataFrame, key: str, at: str, ok: str, limit: int, cooldown_s: int) -> DataFrame:
    """(key, at, opened): when a key has failed `limit` times in a row; one success resets, and while open it is not opened
    again before `cooldown_s` have passed. State is three numbers a key; batches are sorted by time and may be of any size."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        row, open_until, seen = state.get if state.exists else (0, 0, 0)
        rows = pd.concat([*batches]).sort_values([at])
        out = []
        for t, good in zip(rows[at], rows[ok]):
            now = int(t.timestamp())
            seen += 1
            if good is None or pd.isna(good):
                continue
            row = 0 if good else row + 1
            if row >= limit and now >= open_until:
                out.append((k[0], t, row))
                open_until, row = now + cooldown_s, 0
        state.update((row, open_until, seen))
        yield pd.DataFrame(out, columns=[key, at, "failures"])

    return stream.select(key, at, ok).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, failures long", "run long, until long, seen long", "append", GroupStateTimeout.NoTimeout
    )


def leases(stream: DataFrame, key: str, order: str, kind: str, epoch: str, attempts: int = 5) -> DataFrame:
    """(key, order, state, epoch, attempts) after each event of a leased work item.

    claim raises the epoch; commit counts only with the current epoch; expire and release free the item, expire costs an
    attempt, and `attempts` of them park it. Events of an older epoch change nothing.
    """
    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        now, e, tried = state.get if state.exists else ("ready", 0, 0)
        out = []
        for r in pd.concat([*batches]).sort_values([order]).itertuples(index=False):
            o, what, given = r[1], r[2], r[3]
            if what == "claim" and now == "ready":
                now, e = "leased", e + 1
            elif what in ("commit", "release", "expire") and now == "leased" and int(given) == e:
                if what == "commit":
                    now = "done"
                else:
                    tried += what == "expire"
                    now = "parked" if tried >= attempts else "ready"
            out.append((k[0], o, now, e, tried))
        state.update((now, e, int(tried)))
        yield pd.DataFrame(out, columns=[key, order, "state", "epoch", "attempts"])

    return stream.select(key, order, kind, epoch).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, state string, epoch long, attempts long", "state string, epoch long, attempts long", "append", GroupStateTimeout.NoTimeout
    )
