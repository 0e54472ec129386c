"""The task queue and behaviour logs as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..schema import CANCELLED, DONE, FAILED, PENDING, RUNNING


def next_status(status: Column, outcome: Column) -> Column:
    """pending to running; running to done, failed or cancelled by its outcome."""
    ended = F.when(outcome == "done", DONE).when(outcome == "failed", FAILED).when(outcome == "cancelled", CANCELLED).otherwise(RUNNING)
    return F.when(status == PENDING, RUNNING).when(status == RUNNING, ended).otherwise(status)


def recover(tasks: DataFrame) -> DataFrame:
    """Tasks that a crash left running are pending again."""
    return store.update_where(tasks, F.col("status") == RUNNING, {"status": F.lit(PENDING)})


def ended(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status").isin(DONE, FAILED, CANCELLED))


def expire(df: DataFrame, stamp_ms: Column, now_ms: int, days: int = 30) -> DataFrame:
    return df.filter(stamp_ms >= F.lit(now_ms - days * 86_400_000))


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def upsert_stream(stream: DataFrame, path: str, key: str, order: list[Column], checkpoint: str, **trigger):
    """Each micro-batch replaces the rows it renews. Batches are written to a folder of their own and the newest row of a
    key wins on reading, so a batch that runs twice leaves the same table."""

    def write(batch: DataFrame, number: int) -> None:
        rows = store.latest(batch, [key], order).withColumn("_batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_upserted(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return store.latest(rows, [key], [F.desc("_batch")]).drop("_batch", "batch")


def tumbling(events: DataFrame, stamp: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by event type and window; with `late`, rows that come later than that are left out (streams only)."""
    rows = events.withWatermark(stamp, late) if late else events
    return rows.groupBy(F.window(stamp, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, stamp: str, user: str, gap: str) -> DataFrame:
    return events.groupBy(F.session_window(stamp, gap).alias("w"), user).agg(F.count("*").alias("n"))


# ---- queues


def cron_batch(queue: DataFrame, most: int = 300, lock: str = "lock") -> DataFrame:
    """The oldest waiting tasks, `most` at most, up to the first lock among them: what one turn of the clock takes."""
    first = queue.filter(F.col("status") == PENDING).orderBy("created_at", "id").limit(most)
    stop = first.filter(F.col("type") == lock).agg(F.min(F.struct("created_at", "id")).alias("_stop"))
    return first.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.struct("created_at", "id") < F.col("_stop"))).drop("_stop")  # one row


def waiting(queue: DataFrame, skip: tuple[str, ...] = ("ai_search",)) -> DataFrame:
    """Waiting tasks but those that are answered at once, the oldest first."""
    return queue.filter((F.col("status") == PENDING) & ~F.col("type").isin(*skip)).orderBy("created_at", "id")


def poll(read, work, wake=None, least: float = 1.0, most: float = 10.0, turns: int | None = None, sleep=None) -> int:
    """Take tasks until told to stop: read() gives the waiting ones, work(tasks) deals with them and says how many.

    An idle turn waits twice as long as the one before, from `least` to `most` seconds; a turn with work, or
    wake(seconds) returning true before they are over, starts again at the least. Returns the tasks done.
    """
    import time

    done, pause, turn = 0, least, 0
    while turns is None or turn < turns:
        turn += 1
        count = work(read())
        done += count
        if count:
            pause = least
            continue
        early = wake(pause) if wake else (sleep or time.sleep)(pause)
        pause = least if early else min(most, 2 * pause)
    return done


def within_budget(batches, work, seconds: float = 50.0, clock=None) -> int:
    """Batches until the budget is spent; how many were dealt with. A batch is never cut."""
    import time

    now = clock or time.monotonic
    start, n = now(), 0
    for batch in batches:
        if now() - start >= seconds:
            break
        work(batch)
        n += 1
    return n


class Lock:
    """A lock that one writer at a time holds: a file that only one can create, in a folder all can reach."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def take(self) -> bool:
        try:
            return self._files.createNewFile(self._path)
        except Exception:  # noqa: BLE001  some file systems raise where the file is there
            return False

    def give(self) -> None:
        self._files.delete(self._path, False)


def unchanged(before: DataFrame, now: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows of `before` that nobody has written since: their stamp is still the same. What an optimistic write may touch."""
    return before.join(now.select(key, F.col(stamp).alias("_stamp")), key).filter(F.col(stamp).eqNullSafe(F.col("_stamp"))).drop("_stamp")


def promoted(rows: DataFrame, late: DataFrame, now_ms: int, key: str = "id") -> DataFrame:
    """Rows after late details: a draft (updated_at 0) that one reaches is a record from now on; draft and n are what its site's counts change by."""
    hit = late.select(key, F.lit(True).alias("_hit")).distinct()
    change = F.coalesce("_hit", F.lit(False)) & (F.col("updated_at") == 0)
    out = rows.join(hit, key, "left").withColumns({"draft": F.when(change, -1).otherwise(0), "n": F.when(change, 1).otherwise(0), "updated_at": F.when(change, F.lit(now_ms).cast("long")).otherwise(F.col("updated_at"))})
    return out.drop("_hit")


def once(stream: DataFrame, stamp: str, late: str, *keys: str) -> DataFrame:
    """A stream without rows delivered again within `late`."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(list(keys))


def follow(spark: SparkSession, tell):
    """tell(name, batch, rows) for every finished micro-batch of the session; returns the listener, for spark.streams.removeListener()."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):  # noqa: N802
            tell(event.name, -1, 0)

        def onQueryProgress(self, event):  # noqa: N802
            tell(event.progress.name, event.progress.batchId, event.progress.numInputRows)

        def onQueryIdle(self, event):  # noqa: N802
            pass

        def onQueryTerminated(self, event):  # noqa: N802
            pass

    listener = Progress()
    spark.streams.addListener(listener)
    return listener
