"""Streams of records and outcomes.

Stateless steps are the batch functions themselves. What follows holds state: windowed counts and first-of-a-key
rows behind a watermark, trust scores by host in a value state, and a stored table that takes a feed's new keys.
Each can be stopped at any moment and started again at the same place with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import lookups, tables
from ..ship import ship

#: Files that a batch of a feed reads at most.
BATCH_FILES = 1_000


def read_feed(spark: SparkSession, path: str, like: DataFrame | None = None, files: int = BATCH_FILES) -> DataFrame:
    """A stream of a folder's Parquet files, some at a time; a single file's folder is read for that file only."""
    schema = (like if like is not None else spark.read.parquet(path)).schema
    if path.endswith(".parquet"):
        folder, _, name = path.rpartition("/")
        whole = spark._jvm.org.apache.hadoop.fs.Path(path)
        if whole.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(whole).isFile():
            return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def outcomes_of(events: DataFrame) -> DataFrame:
    """events as query outcomes: domain, gap, host and success."""
    return events.selectExpr(
        "event_id", "ts", "CASE user_id % 3 WHEN 0 THEN 'real_estate' WHEN 1 THEN 'sports_ticketing' ELSE '_common' END AS domain",
        "concat('gap_', event_type) AS gap_type", "concat('host', CAST(user_id % 5 AS STRING), '.org') AS url_host", "value > 10.0 AS success",
    )


def route_counts(df: DataFrame, route: str = "gap_type", ts: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, route, records) by tumbling window; rows later than the watermark are dropped."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), route).agg(F.count("*").alias("records")).select(F.col("window.start").alias("start"), F.col(route).alias("route"), "records")


def first_of_key(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 days") -> DataFrame:
    """The first row of each key that arrives within the watermark's delay: insert-ignore on a feed."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class TrustScores(StatefulProcessor):
    """A host's score as a value state; rows are its minutes, each one function of the score, in order from batch to batch.

    After ``idle_ms`` of event time without outcomes a host's state goes, and it begins anew; 0 keeps it for ever.
    """

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.score = handle.getValueState("score", "score double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        score = self.score.get()[0] if self.score.exists() else 0.5
        minutes = sorted(rows, key=lambda r: r["minute"])
        for r in minutes:
            score = min(max(score + r["shift"], r["low"]), r["high"])
        self.score.update((score,))
        if self.idle_ms:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(minutes[-1]["minute"].timestamp() * 1000) + self.idle_ms)
        yield Row(domain=key[0], url_host=key[1], score=score, minute=minutes[-1]["minute"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.score.clear()
        yield Row(domain=key[0], url_host=key[1], score=0.5, minute=None)

    def close(self) -> None:
        pass


_SCORES = "domain string, url_host string, score double, minute timestamp"
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Inside it the session has other settings; then it is as it was."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trust_scores(events: DataFrame, order: list[str], late: str = "10 minutes", idle_days: int = 0) -> DataFrame:
    """(domain, url_host, score, minute): a stream of the hosts' scores, as minutes end behind the watermark.

    A minute's outcomes are folded to one function by an aggregation, like ``lookups.trust_steps``, so that a host with most of
    all outcomes comes as a row a minute. Outcomes may come in any order within ``late``; later ones are dropped.
    """
    ship(events.sparkSession)
    known = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    step = F.struct(F.when(F.col("success"), 0.02).otherwise(-0.01).alias("shift"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    steps = known.select("domain", "url_host", "ts", F.struct(*order).alias("at"), step.alias("f"))
    minutes = steps.groupBy("domain", "url_host", F.window("ts", "1 minute")).agg(F.expr(lookups.FOLD).alias("f"))
    rows = minutes.select("domain", "url_host", F.col("window.end").alias("minute"), "f.shift", "f.low", "f.high")
    if idle_days:
        return rows.groupBy("domain", "url_host").transformWithState(TrustScores(idle_days * 86_400_000), _SCORES, "append", "EventTime", eventTimeColumnName="minute")
    return rows.groupBy("domain", "url_host").transformWithState(TrustScores(), _SCORES, "append", "None")


def run_trust(events: DataFrame, order: list[str], place: str, late: str = "10 minutes", idle_days: int = 0) -> tuple[DataFrame, str | None]:
    """(scores, watermark) of a stream of outcomes over what is there now: (domain, url_host, score) of minutes that ended before it.

    State and progress are in the checkpoint under ``place``, what came out in a table beside it, which a batch that is run again
    doesn't change. Started again without new files, it gives the same.
    """
    spark = events.sparkSession
    with settings(spark, _STATE):
        query = trust_scores(events, order, late, idle_days).writeStream.format("parquet").option("path", f"{place}/scores").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    rows = spark.read.schema(_SCORES).parquet(f"{place}/scores").where("minute IS NOT NULL")
    return rows.groupBy("domain", "url_host").agg(F.max_by("score", "minute").alias("score"), F.max("minute").alias("minute")), max(marks, default=None)


def with_open_minutes(scores: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """(domain, url_host, trust_score): scores and, after them, the outcomes of minutes that hadn't ended."""
    seen = scores.select("domain", "url_host", F.col("score"), "minute")
    ended = events.join(seen.select("domain", "url_host", "minute"), ["domain", "url_host"], "left").where(F.col("minute").isNull() | (F.col("ts") >= F.col("minute")))
    after = lookups.trust_steps(ended, order)
    both = seen.join(after, ["domain", "url_host"], "full").withColumn("score", F.coalesce("score", F.lit(0.5)))
    return both.select("domain", "url_host", F.round(F.coalesce(lookups.trusted(), "score"), 6).alias("trust_score"))


def stored(spark: SparkSession, path: str, schema, below: int | None = None) -> DataFrame:
    """The rows of a table's finished batches, all or those before one: a batch's folder counts once its number is in the ledger."""
    done = spark.read.schema("n long").parquet(f"{path}/ledger") if _there(spark, f"{path}/ledger") else spark.createDataFrame([], "n long")
    numbers = [r["n"] for r in done.distinct().collect() if below is None or r["n"] < below]
    folders = [f"{path}/rows/batch={n}" for n in sorted(numbers)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def run_insert_ignore(feed: DataFrame, keys: list[str], order: str, path: str, fail_after: int | None = None) -> DataFrame:
    """The table under ``path`` after a feed: rows whose keys it doesn't have, of rows of one batch with a key the first by ``order``.

    Each batch writes a folder of its own, and then its number into a ledger. A batch that is run again, after a crash at any
    point, writes its own folder anew and looks at the others only, so nothing is added twice. ``fail_after``: for tests, the
    batch after whose rows, and before whose ledger entry, the job dies.
    """
    spark, schema = feed.sparkSession, feed.schema

    def take(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        new = tables.new_rows(stored(own, path, schema, n).select(*keys), batch, keys, order)
        new.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        if fail_after == n:
            raise RuntimeError("stopped before the ledger")
        own.createDataFrame([(n,)], "n long").coalesce(1).write.mode("append").parquet(f"{path}/ledger")

    feed.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stored(spark, path, schema)


def run_available(df: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet under ``place`` (its checkpoint too), and read the result."""
    spark = df.sparkSession
    out = f"{place}/out"
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out)
    else:
        query = df.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out))
    query.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema if mode == "append" else df.schema.add("batch", "long")).parquet(out)
