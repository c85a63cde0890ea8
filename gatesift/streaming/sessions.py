"""Session analysis on a stream of messages.

Each micro-batch runs the batch analysis over its messages together with the features of what their
sessions have said within the look-back: the history and the counts of repetition reach over a fixed number of
messages, and between two messages of a session lie at most 30 minutes, so they reach over LOOK_BACK_S. What grows
with a session (its start, count and average) is kept exactly, as one summary row per session and day; the summary of
the last day before the look-back gives the state from which the analysis goes on, so a session may run for any time.

Features and summaries lie beside the checkpoint in one folder per batch and day and are only ever added to. A batch
reads the folders before its own and writes its own anew, so a batch which is run again after a failure gives the same
result. A late message changes the summaries of its day and of all days after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift.operators import sessions as S
from gatesift.patterns import phrases as P

FEATURES = (
    "session_id string, user_id string, msg_id bigint, at_us bigint, flags int, fragment double, shape string, tool string"
)
SUMMARY = "session_id string, at_us bigint, msg_id bigint, started_us bigint, count bigint, ewma double"
SECOND = 1_000_000
DAY = 86_400 * SECOND
LOOK_BACK_S = (P.HISTORY_SIZE + P.REPETITION_HISTORY) * P.SESSION_IDLE  # no message sees more of its running session


def shared_dir(spark: SparkSession) -> str:
    """The folder which all executors share, as the cluster names it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("spark.checkpoint.dir must name a folder which all executors share")
    return path.rstrip("/")


def prepare(spark: SparkSession, base: str) -> None:
    """Empty folders of features and summaries, so that the first batch has something to read."""
    spark.createDataFrame([], FEATURES).write.mode("overwrite").parquet(f"{base}/features/batch=-1/day=0")
    spark.createDataFrame([], SUMMARY).write.mode("overwrite").parquet(f"{base}/summaries/batch=-1/day=0")


def analyze_batch(batch: DataFrame, batch_id: int, base: str) -> None:
    """One micro-batch: results under `base/results`, features and summaries beside them, all by number.

    Features and summaries are kept by day; a batch reads the days of its look-back, however long the stream has run.
    """
    spark = batch.sparkSession

    def kept(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema + ", batch bigint, day bigint").option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")

    day = F.expr(f"at_us div {DAY}")
    S.message_features(batch).withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{base}/features/batch={batch_id}")
    first = batch.agg(F.min(F.unix_micros("ts"))).first()[0]
    if first is None:
        return
    # From `exact` on every message is judged as in the batch; the days before it are only looked back on.
    exact = (first - LOOK_BACK_S * SECOND) // DAY
    oldest = (exact * DAY - LOOK_BACK_S * SECOND) // DAY
    features = kept("features", FEATURES)
    new = features.filter(F.col("batch") == batch_id).drop("batch", "day")
    earlier = features.filter((F.col("batch") < batch_id) & (F.col("day") >= oldest)).drop("batch", "day")
    known = earlier.join(new.select("session_id").distinct(), "session_id", "left_semi")
    # A session without a message on the day before `exact` starts anew after it.
    last = kept("summaries", SUMMARY).filter((F.col("batch") < batch_id) & (F.col("day") == exact - 1))
    newest = last.groupBy("session_id").agg(F.max_by(F.struct("at_us", "msg_id", F.struct("started_us", "count", "ewma").alias("_seed")), "batch").alias("s"))
    known = known.join(newest.select("session_id", "s.*"), ["session_id", "at_us", "msg_id"], "left")
    rows = known.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    judged = S.analyze_features(rows).drop("_seed").filter(F.col("at_us") >= first // DAY * DAY).persist()
    state = F.max_by(F.struct("at_us", "msg_id", "started_us", "count", "ewma"), F.struct("at_us", "msg_id", "rn")).alias("s")
    summaries = judged.groupBy("session_id", day.alias("day")).agg(state).select("session_id", "s.*", "day")
    summaries.write.mode("overwrite").partitionBy("day").parquet(f"{base}/summaries/batch={batch_id}")
    judged.filter("_new").drop("_new").write.mode("overwrite").parquet(f"{base}/results/batch={batch_id}")
    judged.unpersist()


def analyze_stream(messages: DataFrame, name: str, base: str | None = None, **trigger):
    """Starts the analysis of a stream; results are parquet under `<base>/<name>/results`."""
    spark = messages.sparkSession
    root = f"{base or shared_dir(spark)}/{name}"
    prepare(spark, root)
    writer = messages.writeStream.foreachBatch(lambda b, i: analyze_batch(b, i, root))
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"processingTime": "1 minute"})).start()
