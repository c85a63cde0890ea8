"""Erasure, column encryption and the rotation of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatesift.operators.slices import SLICE
from gatesift.sources import store
from gatesift.sources.numbered_log import append_numbered


def erase_user(df: DataFrame, erasures: DataFrame, user: str = "user_id") -> DataFrame:
    """The rows of every user who has not asked for erasure. Rows without a user stay."""
    return df.join(erasures.select(user).distinct(), user, "left_anti")


def erasure_events(erasures: DataFrame, user: str = "user_id") -> DataFrame:
    """One audit event per erasure request; asking twice gives one event."""
    return erasures.select(user).distinct().select(
        F.lit("gdpr_erasure").alias("event_type"),
        F.lit("info").alias("severity"),
        F.col(user).alias("user_id"),
        F.lit("User data erasure requested and completed").alias("message"),
        F.lit(True).alias("erased"),
    )


def erase_from_table(
    spark: SparkSession, path: str, erasures: DataFrame, request: str, partitions: Sequence[str], user: str = "user_id", log: str | None = None
) -> DataFrame:
    """Erases the rows of the users in `erasures` from a partitioned Parquet table; only partitions that hold some are rewritten.

    Returns a row per partition that was touched: its columns, `rows` before and `erased`. Files of other partitions stay
    as they are. Rows without a user stay, a partition without any row left is removed, `log` gets the audit events.

    What stays is first written beside the table, below `_erasure/<request>`, which readers of the table do not see. If a
    run breaks off, the same request takes up from there, so no row is lost and none is erased half; after it has
    finished, doing it again changes nothing. Nobody may write to the touched partitions meanwhile.
    """
    if not partitions:
        raise ValueError("name the columns by which the table is partitioned")
    stage = f"{path}/_erasure/{request}"
    touched_at, rest_at, done_at = f"{stage}/touched", f"{stage}/rest", f"{stage}/done"
    if store.exists(spark, done_at):
        return spark.read.parquet(touched_at).drop("_folder")
    gone = erasures.select(F.col(user).alias("_gone")).filter("_gone IS NOT NULL").distinct()
    by = [F.col(f"`{c}`") for c in partitions]
    if not store.exists(spark, f"{rest_at}/_SUCCESS"):
        table = spark.read.parquet(path)
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        marked = table.select(*by, F.col(f"`{user}`").alias("_user"), folder.alias("_folder")).join(gone, F.col("_user") == F.col("_gone"), "left")
        counted = marked.groupBy(*by, "_folder").agg(F.count("*").alias("rows"), F.count("_gone").alias("erased")).filter("erased > 0")
        counted.write.mode("overwrite").parquet(touched_at)
        touched = spark.read.parquet(touched_at)
        same = [F.col(f"t.`{c}`").eqNullSafe(F.col(f"h.`{c}`")) for c in partitions]
        held = table.alias("t").join(touched.alias("h"), same, "left_semi")
        held.join(gone, F.col(f"`{user}`") == F.col("_gone"), "left_anti").write.mode("overwrite").parquet(rest_at)
    rest, touched = spark.read.parquet(rest_at), spark.read.parquet(touched_at)
    # Every task of a partition's size writes to few partitions; a large one is split among tasks.
    rest.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    for row in touched.filter("rows = erased").select("_folder").toLocalIterator():
        store.remove_uri(spark, row["_folder"])
    if log:
        append_numbered(erasure_events(erasures.select(F.col(user).alias("user_id")).filter("user_id IS NOT NULL")), log, f"erasure-{request}", ["user_id"])
    store.create_once(spark, done_at, "")
    store.remove(spark, rest_at)
    return touched.drop("_folder")


KEYS_BYTES = 8 << 20  # of a key table that is broadcast


def _with_key(df: DataFrame, keys: DataFrame, key_id: str) -> DataFrame:
    """Every row with its key as `_gatesift_key`, NULL where the key id is NULL or unknown.

    A key table of up to `KEYS_BYTES` is broadcast: a few keys hold all rows, so a shuffle would send a key's rows to one task, and
    at run time Spark does not turn a join into a broadcast whose small side has few keys. A larger table is shuffled.
    """
    each = keys.groupBy("key_id").agg(F.count("*").alias("count"), F.sum(F.octet_length(F.col("key_id").cast("string")) + F.octet_length("key") + 100).alias("size"))
    found = each.agg(F.min(F.when(F.col("count") > 1, F.struct("key_id"))).alias("twice"), F.sum("size").alias("size")).first()
    if found["twice"]:
        raise ValueError(f"key id {found['twice']['key_id']!r} stands more than once in the key table")
    named = keys.select(F.col("key_id").alias("_gatesift_id"), F.col("key").alias("_gatesift_key"))
    small = F.broadcast(named) if (found["size"] or 0) <= KEYS_BYTES else named
    return df.join(small, F.col(f"`{key_id}`") == F.col("_gatesift_id"), "left")


def _seal(value: Column, key: Column) -> Column:
    return F.aes_encrypt(value, key, F.lit("GCM"))


def _open(value: Column, key: Column) -> Column:
    return F.try_aes_decrypt(value, key, F.lit("GCM"))


def encrypt_columns(df: DataFrame, columns: Sequence[str], keys: DataFrame, key_id: str = "key_id", unknown: str = "error") -> DataFrame:
    """The columns as AES-256-GCM ciphertext under the row's key; `keys` has `key_id` and a 32-byte `key`.

    Each value gets a fresh nonce, so the ciphertext differs from run to run. Every row comes back once, whatever its
    other columns are called. A value whose key id is NULL or unknown fails the query, or with `unknown="null"` becomes
    NULL; NULL values stay NULL under any key. A key id that stands twice in `keys` is refused.
    """
    key = F.col("_gatesift_key")
    lost = F.raise_error(F.concat(F.lit("no key for key id "), F.coalesce(F.col(f"`{key_id}`").cast("string"), F.lit("NULL")))).cast("binary")
    missing = F.lit(None).cast("binary") if unknown == "null" else lost
    sealed = {c: F.when(F.col(f"`{c}`").isNull(), F.lit(None)).when(key.isNull(), missing).otherwise(_seal(F.col(f"`{c}`"), key)) for c in columns}
    return _with_key(df, keys, key_id).withColumns(sealed).select(*[F.col(f"`{c}`") for c in df.columns])


def decrypt_columns(df: DataFrame, columns: Sequence[str], keys: DataFrame, key_id: str = "key_id") -> DataFrame:
    """Inverse of `encrypt_columns`: every row comes back; a value under a wrong, unknown or NULL key is NULL."""
    plain = {c: _open(F.col(f"`{c}`"), F.col("_gatesift_key")).cast("string") for c in columns}
    return _with_key(df, keys, key_id).withColumns(plain).select(*[F.col(f"`{c}`") for c in df.columns])


def key_in_force(df: DataFrame, keys: DataFrame, at: str, name: str = "key_id", slice_us: int = 3_600_000_000) -> DataFrame:
    """Every row with the id of the key in force at its time: the last one created at or before it, NULL before the first.

    An as-of join. `at` and `created_us` are microseconds. Distinct instants and keys are put in order slice by slice; what
    was in force before a slice is scanned over one row per slice. Of keys created at one instant the largest id counts.
    """
    instants = df.select(F.col(f"`{at}`").alias("t")).filter("t IS NOT NULL").distinct()
    events = instants.select("t", F.lit(None).cast("string").alias("id")).unionByName(
        keys.groupBy(F.col("created_us").alias("t")).agg(F.max(F.col("key_id").cast("string")).alias("id"))
    ).withColumn(SLICE, F.expr(f"t div {slice_us}"))
    # Keys before instants at the same time.
    inside = Window.partitionBy(SLICE).orderBy("t", F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = events.groupBy(SLICE).agg(F.max(F.when(F.col("id").isNotNull(), F.struct("t", "id"))).alias("_last"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(SLICE, F.max("_last").over(before)["id"].alias("_carry"))
    found = events.withColumn("_own", F.last("id", ignorenulls=True).over(inside)).filter("id IS NULL").join(carry, SLICE)
    force = found.select(F.col("t").alias("_gatesift_at"), F.coalesce("_own", "_carry").alias("_gatesift_id"))
    joined = df.join(force, F.col(f"`{at}`") == F.col("_gatesift_at"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col("_gatesift_id").alias(name))


def rotate_columns(
    df: DataFrame, columns: Sequence[str], keys: DataFrame, as_of_us: int, days: int = 90, key_id: str = "key_id"
) -> DataFrame:
    """Ciphertext under keys that are due moved to the newest key: the rows with their new key id, and `rotated`.

    `keys` has `key_id`, `key` and `created_us`; a key is due `days` after it was created. The newest key is the last
    one created at or before `as_of_us`. A row moves only if all its values open under its old key; others, and rows of
    an unknown or NULL key, stay as they are, so nothing is lost. Without a newest key nothing moves.
    """
    newest = keys.filter(F.col("created_us") <= as_of_us).orderBy(F.desc("created_us"), F.desc("key_id")).limit(1).collect()
    kept = [F.col(f"`{c}`") for c in df.columns]
    if not newest:
        return df.select(*kept, F.lit(False).alias("rotated"))
    new_id, new_key = newest[0]["key_id"], F.lit(bytes(newest[0]["key"]))
    due = keys.filter((F.col("created_us") + days * 86_400_000_000 <= as_of_us) & (F.col("key_id") != new_id))
    opened = _with_key(df, due.select("key_id", "key"), key_id)
    for i, c in enumerate(columns):
        opened = opened.withColumn(f"_gatesift_{i}", _open(F.col(f"`{c}`"), F.col("_gatesift_key")))
    moves = F.col("_gatesift_key").isNotNull()
    for i, c in enumerate(columns):
        moves = moves & (F.col(f"`{c}`").isNull() | F.col(f"_gatesift_{i}").isNotNull())
    judged = opened.withColumn("_gatesift_moves", moves)
    moved = F.col("_gatesift_moves")
    new = {c: F.when(moved, _seal(F.col(f"_gatesift_{i}"), new_key)).otherwise(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    new[key_id] = F.when(moved, F.lit(new_id)).otherwise(F.col(f"`{key_id}`"))
    return judged.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in df.columns], moved.alias("rotated"))


def key_rotation_due(keys: DataFrame, created: str, as_of: Column, days: int = 90) -> DataFrame:
    """The keys with the day of their next rotation and whether it has come."""
    following = F.date_add(F.col(created), days)
    return keys.withColumns({"next_rotation": following, "due": following <= as_of})
