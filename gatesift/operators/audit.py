"""Signing and checking audit logs and task tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions import jsonv as J
from gatesift.functions.signing import base64url, from_base64url, hmac_sha256
from gatesift.operators.slices import previous_row

IDS_PER_SLICE = 1_000_000
GAP_CHUNK = 10_000


def signature(timestamp: Column, sequence: Column, message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of `timestamp|sequence|message`."""
    return hmac_sha256(F.concat(timestamp, F.lit("|"), sequence.cast("string"), F.lit("|"), F.coalesce(message, F.lit(""))), key)


def sign_audit(log: DataFrame, key: bytes) -> DataFrame:
    """The log (`sequence_id`, `log_timestamp`, `msg`) with `hmac_signature`."""
    return log.withColumn("hmac_signature", signature(F.col("log_timestamp"), F.col("sequence_id"), F.col("msg"), key))


def check_audit(log: DataFrame, key: bytes) -> DataFrame:
    """The log with `valid`: false for a wrong or missing signature and for lines which are no entries."""
    expected = signature(F.col("log_timestamp"), F.col("sequence_id"), F.col("msg"), key)
    return log.withColumn("valid", F.coalesce(expected == F.col("hmac_signature"), F.lit(False)))


def sequence_gaps(log: DataFrame) -> DataFrame:
    """`sequence_id` of every entry which is missing between 1 and the last one.

    Ids are ordered slice by slice; a long gap is cut into chunks before its ids are listed.
    """
    ids = log.select("sequence_id").filter(F.col("sequence_id").isNotNull()).distinct()
    slice_ = F.expr(f"sequence_id div {IDS_PER_SLICE}")
    seen = previous_row(ids, [], slice_, ["sequence_id"], F.col("sequence_id"), "_before")
    gaps = seen.select((F.coalesce("_before", F.lit(0)) + 1).alias("_from"), (F.col("sequence_id") - 1).alias("_to"))
    gaps = gaps.filter("_from <= _to")
    chunks = gaps.select(F.explode(F.sequence("_from", "_to", F.lit(GAP_CHUNK).cast("bigint"))).alias("_from"), "_to")
    return chunks.select(F.explode(F.sequence("_from", F.least("_to", F.col("_from") + GAP_CHUNK - 1))).alias("sequence_id"))


def verify_audit(log: DataFrame, key: bytes) -> DataFrame:
    """One row: total, valid and invalid entries, missing ids, and whether the log is intact."""
    per_id = check_audit(log, key).groupBy("sequence_id").agg(
        F.count("*").alias("n"), F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("bad")
    )
    # Ids run from 1 to the last one, so the missing ones follow from how many there are.
    last = F.coalesce(F.greatest(F.max("sequence_id"), F.lit(0)), F.lit(0))
    counted = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("good"), F.lit(0)).alias("valid"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"), (last - F.count_if(F.col("sequence_id") >= 1)).alias("missing"),
    )
    return counted.withColumn("intact", (F.col("invalid") == 0) & (F.col("missing") == 0))


def sign_token(claims: Column, key: bytes) -> Column:
    """`base64url(claims) . base64url(hmac)` for a JSON text."""
    payload = base64url(F.encode(claims, "UTF-8"))
    return F.concat(payload, F.lit("."), base64url(F.unhex(hmac_sha256(payload, key))))


def verify_tokens(df: DataFrame, token: str, identity: str, key: bytes) -> DataFrame:
    """The input with `valid`, and `task_id` and `tenant` of valid tokens.

    A token counts only for the identity it was issued to, and an empty identity matches none.
    """
    parts = F.split(token, r"\.", 2)
    payload, given = F.get(parts, 0), F.get(parts, 1)
    expected = base64url(F.unhex(hmac_sha256(payload, key)))
    claims = F.try_parse_json(from_base64url(payload))
    out = df.withColumn("_claims", F.when((F.size(parts) == 2) & (payload != "") & (given == expected), claims))
    mine = (F.col(identity) != "") & (J.get_string(F.col("_claims"), "$.identity") == F.col(identity))
    out = out.withColumn("valid", F.coalesce(mine, F.lit(False)))
    return out.withColumns({
        "task_id": F.when(F.col("valid"), J.get_string(F.col("_claims"), "$.task_id")),
        "tenant": F.when(F.col("valid"), J.get_string(F.col("_claims"), "$.tenant")),
    }).drop("_claims")
