"""Upload notifications (S3, S4): queue bodies -> object keys -> submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PUT_EVENT = "ObjectCreated:Put"
UPLOAD_ROOT = "uploads"
RECORDS_DDL = ("Records ARRAY<STRUCT<eventName: STRING, s3: STRUCT<bucket: STRUCT<name: STRING>, "
               "object: STRUCT<key: STRING>>>>")
ENVELOPE_DDL = "TopicArn STRING, Type STRING, Message STRING"


def decode_notifications(messages: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per ``ObjectCreated:Put`` record of each message.

    A body carrying ``TopicArn`` with ``Type = 'Notification'`` is an SNS
    envelope whose ``Message`` holds the records; an envelope whose inner
    message does not parse yields no records.
    """
    env = F.from_json(F.col(body_col), ENVELOPE_DDL)
    wrapped = env["TopicArn"].isNotNull() & (env["Type"] == "Notification")
    inner = F.when(wrapped, env["Message"]).otherwise(F.col(body_col))
    records = F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, RECORDS_DDL)["Records"])
    keep = [c for c in messages.columns if c != body_col]
    rows = messages.select(*keep, F.explode(records).alias("r"))
    return (rows.filter(F.col("r.eventName") == PUT_EVENT)
            .select(*keep, F.col("r.eventName").alias("event_name"),
                    F.col("r.s3.bucket.name").alias("bucket"), F.col("r.s3.object.key").alias("key")))


def undecodable(messages: DataFrame, body_col: str = "body") -> DataFrame:
    """Messages that hold no JSON, on the outside or in the envelope, with
    the reason; ``decode_notifications`` yields nothing for them."""
    body = F.col(body_col)
    env = F.from_json(body, ENVELOPE_DDL)
    wrapped = env["TopicArn"].isNotNull() & (env["Type"] == "Notification")
    reason = (F.when(body.isNull() | F.try_parse_json(body).isNull(), "body is not JSON")
              .when(wrapped & F.try_parse_json(env["Message"]).isNull(), "enveloped message is not JSON"))
    return messages.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def strip_extension(name: Column) -> Column:
    """``os.path.splitext(name)[0]``: drop the last suffix; leading dots do not start one."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def parse_object_keys(df: DataFrame, key_col: str = "key") -> DataFrame:
    """S3: ``uploads/{user}/{hash}.ext`` -> (user_id, submission_id); other
    layouts get a quarantine ``reason``."""
    parts = F.split(F.col(key_col), "/", -1)
    valid = F.coalesce((F.size(parts) >= 3) & (F.get(parts, 0) == UPLOAD_ROOT), F.lit(False))
    return df.select(
        "*", F.when(valid, F.get(parts, 1)).alias("user_id"),
        F.when(valid, strip_extension(F.get(parts, 2))).alias("submission_id"),
        F.when(~valid, F.coalesce(F.concat(F.lit("invalid object key: "), F.col(key_col)),
                                     F.lit("no object key"))).alias("reason"))
