"""Upload registration and input gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.keyed import STAGE_RECEIVED, upsert
from lectern.sources.adapters import MAX_UPLOAD_BYTES

# Fixed values.
MAX_TEXT_CHARS = 200_000
DEFAULT_SUBMISSION_STATE = STAGE_RECEIVED


def content_hash(content: Column) -> Column:
    """Lower-hex SHA-256 of the raw bytes (strings hashed as UTF-8)."""
    return F.sha2(content, 256)


def file_extension(name: Column) -> Column:
    """``os.path.splitext(name)[1]``: the last suffix, dot included."""
    return F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)


def register_uploads(requests: DataFrame, submissions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate upload requests and upsert a submission in state 0.

    ``requests``: ``user_id, file_name, file_hash, requested_at`` (+ ``seq``).
    A request lacking any field is rejected.  A repeated hash overwrites
    the earlier row (state and ``created_at`` reset), as a put does.
    Returns (submissions table, rejected requests with reason).
    """
    missing = None
    for c in ("user_id", "file_name", "file_hash"):
        m = F.col(c).isNull() | (F.col(c) == "")
        missing = m if missing is None else (missing | m)
    rejected = requests.filter(missing).withColumn(
        "reason", F.lit("user, file name or hash is missing"))
    ok = requests.filter(~missing)
    writes = ok.select(
        "user_id", F.col("file_hash").alias("submission_id"),
        F.lit(DEFAULT_SUBMISSION_STATE).alias("state"), F.col("file_name").alias("filename"),
        F.col("requested_at").cast("bigint").alias("created_at"),
        F.concat(F.lit("uploads/"), F.col("user_id"), F.lit("/"), F.col("file_hash"),
                 file_extension(F.col("file_name"))).alias("object_key"),
        F.coalesce(F.col("seq") if "seq" in requests.columns else F.lit(0), F.lit(0)).alias("seq"))
    table = upsert(submissions, writes, ["user_id", "submission_id"], ["created_at", "seq"])
    return table.drop("seq"), rejected


def gate_inputs(requests: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES,
                max_chars: int | None = None) -> DataFrame:
    """S8 (+ Z1 with ``max_chars``): pick file > url > text, then reject empty
    input (400) and oversized input (413).

    ``requests``: ``file_bytes`` BINARY, ``url_bytes`` BINARY, ``text`` STRING.
    Adds ``content`` (BINARY), ``status`` (200/400/413) and ``reason``.
    """
    content = F.coalesce(F.col("file_bytes"), F.col("url_bytes"),
                         F.when(F.col("text") != "", F.encode("text", "UTF-8")))
    out = requests.withColumn("content", content)
    size = F.octet_length("content")
    too_long = size > max_bytes
    if max_chars is not None:
        # Characters of the content read as UTF-8 with bad bytes replaced, so
        # one malformed upload cannot fail the job.
        text = F.make_valid_utf8(F.col("content").cast("string"))
        too_long = too_long | (F.length(text) > max_chars)
    status = F.when(F.col("content").isNull(), 400).when(too_long, 413).otherwise(200)
    reason = (F.when(F.col("content").isNull(), "nothing to read")
              .when(too_long, "too large"))
    return out.withColumn("status", status).withColumn("reason", reason)


def paragraphs_to_json(paragraphs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One JSON array of paragraph texts (in order) per submission."""
    key = key or ["user_id", "submission_id"]
    ordered = F.array_sort(F.collect_list(F.struct("paragraph_number", "text")))
    return (paragraphs.groupBy(*key).agg(ordered.alias("ps"))
            .select(*key, F.to_json(F.transform("ps", lambda x: x["text"])).alias("paragraphs_json")))


def write_paragraphs(paragraphs: DataFrame, path: str, key: list[str] | None = None) -> None:
    """S5 sink: one JSON array per submission, laid out by user so a user's
    reads prune to their folder."""
    key = key or ["user_id", "submission_id"]
    (paragraphs_to_json(paragraphs, key).write.mode("overwrite")
     .partitionBy(key[0]).parquet(path))


def paragraphs_from_json(df: DataFrame, json_col: str = "paragraphs_json") -> tuple[DataFrame, DataFrame]:
    """JSON array -> rows numbered from 0; anything but an array of
    strings goes to quarantine."""
    arr = F.from_json(F.col(json_col), "ARRAY<STRING>")
    is_list = F.regexp_like(F.col(json_col), F.lit(r"^\s*\[")) & arr.isNotNull()
    keep = [c for c in df.columns if c != json_col]
    good = df.filter(is_list).select(*keep, F.posexplode(arr).alias("paragraph_number", "text"))
    bad = df.filter(~is_list).withColumn("reason", F.lit("not a JSON array"))
    return good, bad


def intro(text: Column) -> Column:
    return T.intro_words(text)
