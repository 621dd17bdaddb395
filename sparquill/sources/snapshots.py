"""Stored page responses: keys, validity, freshness, differences, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
RETRY_CODES = (408, 429, 500, 502, 503, 504)
MAX_SECONDS, FUTURE_SECONDS, TTL_SECONDS = 1_000_000, 60, 21_600
MANIFEST_LINE = r"^([0-9a-f]{64})  (.+)$"

METADATA = T.StructType([
    T.StructField(n, k) for n, k in (
        ("requested_url", T.StringType()), ("url", T.StringType()), ("http_status", T.IntegerType()), ("content_type", T.StringType()),
        ("content_encoding", T.StringType()), ("vary", T.StringType()), ("user_agent", T.StringType()), ("wire_bytes", T.LongType()),
        ("html_bytes", T.LongType()), ("http_requests", T.IntegerType()), ("fetched_at", T.StringType()), ("source", T.StringType()),
        ("from_cache", T.BooleanType()), ("fetch_warnings", T.ArrayType(T.StringType())), ("network_hosts", T.ArrayType(T.StringType())),
        ("redirects", T.ArrayType(T.StructType([T.StructField("status", T.IntegerType()), T.StructField("from", T.StringType()), T.StructField("to", T.StringType())]))),
        ("retry_history", T.ArrayType(T.StructType([T.StructField("error_code", T.StringType()), T.StructField("http_status", T.IntegerType()), T.StructField("wait_seconds", T.DoubleType())]))),
    )
])
RECORD = T.StructType([
    T.StructField("schema", T.IntegerType()), T.StructField("reader_version", T.StringType()), T.StructField("stored_at", T.DoubleType()),
    T.StructField("quality", T.StringType()), T.StructField("requested_url", T.StringType()), T.StructField("requested_user_agent", T.StringType()),
    T.StructField("sha256", T.StringType()), T.StructField("html_base64", T.StringType()), T.StructField("metadata", METADATA),
])


def read_records(spark, path: str) -> DataFrame:
    """JSON records with a fixed schema: unknown keys are dropped, broken ones are null rows."""
    return spark.read.schema(RECORD).json(path)


def record_error(version: str, now: Column, ttl: float = TTL_SECONDS) -> Column:
    """Null for a record that may be used, else what is wrong with it."""
    age = now.cast("double") - F.col("stored_at")
    body = F.try_to_binary("html_base64", F.lit("base64"))
    return (
        F.when(F.col("schema").isNull() | (F.col("schema") != 1), "schema")
        .when(F.col("reader_version") != version, "version")
        .when(F.col("stored_at").isNull() | F.isnan("stored_at") | (age < -FUTURE_SECONDS), "stored_at")
        .when(age > ttl, "expired")
        .when(~F.coalesce(F.col("metadata.http_status") == 200, F.lit(False)), "status")
        .when(body.isNull(), "encoding")
        .when(F.sha2(body, 256) != F.col("sha256"), "digest")
    )


def rebuild_report(records: DataFrame, version: str, now: Column, base: str, ttl: float = TTL_SECONDS) -> DataFrame:
    """One row with the number of stored records that a title index may learn from
    (reindexed), of other wikis, of older versions, expired and invalid ones."""
    error = record_error(version, now, ttl)
    inside = F.coalesce(F.startswith("requested_url", F.lit(base)), F.lit(False))
    kind = (
        F.when(error.isin("version"), "old").when(error == "expired", "expired").when(error.isNotNull(), "invalid").when(~inside, "other").otherwise("reindexed")
    )
    kinds = records.select(kind.alias("kind"))
    return kinds.agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("reindexed", "other", "old", "expired", "invalid")])


def usable_records(records: DataFrame, version: str, now: Column, ttl: float = TTL_SECONDS) -> DataFrame:
    """The newest usable record of each requested URL and user agent."""
    sound = records.withColumn("error", record_error(version, now, ttl)).where("error is null")
    newest = F.max_by(F.struct(*records.columns), F.col("stored_at"))
    return sound.groupBy("requested_url", "requested_user_agent").agg(newest.alias("r")).select("r.*")


def store(records: DataFrame, path: str) -> None:
    """Append complete records; the output committer makes the write atomic."""
    records.where("metadata.http_status = 200 and quality in ('clean', 'diagnostic')").write.mode("append").parquet(path)


def fresh_latest(rows: DataFrame, key: str, at: str, now: Column, ttl: str, good: Column) -> DataFrame:
    """The newest good row of each key that is not older than ``ttl`` (an interval)."""
    fresh = rows.where(good & (F.col(at) >= now - F.expr(f"interval {ttl}")))
    return fresh.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(at, *[c for c in rows.columns if c not in (key, at)])).alias("r")).select(key, "r.*")


def difference(old: DataFrame, new: DataFrame, *columns: str) -> DataFrame:
    """Rows added and removed as multisets, with how many times: one aggregate
    over both sides instead of two differences."""
    both = old.select(*columns, F.lit(-1).alias("d")).unionByName(new.select(*columns, F.lit(1).alias("d")))
    changed = both.groupBy(*columns).agg(F.sum("d").alias("d")).where("d <> 0")
    return changed.select(*columns, F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"), F.abs("d").cast("long").alias("n"))


def changed_documents(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and same, changed, added or removed."""
    a, b = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    both = a.join(b, key, "full_outer")
    return both.select(
        key, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed").alias("status")
    )


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """sha256, path and error of manifest lines."""
    path = F.regexp_extract(column, MANIFEST_LINE, 2)
    bad = (path == "") | path.rlike(r"^/|\\|:|(?:^|/)\.{0,2}(?:/|$)")
    n = F.count(F.lit(1)).over(Window.partitionBy("path"))
    rows = lines.select(F.regexp_extract(column, MANIFEST_LINE, 1).alias("sha256"), path.alias("path"), bad.alias("bad"))
    return rows.withColumn("error", F.when(F.col("bad"), "line").when(n > 1, "duplicate")).drop("bad")


def verify(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key and status: ok, missing, extra, size or digest.

    Both sides have key, size and sha256; a null digest is not compared.
    """
    m = manifest.select(key, F.col("size").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_listed"))
    f = found.select(key, "size", "sha256", F.lit(True).alias("_found"))
    return m.join(f, key, "full_outer").select(
        key,
        F.when(F.col("_found").isNull(), "missing").when(F.col("_listed").isNull(), "extra")
        .when(F.col("_size") != F.col("size"), "size").when(F.col("_sha") != F.col("sha256"), "digest").otherwise("ok").alias("status"),
    )


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, a number or an HTTP date; null if neither."""
    number = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(F.when(~F.isnan(number) & (number >= 0), number), date.cast("double") - now.cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.least(seconds, F.lit(float(MAX_SECONDS))), F.lit(0.0)))


def retry_decisions(attempts: DataFrame, key: str, at: list[str], failed: Column, left: float, most: int) -> DataFrame:
    """attempt, wait and decision of each failed row; an attempt's number is its
    place in the run of failures since the last success."""
    order = Window.partitionBy(key).orderBy(*at)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = attempts.withColumn("failed", failed).withColumn("run", F.sum((~F.col("failed")).cast("long")).over(so_far))
    numbered = runs.where("failed").withColumn("attempt", F.row_number().over(Window.partitionBy(key, "run").orderBy(*at)).cast("long"))
    wait = F.lit(0.5) * F.pow(F.lit(2.0), F.col("attempt") - 1)
    decision = F.when(F.col("attempt") > most, "give_up").when((F.col("wait") > 30) | (F.col("wait") >= left), "retry_deferred").otherwise("retry")
    return numbered.withColumn("wait", wait).withColumn("decision", decision).drop("failed", "run")
