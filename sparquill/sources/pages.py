"""Page responses as rows: scans, framing, sniffing, request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.sources.snapshots import RETRY_CODES

# Fixed values.
HTML_TYPES = ("text/html", "application/xhtml+xml")
SNIFFED = 8192
EVIDENCE = r"(?i)<!doctype\s+html|<html[\s>]|<head[\s>]|<div[\s>]"
MIN_GAP_SECONDS = 0.5


def scan_files(spark: SparkSession, path: str, limit: int = 24 << 20) -> DataFrame:
    """path, size, content and error_code of saved pages; too large ones have no content."""
    files = spark.read.format("binaryFile").load(path)
    large = F.col("length") > limit
    return files.select("path", F.col("length").alias("size"), F.when(~large, F.col("content")).alias("content"), F.when(large, "page_too_large").alias("error_code"))


def list_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """path, size and sha256 of files.  Contents are read only for digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256) if digests else F.lit(None).cast("string")
    return files.select("path", F.col("length").alias("size"), digest.alias("sha256"))


def checked(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, content and status (ok, digest, missing, extra) of files and what the
    manifest lists; content is given only where it is the listed one."""
    listed = manifest.select("path", F.col("sha256").alias("_sha"), F.lit(True).alias("_listed"))
    both = files.select("path", "content", F.lit(True).alias("_found")).join(listed, "path", "full_outer")
    status = (
        F.when(F.col("_found").isNull(), "missing").when(F.col("_listed").isNull(), "extra")
        .when(F.sha2("content", 256) == F.col("_sha"), "ok").otherwise("digest")
    )
    return both.withColumn("status", status).select("path", F.when(F.col("status") == "ok", F.col("content")).alias("content"), "status")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, content) whose digest is the manifest's (path, sha256)."""
    listed = manifest.select("path", F.col("sha256").alias("_sha"))
    return files.join(listed, "path").where(F.sha2("content", 256) == F.col("_sha")).drop("_sha")


def looks_like_html(html: Column) -> Column:
    """Whether the start of a body shows that it is HTML."""
    return F.coalesce(F.substring(html, 1, SNIFFED).rlike(EVIDENCE), F.lit(False))


def framing_error(status: Column, content_range: Column, content_length: Column, transfer_encoding: Column, received: Column, limit: int = 24 << 20) -> Column:
    """Null for a response that is whole, else its error code."""
    length = F.trim(content_length)
    number = length.try_cast("long")
    return (
        F.when(content_range.isNotNull() | (status == 206), "partial_response")
        .when(content_length.isNotNull() & (number.isNull() | (number < 0)), "invalid_content_length")
        .when(content_length.isNotNull() & transfer_encoding.isNotNull(), "ambiguous_framing")
        .when((number > limit) | (received > limit), "page_too_large")
        .when(number > received, "truncated_response")
    )


def response_error(status: Column, content_type: Column, html: Column) -> Column:
    """Null for a page, retry for what may be asked for again, else an error code."""
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return (
        F.when(status.isin(*RETRY_CODES), "retry").when(status != 200, "http_error")
        .when(content_type.isNotNull() & ~kind.isin(*HTML_TYPES), "not_html").when(~looks_like_html(html), "not_html")
    )


def storable(status: Column, closed: Column, mobile: Column, overridden: Column, lossy: Column, policy: str = "clean") -> Column:
    """Whether a parsed page may go into the store."""
    sound = (status == 200) & closed & ~mobile & ~overridden
    return F.coalesce(sound & ~lossy if policy == "clean" else sound, F.lit(False))


def prefer_desktop(first: DataFrame, second: DataFrame, key: str, mobile: Column) -> DataFrame:
    """Rows of ``first``, but those with a mobile layout from ``second`` where it
    has them, with ``layout_fallback`` set."""
    other = second.withColumnsRenamed({c: f"_{c}" for c in second.columns if c != key}).withColumn("_there", F.lit(True))
    joined = first.withColumn("_mobile", mobile).join(other, key, "left")
    swap = F.col("_mobile") & F.coalesce("_there", F.lit(False))
    chosen = [F.when(swap, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in first.columns if c != key]
    return joined.select(key, *chosen, swap.alias("layout_fallback"))


def short_gaps(log: DataFrame, key: str, at: str, least: float = MIN_GAP_SECONDS) -> DataFrame:
    """Requests that began less than ``least`` seconds after the one before."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return log.withColumn("gap_micros", gap).where(F.col("gap_micros") < least * 1_000_000)


def network_summary(log: DataFrame, host: Column, blocked: Column) -> DataFrame:
    """One row: requests, blocked ones, and how many hosts were asked."""
    return log.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(blocked).alias("blocked"), F.count_distinct(F.when(~blocked, host)).alias("hosts"),
        F.count_distinct(F.when(blocked, host)).alias("blocked_hosts"),
    )


def network_hosts(log: DataFrame, host: Column, blocked: Column) -> DataFrame:
    """host, blocked and n: the requests to each host, as rows, whatever their number."""
    return log.groupBy(host.alias("host"), blocked.alias("blocked")).agg(F.count(F.lit(1)).alias("n"))


def failing_in_a_row(log: DataFrame, key: str, at: list[str], code: Column, most: int) -> DataFrame:
    """Rows up to the ``most``-th like failure in a row; what follows is not tried."""
    order = Window.partitionBy(key).orderBy(*at)
    rows = log.withColumn("_code", code)
    changed = (~F.col("_code").eqNullSafe(F.lag("_code").over(order))).cast("long")
    runs = rows.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.when(F.col("_code").isNotNull(), F.row_number().over(Window.partitionBy(key, "_run").orderBy(*at)))
    counted = runs.withColumn("_count", count)
    tripped = F.max((F.col("_count") >= most).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("status", F.when(tripped == 1, "not_checked").when(F.col("_code").isNotNull(), "failed").otherwise("checked")).drop("_code", "_changed", "_run", "_count")
