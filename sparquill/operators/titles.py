"""The title index as state: checked observations, merged by article, kept in partitions.

An article is known by its address without query and fragment, with escapes of
unreserved characters decoded; its title is what the address says.  State and new
observations have one form, so a merge is one grouping, and merging what is
there already changes nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from sparquill.functions import urls
from sparquill.functions.text import REPLACEMENT
from sparquill.operators.links import LONGEST_URL
from sparquill.sources.indexes import TITLE_ENTRY, TITLE_INDEX

# Bytes of an index file, characters of a title.
LARGEST_INDEX, LONGEST_TITLE = 4 << 20, 1024
BUCKETS = 64  # partitions of a stored state

TITLED = T.StructType([T.StructField("title", T.StringType()), T.StructField("encoding", T.StringType())])
STATE = "identity string, title string, url string, title_encoding string, observed_on string, url_source string, observed_urls array<string>, seq long"


@F.pandas_udf(TITLED)
def titled(addresses: pd.Series) -> pd.DataFrame:
    """The title that an article's address spells, and the encoding that it took."""

    def read(url: str | None) -> tuple[str | None, str | None]:
        m = re.match(rf"https://[^/?#]+/{urls.SLUG}/d/([^?#]+)", url or "")
        for name in urls.ENCODINGS if m else ():
            try:
                title = urls.unquote_to_bytes(m[1]).decode(name)
                return (title, name) if title and len(title) <= LONGEST_TITLE and REPLACEMENT not in title else (None, None)
            except UnicodeError:
                pass
        return None, None

    return pd.DataFrame([read(u) for u in addresses], columns=TITLED.fieldNames())


def observations(seen: DataFrame, base: str, order: list[str]) -> DataFrame:
    """identity, title, url, title_encoding, observed_on and seq of the article
    addresses below ``base`` (https://host/slug/) among ``seen`` (url, observed_on).

    Fragments are dropped; what is out of scope, too long or damaged, or spells no
    title is left out; ``seq`` is an array that sorts like the columns ``order``."""
    host, slug = re.fullmatch(r"https://([^/?#]+)/([^/?#]+)/", base).groups()
    whole = seen.withColumn("url", F.split_part("url", F.lit("#"), F.lit(1)))
    own = whole.where(F.length("url") <= LONGEST_URL).where(urls.scope_error(F.col("url"), host, slug).isNull() & F.startswith(F.col("url"), F.lit(f"{base}d/")))
    place = _places(own, order)
    named = own.select("url", "observed_on", place.alias("seq"), titled.asNondeterministic()("url").alias("t")).where("t.title is not null")
    return named.select(urls.article_identity("url").alias("identity"), "t.title", "url", F.col("t.encoding").alias("title_encoding"), "observed_on", "seq")


def _places(rows: DataFrame, order: list[str]) -> Column:
    """An array of texts that sorts like the columns ``order``."""
    return F.array(*[F.col(c) if rows.schema[c].dataType == T.StringType() else F.lpad(F.col(c).cast("string"), 20, "0") for c in order])


def of_state(state: DataFrame) -> DataFrame:
    """The observations that a state stands for, before all others in order."""
    rows = state.select("identity", "title", "title_encoding", "observed_on", "seq", F.posexplode("observed_urls").alias("place", "url"))
    place = F.array(F.lit(""), F.lpad(F.col("seq").cast("string"), 20, "0"), F.lpad(F.col("place").cast("string"), 20, "0"))
    return rows.select("identity", "title", "url", "title_encoding", "observed_on", place.alias("seq"))


def merged(seen: DataFrame) -> DataFrame:
    """identity, title, url, title_encoding, observed_on, url_source, observed_urls
    and first (the least seq) of each article.

    Addresses that differ in the case of escapes are one, in the form first seen.  Encoding and page are those of the first plain address, or
    of the first of all while every one has a query."""
    plain = F.col("url") == urls.article_url(F.col("url"))
    what = F.struct("seq", "url", "title", "title_encoding", "observed_on", plain.alias("plain"))
    each = seen.groupBy("identity", urls.identity(F.col("url")).alias("address")).agg(F.min(what).alias("first"), F.min(F.when(plain, what)).alias("plain"))
    rows = each.groupBy("identity").agg(F.min("first").alias("first"), F.min("plain").alias("plain"), F.array_sort(F.collect_list(F.struct("first.seq", "first.url"))).alias("all"))
    best = F.coalesce("plain", "first")
    return rows.select(
        "identity", F.col("first.title").alias("title"), urls.article_url(best["url"]).alias("url"), best["title_encoding"].alias("title_encoding"), best["observed_on"].alias("observed_on"),
        F.when(F.col("plain").isNotNull(), "observed_url").otherwise("query_removed_from_observed_url").alias("url_source"),
        F.transform("all", lambda x: x["url"]).alias("observed_urls"), F.col("first.seq").alias("first"))


def bucket(identity: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(identity), F.lit(buckets)).cast("int")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored state; empty where there is none yet."""
    try:
        return spark.read.schema(f"{STATE}, bucket int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{STATE}, bucket int")


def merge_into(spark: SparkSession, path: str, seen: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Merges observations into the state at ``path``; returns the buckets that changed.

    Only buckets with something new are read in full and written, each as a whole,
    by the committer; all others keep their files.  Merging the same again changes
    none.  New articles are numbered behind those of their bucket in the order in which
    they were seen, so that the order of entries never changes."""
    state = load(spark, path)
    came = seen.withColumn("bucket", bucket(F.col("identity"), buckets))
    known = state.where(F.col("bucket").isin([r[0] for r in came.select("bucket").distinct().collect()]))  # at most ``buckets`` numbers
    new = merged(of_state(known).unionByName(came.drop("bucket"))).withColumn("bucket", bucket(F.col("identity"), buckets))
    old = known.select("identity", F.col("seq").alias("_seq"), F.struct("title", "url", "title_encoding", "observed_on", "url_source", "observed_urls").alias("_was"))
    both = new.join(old, "identity", "left")
    same = F.struct("title", "url", "title_encoding", "observed_on", "url_source", "observed_urls").eqNullSafe(F.col("_was"))
    changed = sorted(r[0] for r in both.where(~same).select("bucket").distinct().collect())
    if changed:
        behind = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("_seq").asc_nulls_last(), "first", "identity")) - 1
        rows = both.where(F.col("bucket").isin(changed)).withColumn("seq", behind.cast("long")).select(*[c.split()[0] for c in STATE.split(", ")], "bucket")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return changed


def as_index(state: DataFrame, wiki: str, largest: int = LARGEST_INDEX) -> DataFrame:
    """One row: schema, wiki and entries in the form of an index file, and error.

    The file is an exchange format with a limit in bytes, so it is one row; entries
    that would pass the limit are never gathered: error is index_too_large then."""
    entry = F.struct(*[F.col(f.name) for f in TITLE_ENTRY]).alias("entry")
    sized = state.select("bucket", "seq", entry, F.octet_length(F.to_json(entry)).alias("size"))
    total = sized.agg(F.coalesce(F.sum(F.col("size") + 2), F.lit(0)).alias("total"))
    fits = F.col("total") + len(wiki.encode()) + 64 <= largest
    kept = sized.join(F.broadcast(total), fits).agg(F.array_sort(F.collect_list(F.struct("bucket", "seq", "entry"))).alias("rows"))
    return kept.crossJoin(F.broadcast(total)).select(
        F.lit(2).alias("schema"), F.lit(wiki).alias("wiki"), F.transform("rows", lambda r: r["entry"]).alias("entries"), F.when(~fits, "index_too_large").alias("error"))


def write_index(state: DataFrame, wiki: str, path: str, largest: int = LARGEST_INDEX) -> str | None:
    """Writes the index file that ``read_index`` reads; returns an error code and
    leaves what is there, if it would be too large."""
    index = as_index(state, wiki, largest)
    error = index.select("error").first()[0]
    if error is None:
        index.select(F.to_json(F.struct("schema", "wiki", "entries")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return error


def read_index(spark: SparkSession, path: str, base: str, largest: int = LARGEST_INDEX) -> tuple[DataFrame, DataFrame]:
    """The observations of index files, and path and error of each file: a file with
    anything wrong in it gives no observation.

    Errors: index_too_large, not_json, schema, other_wiki, entry (a field is missing),
    mismatch (an address spells another title, or is of another article or out of
    scope), query (the address of an entry of the second schema has one)."""
    slug = base.rstrip("/").rsplit("/", 1)[1]
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.when(F.col("length") <= largest, F.decode("content", "UTF-8")).alias("value"))
    whole = T.StructType([*TITLE_INDEX.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = files.select("path", "size", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    top = (
        F.when(F.col("size") > largest, "index_too_large").when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | F.col("r.entries").isNull(), "not_json")
        .when(~F.coalesce(F.col("r.schema").isin(1, 2), F.lit(False)), "schema").when(F.coalesce(F.col("r.wiki") != slug, F.lit(False)), "other_wiki")
    )
    headed = parsed.select("path", "r", top.alias("error"))
    entries = headed.where("error is null").select("path", F.col("r.schema").alias("schema"), F.posexplode("r.entries").alias("place", "e"))
    several = F.when(F.col("schema") == 1, F.array("e.url")).otherwise(F.col("e.observed_urls"))
    listed = entries.select("path", "schema", "place", "e", F.posexplode_outer(several).alias("at", "url"))
    seen = observations(
        listed.select("url", F.coalesce("e.observed_on", F.lit(base)).alias("observed_on"), F.col("path").alias("file"), F.col("place").alias("entry"), "at"), base, ["file", "entry", "at"])
    checked = listed.withColumn("seq", _places(listed, ["path", "place", "at"])).join(seen.select("seq", F.col("title").alias("spelt"), "identity"), "seq", "left")
    e = F.col("e")
    wrong = (
        F.when(e["title"].isNull() | e["url"].isNull() | F.col("url").isNull(), "entry")
        .when(F.col("spelt").isNull() | (F.col("spelt") != e["title"]) | (F.col("identity") != urls.article_identity(e["url"])), "mismatch")
        .when((F.col("schema") == 2) & (e["url"] != urls.article_url(e["url"])), "query")
    )
    bad = checked.groupBy("path").agg(F.min(wrong).alias("wrong"))
    errors = headed.join(bad, "path", "left").select("path", F.coalesce("error", "wrong").alias("error"))
    sound = errors.where("error is null").select(F.col("path").alias("_file"))
    return seen.join(sound, F.element_at("seq", 1) == F.col("_file"), "left_semi"), errors
