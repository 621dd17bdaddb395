"""Title and name indexes as JSON files with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
TITLE_ENTRY = T.StructType([T.StructField(n, _S) for n in ("title", "url", "title_encoding", "observed_on", "url_source")] + [T.StructField("observed_urls", T.ArrayType(_S))])
TITLE_INDEX = T.StructType([T.StructField("schema", T.IntegerType()), T.StructField("wiki", _S), T.StructField("entries", T.ArrayType(TITLE_ENTRY))])
PERSON = T.StructType([T.StructField(n, _S) for n in ("name", "region", "generation")] + [T.StructField("words", T.ArrayType(_S))])
NAME_INDEX = T.StructType([
    T.StructField("schema", _S), T.StructField("people", T.MapType(_S, PERSON)), T.StructField("keys", T.MapType(_S, T.ArrayType(T.ArrayType(_S)))),
    T.StructField("ambiguous_nicknames", T.MapType(_S, T.ArrayType(_S))),
])
PROFILE = T.StructType([T.StructField(n, _S) for n in ("region", "name", "slug", "card_path", "wiki_status")])


def read_titles(spark: SparkSession, path: str, wiki: str) -> DataFrame:
    """Entries of title index files.  Files of the first schema have one observed
    URL, the entry's own; files of another wiki or schema give no rows."""
    files = spark.read.option("multiLine", "true").schema(TITLE_INDEX).json(path).where((F.col("wiki") == wiki) & F.col("schema").isin(1, 2))
    entries = files.select("schema", F.explode("entries").alias("e")).select("schema", "e.*").where("title is not null and url is not null")
    return entries.withColumn("observed_urls", F.when(F.col("schema") == 1, F.array("url")).otherwise(F.coalesce("observed_urls", F.array("url")))).drop("schema")


def write_titles(index: DataFrame, path: str) -> None:
    """One JSON object per entry, in order of title; the committer replaces the
    folder as a whole."""
    index.orderBy("title", "url").write.mode("overwrite").json(path)


def read_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """keys (key, slug, kind, original, seq), people (slug, name, region,
    generation, words) and ambiguous (key, slugs) of a name index."""
    index = spark.read.option("multiLine", "true").schema(NAME_INDEX).json(path)
    keys = index.select(F.explode("keys").alias("key", "rows")).select("key", F.posexplode("rows").alias("seq", "r"))
    people = index.select(F.explode("people").alias("slug", "p")).select("slug", "p.*")
    ambiguous = index.select(F.explode("ambiguous_nicknames").alias("key", "slugs"))
    return keys.select("key", F.get("r", F.lit(0)).alias("slug"), F.get("r", F.lit(1)).alias("kind"), F.get("r", F.lit(2)).alias("original"), "seq"), people, ambiguous


def names_index(keys: DataFrame, people: DataFrame, ambiguous: DataFrame, schema: str) -> DataFrame:
    """One row of the form that ``read_names`` reads, from what it returns.

    An index holds the names of one roster, so its parts meet in one row."""
    rows = keys.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "slug", "kind", "original"))), lambda r: F.array(r["slug"], r["kind"], r["original"])).alias("rows"))
    as_map = lambda df, name, value: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))))
    person = F.struct(*[F.col(f.name) for f in PERSON]).alias("person")
    parts = [as_map(people.select("slug", person), "slug", "person").toDF("people"), as_map(rows, "key", "rows").toDF("keys"), as_map(ambiguous, "key", "slugs").toDF("ambiguous_nicknames")]
    one = [p.withColumn("_one", F.lit(1)) for p in parts]
    return one[0].join(one[1], "_one").join(one[2], "_one").select(F.lit(schema).alias("schema"), "people", "keys", "ambiguous_nicknames")


def damaged_files(spark: SparkSession, path: str, kind: T.StructType, schemas: tuple, required: tuple[str, ...]) -> DataFrame:
    """path and error of JSON files that cannot be used: not_json, unsupported_schema,
    or the first required field that is missing."""
    files = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), "value")
    whole = T.StructType([*kind.fields, T.StructField("_corrupt_record", _S)])
    parsed = files.select("path", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    error = F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "not_json")
    error = error.when(~F.coalesce(F.col("r.schema").isin(*schemas), F.lit(False)), "unsupported_schema")
    for name in required:
        error = error.when(F.col(f"r.{name}").isNull(), f"missing {name}")
    return parsed.select("path", error.alias("error")).where("error is not null")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles with their required fields; others are left out, extra fields dropped."""
    files = spark.read.option("multiLine", "true").schema(T.StructType([T.StructField("people", T.ArrayType(PROFILE))])).json(path)
    return files.select(F.inline("people")).where("region is not null and name is not null and slug is not null and card_path is not null")
