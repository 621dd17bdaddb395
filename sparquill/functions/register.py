"""The Python functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparquill.functions import charset, text, urls

FUNCTIONS = {
    "fold": text.fold,
    "name_words": text.words,
    "closeness": text.closeness,
    "fold_each": text.fold_each,
    "unescape_html": text.unescape,
    "article_identity": urls.article_identity,
    "article_title": urls.article_title,
    "absolute_url": urls.absolute,
    "decode_page": charset.decode_as,
    "odd_units": charset.odd_units,
    "unit_category": charset.unit_category,
    "title_escape": charset.title_escape,
}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
