"""Facts read from source and prose with regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that look like calls and are none.
KEYWORDS = ("if", "for", "while", "switch", "return", "sizeof")


def call_sites(texts: DataFrame) -> DataFrame:
    """Called names of each text and how often."""
    name = F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))
    return texts.select("id", name.alias("name")).where(~F.col("name").isin(*KEYWORDS)).groupBy("id", "name").agg(F.count("*").alias("n"))


def masked(text: Column) -> Column:
    """Without markup comments, string literals and repeated white space."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r'"[^"\n]*"', '""')
    return F.trim(F.regexp_replace(bare, r"[ \t\n]+", " "))


def first_distinct(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The first ``n`` distinct values of each group. Ranking comes first, so no group is gathered whole."""
    w = Window.partitionBy(group).orderBy(value)
    return rows.select(group, value).distinct().withColumn("i", F.row_number().over(w)).where(F.col("i") <= n).drop("i")


def condition_shape(condition: Column, name: str) -> Column:
    """The tracked name becomes $resource, other lower-case names $value; constants stay."""
    shaped = F.regexp_replace(condition, rf"\b{name}\b", "@@")
    shaped = F.regexp_replace(shaped, r"\b[a-z_][a-z0-9_]*\b", r"\$value")
    return F.regexp_replace(shaped, "@@", r"\$resource")


def null_guard(condition: Column, name: str) -> Column:
    return F.coalesce(condition.rlike(rf"\b{name}\b *[!=]= *NULL"), F.lit(False))


def bounded(text: Column, most: int = 40) -> Column:
    """Head and tail of a longer text around an ellipsis."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit("..."), F.right(text, F.lit(half)))).otherwise(text)


def weak_mentions(prose: DataFrame, strong: DataFrame) -> DataFrame:
    """Names that stand in prose only."""
    return prose.select("name").distinct().join(strong.select("name").distinct(), "name", "left_anti")
