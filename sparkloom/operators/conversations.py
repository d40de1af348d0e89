"""Chat sessions as rows of turns: filters, truncation, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import session_title

ROLES = ("user", "assistant", "system")
TOKENS_A_WORD, MOST_TOKENS, LAST = 4, 3500, 10


def known_roles(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("role").isin(*ROLES) & F.col("text").isNotNull())


def n_words(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"(\S+)"), 1))


def truncated(turns: DataFrame, most_tokens: int = MOST_TOKENS, last: int = LAST) -> DataFrame:
    """All turns of short conversations, the last ones of long. Lengths are summed before the shuffle, and ranks cut there."""
    sizes = turns.groupBy("conv_id").agg(F.sum(n_words(F.col("text")) * TOKENS_A_WORD).alias("__tokens"))
    short = F.coalesce(F.col("__tokens"), F.lit(0)) <= most_tokens
    sized = turns.join(sizes, "conv_id")
    ranked = sized.where(~short).withColumn("__rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("__rank") <= last)
    return sized.where(short).drop("__tokens").unionByName(ranked.drop("__tokens", "__rank"))


def titles(turns: DataFrame) -> DataFrame:
    """(conv_id, title) from the first thing that the user said."""
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return turns.select("conv_id").distinct().join(first, "conv_id", "left").select("conv_id", session_title(F.coalesce("text", F.lit(""))).alias("title"))


def long_enough(x: Column, n: int = 5) -> Column:
    return F.coalesce(n_words(x) >= n, F.lit(False))
