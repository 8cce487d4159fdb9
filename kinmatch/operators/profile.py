"""Data profiles and match diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.text import scripts

#: Probabilities of the quantile report.
QUANTILES = (0.0, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 1.0)


def empty_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: rows, empty or blank values, and their percentage; one pass over the table."""
    blank = [F.sum((F.trim(F.coalesce(c, F.lit(""))) == "").cast("long")).alias(c) for c in columns]
    one = df.agg(F.count("*").alias("rows"), *blank)
    long = one.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("empty_rows")) for c in columns))).alias("x"))
    return long.select("x.column_name", "rows", "x.empty_rows", F.when(F.col("rows") > 0, 100.0 * F.col("x.empty_rows") / F.col("rows")).otherwise(F.lit(0.0)).alias("empty_percent"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct ids, extra rows, and ids that occur more than once."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_ids"), F.sum(F.col("n") - 1).alias("extra_rows"), F.sum((F.col("n") > 1).cast("long")).alias("duplicated_ids"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values with count and share."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_all")).alias("share"))


def describe(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles (exact, linear) of a number."""
    one = df.select(value.alias("v"))
    q = lambda p: F.percentile("v", F.lit(p))
    return one.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("v").alias("max")).select(F.lit(name).alias("measure"), "*")


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """(measure, quantile, value) with exact linear interpolation."""
    one = df.agg(*(F.percentile(c, F.array(*(F.lit(p) for p in probabilities))).alias(c) for c in columns))
    parts = [F.struct(F.lit(c).alias("measure"), F.lit(p).alias("quantile"), F.col(c)[i].alias("value")) for c in columns for i, p in enumerate(probabilities)]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select(*keep, "x.*")


def grouped_means(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """(measure, group, mean): the transposed table of means."""
    means = df.groupBy(by).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns))
    return long_form(means, columns, [by])


def rate_above(df: DataFrame, columns: Sequence[str], thresholds: Sequence[float], by: str) -> DataFrame:
    """Share of values at or above each threshold, by measure and group; aggregated before it is unpivoted."""
    cells = [(c, t) for c in columns for t in thresholds]
    wide = df.groupBy(by).agg(*(F.avg((F.col(c) >= t).cast("double")).alias(f"m{i}") for i, (c, t) in enumerate(cells)))
    parts = [F.struct(F.lit(c).alias("measure"), F.lit(float(t)).alias("threshold"), F.col(f"m{i}").alias("rate")) for i, (c, t) in enumerate(cells)]
    return wide.select(by, F.explode(F.array(*parts)).alias("x")).select(by, "x.*")


def script_pairs(attached: DataFrame, left: str, right: str) -> DataFrame:
    """How often which scripts of one side meet which of the other."""
    return attached.select(scripts(left).alias("script_s1"), scripts(right).alias("script_target")).groupBy("script_s1", "script_target").agg(F.count("*").alias("n"))


def match_count_distribution(counts: DataFrame, most: int = 5) -> DataFrame:
    """Records by number of matches, the last group being ``most`` or more."""
    return counts.groupBy(F.least("n_matches", F.lit(most)).alias("match_group")).agg(F.count("*").alias("n"))


def match_summary(counts: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return counts.agg(
        F.count("*").alias("entities"),
        n(F.col("n_matches") == 0).alias("no_match"),
        n(F.col("n_matches") >= 1).alias("one_or_more"),
        n(F.col("n_matches") > 1).alias("several"),
        F.sum("n_s2").alias("s2_matches"),
        F.sum("n_s3").alias("s3_matches"),
        n(F.col("n_s2") > 0).alias("with_s2"),
        n(F.col("n_s3") > 0).alias("with_s3"),
    )


def longest(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` longest values; equal lengths in order of value."""
    return df.select(column, F.length(column).alias("n_chars")).orderBy(F.desc("n_chars"), F.asc(column)).limit(n)


def short_values(df: DataFrame, column: str, most: int = 3) -> DataFrame:
    return df.filter(F.length(F.trim(column)) <= most)


def country_profile(df: DataFrame, country: str, name: str) -> DataFrame:
    """Per country: records, blank names, distinct names, rank by size."""
    per = df.groupBy(country).agg(F.count("*").alias("n"), F.sum((F.trim(F.col(name)) == "").cast("long")).alias("blank_names"), F.countDistinct(name).alias("distinct_names"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(country))))  # one row a country
