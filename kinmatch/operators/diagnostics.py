"""Reports on pairs: true pairs beside hard negatives, one pair key by key, the shape of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.scoring import ranking_score
from kinmatch.functions.similarity import exact_normalized, exact_raw, jaccard, lcs_ratio, tokens
from kinmatch.functions.text import scripts, text
from kinmatch.operators.features import attach, numeric_overlap, same_country
from kinmatch.operators.ranking import S1, TARGET, capped_blocks, hard_negatives

#: Measures that true pairs and hard negatives are compared by.
MEASURES = ("name_similarity", "address_similarity", "name_jaccard", "address_jaccard", "numeric_overlap", "country_same")


def measured(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (with target_source) and their measures; a missing text has similarity 0."""
    a, b = tokens, tokens
    return attach(pairs, s1, targets).select(
        S1,
        TARGET,
        "target_source",
        lcs_ratio("s_name_norm", "t_name_norm", 0.0).alias("name_similarity"),
        lcs_ratio("s_address_norm", "t_address_norm", 0.0).alias("address_similarity"),
        jaccard(a("s_name_norm"), b("t_name_norm")).alias("name_jaccard"),
        jaccard(a("s_address_norm"), b("t_address_norm")).alias("address_jaccard"),
        numeric_overlap().alias("numeric_overlap"),
        same_country().alias("country_same"),
    )


def block_negatives(s1: DataFrame, targets: DataFrame, truth: DataFrame, key: str = "name_block", cap: int = 500, k: int = 5, least_name: float = 0.45) -> DataFrame:
    """Hard negatives of one block key: each record meets at most ``cap`` targets of its block and country, and keeps its best ``k`` wrong ones a source.

    The cap is part of this diagnostic (a sample of large blocks); records are keyed tables, true pairs never count.
    """
    left = s1.filter(F.col(key) != "").select(F.col("entity_id").alias(S1), F.col(key).alias("block"), F.col("country_norm").alias("c1"))
    right = capped_blocks(targets, key, cap).select(F.col("entity_id").alias(TARGET), F.col(key).alias("block"), F.col("country_norm").alias("c2"))
    met = left.join(right, "block").filter(F.col("c1") == F.col("c2")).select(S1, TARGET, F.substring(TARGET, 1, 2).alias("target_source"))
    scored = measured(met, s1, targets).withColumn("ranking_score", ranking_score())
    return hard_negatives(scored, truth, k, least_name)


def true_and_negative(truth: DataFrame, negatives: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs (label 1) and hard negatives (label 0) with the measures they share."""
    columns = [S1, TARGET, "target_source", *MEASURES]
    true = measured(truth.select(S1, TARGET, "target_source"), s1, targets)
    return true.select(*columns, F.lit(1).alias("label")).unionByName(negatives.select(*columns, F.lit(0).alias("label")))


def with_texts(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with the four raw texts of their records."""
    raw = lambda d, tag, key: d.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{tag}_name"), F.col("business_address").alias(f"{tag}_address"))
    return pairs.join(raw(s1, "s1", S1), S1).join(raw(targets, "target", TARGET), TARGET)


def match_diagnostics(truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The measures, raw lengths, missing flags and scripts of every true pair."""
    met = attach(truth.select(S1, TARGET, "target_source"), s1, targets)
    met = with_texts(met, s1, targets)
    flag = lambda c: (F.trim(text(c)) == "").cast("int")
    out = {"country_same": same_country()}
    for field in ("name", "address"):
        s, t = f"s_{field}_norm", f"t_{field}_norm"
        out |= {
            f"{field}_raw_exact": exact_raw(f"s1_{field}", f"target_{field}"),
            f"{field}_normalized_exact": exact_normalized(s, t),
            f"{field}_ratio": lcs_ratio(s, t),
            f"{field}_jaccard": jaccard(tokens(s), tokens(t)),
        }
    out |= {
        "name_length_s1": F.length("s1_name"),
        "name_length_target": F.length("target_name"),
        "s1_address_missing": flag("s1_address"),
        "target_address_missing": flag("target_address"),
        "address_numeric_overlap": numeric_overlap(),
        "s1_name_script": scripts("s1_name"),
        "target_name_script": scripts("target_name"),
    }
    return met.select(S1, TARGET, "target_source", *(c.alias(n) for n, c in out.items()))


def compare_pair(s1: DataFrame, targets: DataFrame, s1_id: str, target_id: str) -> DataFrame:
    """One row a field or key of two keyed records: both values and whether they are equal; empty if either record is missing."""
    left = s1.filter(F.col("entity_id") == s1_id).limit(1)
    right = targets.filter(F.col("entity_id") == target_id).limit(1)
    names = [c for c in s1.columns if c in targets.columns and dict(s1.dtypes)[c] == "string"]
    long = lambda d, name: d.select(F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("field"), F.col(c).alias("value")) for i, c in enumerate(names)))).alias("x")).select("x.position", "x.field", F.col("x.value").alias(name))
    met = long(left, "s1_value").join(long(right, "target_value"), ["position", "field"])
    return met.select("position", "field", "s1_value", "target_value", F.col("s1_value").eqNullSafe(F.col("target_value")).alias("equal")).orderBy("position").drop("position")


def shape(df: DataFrame) -> DataFrame:
    """One row a column: its place, name, type, the table's rows, and how many values are null or blank."""
    blank = lambda c, t: F.sum((F.col(c).isNull() | (F.trim(F.col(c)) == "") if t == "string" else F.col(c).isNull()).cast("long"))
    one = df.agg(F.count("*").alias("rows"), *(blank(c, t).alias(f"b{i}") for i, (c, t) in enumerate(df.dtypes)))
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("blank")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def shown(df: DataFrame, rows: int = 50) -> str:
    """A small result as aligned text, for reports on a terminal."""
    table = df.limit(rows).collect()
    cells = [df.columns, *([f"{v:.6f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in table)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells)
