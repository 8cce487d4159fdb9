"""Rules for the written id lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules, in the order of the report.
RULES = ("malformed_row", "duplicate_row", "repeated_id", "self_match", "wrong_prefix", "unknown_id", "missing_entity", "extra_entity")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Body lines (``value``) to (s1, tabbed, ids); text after the first tab is cut at commas and kept as it is."""
    rest = F.when(F.instr("value", "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    return lines.select(
        F.substring_index("value", "\t", 1).alias("s1"),
        rest.isNotNull().alias("tabbed"),
        F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ",")).alias("ids"),
    )


def offenders(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, offender) of parsed rows; ``required`` holds the S1 ids and ``known`` the target ids (entity_id)."""
    tabbed = rows.filter("tabbed")
    per = tabbed.groupBy("s1").agg(F.count("*").alias("n"))
    each = tabbed.select("s1", F.explode(F.array_distinct("ids")).alias("id"))
    need = required.select(F.col("entity_id").alias("s1")).distinct()
    proper = each.filter(F.col("id").rlike("^S[23]-"))
    found = {
        "malformed_row": rows.filter(~F.col("tabbed") & (F.trim("s1") != "")).select("s1"),
        "duplicate_row": per.filter("n > 1").select("s1"),
        "repeated_id": tabbed.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1").distinct(),
        "self_match": each.filter(F.col("id").startswith("S1-")).select("id").distinct(),
        "wrong_prefix": each.filter(~F.col("id").rlike("^S[123]-")).select("id").distinct(),
        "missing_entity": need.join(per, "s1", "left_anti").select("s1"),
        "extra_entity": per.join(need, "s1", "left_anti").select("s1"),
    }
    if known is not None:
        found["unknown_id"] = proper.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id").distinct()
    return reduce(DataFrame.unionByName, (d.select(F.lit(r).alias("rule"), F.col(d.columns[0]).alias("offender")) for r, d in found.items()))


def report(found: DataFrame, examples: int = 5) -> DataFrame:
    """Per broken rule the number of offenders and the first few in order, found without gathering them all."""
    from pyspark.sql import Window

    first = found.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("offender"))).filter(F.col("r") <= examples)
    few = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("offender")), ",").alias("examples"))
    return found.groupBy("rule").agg(F.count("*").alias("offenders")).join(few, "rule")


def outside(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that are no candidates."""
    return matches.select("source1_entity_id", "target_entity_id").join(candidates, ["source1_entity_id", "target_entity_id"], "left_anti")


def validate(spark: SparkSession, matching: str, candidate: str, test_dir: str, check_ids: bool = True, strict: bool = False) -> tuple[list[str], list[str]]:
    """(errors, warnings) of the two written lists; matches outside the candidates are errors only if ``strict``."""
    from kinmatch.sources.tables import ids_of, list_lines

    required = ids_of(spark, f"{test_dir}/test_source1.tsv")
    known = ids_of(spark, f"{test_dir}/test_source2.tsv").unionByName(ids_of(spark, f"{test_dir}/test_source3.tsv")) if check_ids else None
    errors, warnings, pairs = [], [], []
    for path, column in ((matching, "matched_entity_ids"), (candidate, "candidate_entity_ids")):
        problem, lines = list_lines(spark, path, ["source1_entity_id", column])
        if problem:
            errors.append(problem)
            continue
        rows = parse_lines(lines)
        errors += [f"{path}: {r['rule']}: {r['offenders']} ({r['examples']})" for r in report(offenders(rows, required, known)).orderBy("rule").collect()]
        pairs.append(rows.filter("tabbed").select(F.col("s1").alias("source1_entity_id"), F.explode("ids").alias("target_entity_id")).distinct())
    if len(pairs) == 2 and (n := outside(*pairs).count()):
        (errors if strict else warnings).append(f"{n} matched pairs are no candidates")
    return errors, warnings
