"""Command line: train, infer, sweep, diagnose, compare and validate.

``python -m kinmatch validate MATCHING CANDIDATES TEST_DIR`` exits with 0 if the lists keep all rules;
a file that cannot be read, or is no UTF-8 text, is an error like any other.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from kinmatch.operators import diagnostics, records
from kinmatch.operators.validate import validate
from kinmatch.plans import linkage
from kinmatch.sources import tables


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kinmatch")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("validate", help="check written id lists")
    check.add_argument("matching")
    check.add_argument("candidates")
    check.add_argument("test_dir")
    check.add_argument("--no-ids", action="store_true", help="do not look up target ids")
    fit = commands.add_parser("train", help="train a model; write its bundle, metrics and the tables of every stage")
    fit.add_argument("train_dir")
    fit.add_argument("bundle")
    fit.add_argument("out_dir")
    fit.add_argument("--sample", type=int, default=linkage.Settings.sample)
    fit.add_argument("--profile", default=linkage.Settings.profile, choices=("ascii", "unicode"))
    use = commands.add_parser("infer", help="write candidate and match lists")
    use.add_argument("test_dir")
    use.add_argument("bundle")
    use.add_argument("out_dir")
    use.add_argument("-k", type=int, default=linkage.Settings.k)
    use.add_argument("--threshold", type=float, default=linkage.Settings.threshold)
    use.add_argument("--profile", default=linkage.Settings.profile, choices=("ascii", "unicode"))
    sweep = commands.add_parser("sweep", help="score a written feature table and sweep the threshold")
    sweep.add_argument("features")
    sweep.add_argument("bundle")
    sweep.add_argument("out")
    look = commands.add_parser("diagnose", help="write tables of true pairs and hard negatives")
    look.add_argument("train_dir")
    look.add_argument("out_dir")
    two = commands.add_parser("compare", help="show two records key by key")
    two.add_argument("train_dir")
    two.add_argument("s1_id")
    two.add_argument("target_id")
    return parser


def _compare(spark: SparkSession, args) -> int:
    sides = [spark_records(spark, f"{args.train_dir}/train_source1.tsv"), spark_records(spark, *(f"{args.train_dir}/train_source{i}.tsv" for i in (2, 3)))]
    found = diagnostics.compare_pair(*sides, args.s1_id, args.target_id)
    print(diagnostics.shown(found))
    return 0 if found.count() else 1


def spark_records(spark: SparkSession, *paths: str):
    """The records of all files with their training and inference keys."""
    raw = tables.read_tsv(spark, paths[0])
    for path in paths[1:]:
        raw = raw.unionByName(tables.read_tsv(spark, path))
    return records.with_training_keys(records.with_keys(records.normalized(raw)))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("kinmatch").getOrCreate()
    try:
        if args.command == "train":
            for name, value in linkage.run_training(spark, args.train_dir, args.bundle, args.out_dir, linkage.Settings(sample=args.sample, profile=args.profile)).items():
                print(f"{name}: {value}")
            return 0
        if args.command == "infer":
            linkage.run_inference(spark, args.test_dir, args.bundle, args.out_dir, linkage.Settings(k=args.k, threshold=args.threshold, profile=args.profile))
            return 0
        if args.command == "sweep":
            print(diagnostics.shown(linkage.run_sweep(spark, args.features, args.bundle, args.out).orderBy("threshold")))
            return 0
        if args.command == "diagnose":
            linkage.run_diagnostics(spark, args.train_dir, args.out_dir)
            return 0
        if args.command == "compare":
            return _compare(spark, args)
        errors, warnings = validate(spark, args.matching, args.candidates, args.test_dir, not args.no_ids)
    except (OSError, PySparkException) as problem:
        print(f"error: {str(problem).splitlines()[0]}")
        return 1
    except ValueError as problem:
        print(f"error: {problem}")
        return 1
    for kind, lines in (("error", errors), ("warning", warnings)):
        for line in lines:
            print(f"{kind}: {line}")
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
