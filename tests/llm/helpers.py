import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ba", "co", "du", "fe", "gi", "lo", "mu", "na", "pe", "ri", "so", "tu") for b in ("ran", "sel", "tok", "vim", "wex", "yal", "zor", "den", "pol", "kin")]


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) with further columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("lang", "source", "digest", "node", "score", "size", "keep_id", "norm", "component", "_scored", "_id", "_sha", "quality_score", "p", "target")
    return df.withColumns({c: F.lit("x") for c in clash})


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
