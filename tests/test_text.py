from pyspark.sql import functions as F

from kinmatch.functions import text


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_ascii_profile(spark):
    got = one(spark, text.normalize, "A&B", "  !!! ", None, "Café & Sons, Ltd.", "a_b", "NA")
    assert got == ["a b", "", "", "caf sons ltd", "a_b", "na"]


def test_unicode_profile(spark):
    got = one(spark, lambda c: text.normalize(c, "unicode"), "A&B", "ﬁ①", "STRASSE ß", "नमस्ते", "  !!! ", None)
    assert got == ["a and b", "fi1", "strasse ss", "नमस त", "", ""]


def test_keys(spark):
    df = spark.createDataFrame([("in", "a b_c1", ""), ("in", "", "12 road")], "c string, n string, a string")
    rows = df.select(text.prefix_key("c", "n", 4), text.compact_block("c", "n", 4), text.compact_block("c", "a", 8), text.compact_block("c", "a", 8, include_blank=True)).collect()
    assert [tuple(r) for r in rows] == [("in|a b_", "in|abc1", "", "in|"), ("", "", "in|12road", "in|12road")]


def test_id_lists(spark):
    df = spark.createDataFrame([(" S2-1, ,S3-2,S2-1 ",), ("",), (None,)], "x string")
    rows = df.select(text.id_list("x").alias("i")).select("i", text.count_from("i", "S2"), text.count_from("i", "S3")).collect()
    assert [tuple(r) for r in rows] == [(["S2-1", "S3-2", "S2-1"], 2, 1), ([], 0, 0), ([], 0, 0)]


def test_scripts(spark):
    assert one(spark, text.scripts, "abc", "123 !", "abc नम", "漢字 a", None) == ["Latin", "None", "Devanagari+Latin", "Latin+Other", "None"]


def test_length_counts_code_points(spark):
    assert one(spark, F.length, "😀a") == [2]


def test_source_of(spark):
    assert one(spark, text.source_of, "S1-1", "S2-x", "X-1", "S4-1") == ["S1", "S2", None, None]
