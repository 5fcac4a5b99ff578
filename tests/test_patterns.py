"""Patterns with lookbehinds, control letters and named groups."""

from pyspark.sql import functions as F

from wareproof.functions import patterns


def test_lookbehinds_may_stand_beside_repeats(spark):
    cases = [
        (r"(?<=[A-Z]-)\d+", "K-123", True), (r"(?<=[A-Z]-)\d+$", "k-123", False), ("(?<!a)b*c", "abc", True), (r"\d+(?<=5)x", "45x", True),
        (r"^\cA$", "\x01", True), (r"^\cj$", "\n", True), (r"^[\cb]$", "\x02", True), (r"^\cA$", "cA", False), (r"(?<y>a)b", "ab", True),
        ("(?<!(a|b)c{2})d+", "xd", True), ("(a*)(?<=b)c", "bc", True),
    ]
    df = spark.createDataFrame(cases, "p string, v string, hit boolean")
    for r in df.select("*", patterns.problem(F.col("p")).alias("x"), F.rlike("v", patterns.to_engine(F.col("p"))).alias("got")).collect():
        assert r.x is None and r.got == r.hit, r


def test_what_is_refused(spark):
    bad = ["(?<=a+)b", "x*(?<=a*)b", "(?<!(a|b+))c", "(?<=(?<=a+)b)c", "(?<=a{2,})b", "(?<!(a|b){2})c+", r"(?<y>a)\k<y>"]
    df = spark.createDataFrame([(p,) for p in bad], "p string")
    assert all(r.x is not None for r in df.select("p", patterns.problem(F.col("p")).alias("x")).collect())
