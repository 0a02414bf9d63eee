"""The audit of a chain of values."""

from pyspark.sql import functions as F

from tidemark.operators import audit


def test_first_break_and_observed_counts(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("A", 1, 1.0, 2.0, 3.0), ("A", 2, 1.0, nan, None), ("A", 3, 1.0, -inf, 3.0), ("A", 4, 1.0, 2.0, None), ("B", 1, None, 2.0, 3.0), ("B", 2, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, t int, a double, b double, c double").repartition(3)
    marked, seen = audit.observed(df, ["a", "b", "c"])
    out = sorted(map(tuple, audit.breaks(marked, ["k"], "t").collect()), key=str)
    assert out == [("A", 2, 2, 2), ("A", 3, 4, 1), ("A", None, 1, 1), ("B", 1, 1, 1), ("B", None, 2, 1)]
    assert seen.get == {"rows": 6, "a": 1, "b": 2, "c": 2}
    assert marked.select(F.max("first_bad")).first()[0] == 3
