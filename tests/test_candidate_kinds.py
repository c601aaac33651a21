"""Kinds of candidates by their nested links."""

from pyspark.sql import functions as F

from quarry.functions import scalars as s


def test_candidate_kinds(spark):
    rows = [
        (0, None, None, "isolated", False),
        (1, None, ("root",), "isolated", True),
        (2, None, ("predecessor",), "adjacent", False),
        (3, None, ("successor",), "adjacent", False),
        (4, ("parent",), ("successor",), "excluded", False),
        (5, ("parent",), ("root",), "excluded", True),
    ]
    schema = "id int, followUp struct<of:string>, neighbourhood struct<role:string>, arm string, root boolean"
    found = spark.createDataFrame(rows, schema).select("id", "arm", "root", s.candidate_arm(F.col("followUp"), F.col("neighbourhood")).alias("got_arm"), s.targets_root(F.col("neighbourhood")).alias("got_root"))
    for r in found.collect():
        assert (r.got_arm, r.got_root) == (r.arm, r.root), r.id
