"""Ranks over many vessels and partitions."""

import pytest
from pyspark.sql import functions as F
from vesselwatch.operators.score import ranked, top_vessels


@pytest.mark.parametrize(("n", "partitions"), [(0, 4), (1, 4), (1_000_000, 64)])
def test_ranks_are_one_to_n(spark, n, partitions):
    scored = spark.range(n).select((F.col("id") * 7919 % 1_000_003).alias("mmsi"), (F.col("id") % 1000 / 7).alias("score"), F.lit("x").alias("other"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = ranked(scored)
        facts = got.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("mmsi").alias("vessels")).first()
        assert tuple(facts) == (n, n, 1 if n else None, n or None, n)
        pairs = got.select(F.col("rank") + 1, "score", "mmsi").toDF("rank", "before", "vessel_before")
        wrong = got.join(pairs, "rank").where((F.col("score") > F.col("before")) | ((F.col("score") == F.col("before")) & (F.col("mmsi") < F.col("vessel_before"))))
        assert wrong.count() == 0
        top = top_vessels(scored, 3).orderBy("rank").select("mmsi", "rank").collect()
        assert top == got.where("rank <= 3").orderBy("rank").select("mmsi", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
