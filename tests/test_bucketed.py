"""Joins over bucketed tables: the rows of plain ones, and no exchange below them."""

from pyspark.sql import functions as F

from motilis.operators import exposure, signals
from motilis.sources import bucketed


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_labels_meet_their_plan_without_a_shuffle(spark):
    plan = spark.range(4000).select(F.format_string("c%02d", F.col("id") % 40).alias("clip_id"), F.floor(F.col("id") / 40).cast("int").alias("i")).withColumn("t_s", F.col("i") / 4.0)
    labels = plan.filter("i % 7 != 3").select("clip_id", "t_s", F.lit(1).cast("long").alias("seq"), (F.col("i") % 2 == 0).alias("manipulation"), F.lit(1).alias("hands_visible"), F.lit(None).cast("string").alias("unreadable_reason"))
    labels = labels.unionByName(labels.filter("i = 5").withColumn("seq", F.lit(2).cast("long")).withColumn("manipulation", F.lit(True)))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain = signals.join_labels(plan, labels)
        assert exchanges(plain) >= 2
        p, l = (bucketed.bucketed(x, "clip_id", buckets=6) for x in (plan, labels))
        with bucketed.without_shuffle(spark):
            met = signals.join_labels(p, l)
            assert exchanges(met) == 0 and met.rdd.getNumPartitions() == 6
            rows = sorted(map(tuple, met.collect()), key=repr)
        assert rows == sorted(map(tuple, plain.collect()), key=repr) and len(rows) == 4000
        # two rates of one corpus: duty cycles by clip, paired by clip
        signal = plan.withColumn("v", F.col("i") % 3 == 0)
        clips = plan.select("clip_id").distinct().withColumn("duration_s", F.lit(70.0))
        s, c = (bucketed.bucketed(x, "clip_id", buckets=6) for x in (signal, clips))
        with bucketed.without_shuffle(spark):
            pairs = exposure.paired_duty_cycles(exposure.duty_cycle_estimate(s, c), exposure.duty_cycle_estimate(s.filter("i % 2 = 0"), c))
            assert exchanges(pairs) == 0
            got = sorted(map(tuple, pairs.collect()))
        assert got == sorted(map(tuple, exposure.paired_duty_cycles(exposure.duty_cycle_estimate(signal, clips), exposure.duty_cycle_estimate(signal.filter("i % 2 = 0"), clips)).collect())) and len(got) == 40
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
