import time

from pyspark.sql import functions as F

from flowlens.llm.common import FREE_SHUFFLES, Scratch


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return disk.getAllFiles().mkString("\n").count("/shuffle_")


def test_a_kept_table_leaves_no_shuffle_behind(spark):
    """Its shuffle files go as soon as it is written, whenever the driver collects its garbage; the session's setting stays as it was."""
    spark._jvm.System.gc()
    time.sleep(2)  # what earlier tests have left
    before, setting = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES, None)
    df = spark.range(0, 100_000, 1, 4).groupBy(F.xxhash64("id").alias("k")).agg(F.max("id").alias("v"))
    t = Scratch(spark, "test").keep(df)
    for _ in range(30):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and spark.conf.get(FREE_SHUFFLES, None) == setting
    assert t.count() == 100_000 and df.count() == 100_000
