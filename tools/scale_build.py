"""Build a larger and a skewed copy of the test events for the scale experiment.

Usage: python tools/scale_build.py OUT_DIR COPIES
``OUT_DIR/even``: the sf0.1 event view repeated COPIES times under distinct
users; ``OUT_DIR/skewed``: the same with every third event moved into one
session (user ``bot``, session 1).
"""
import sys, os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F
from sessionflow.session import local_session
from sessionflow.sources.fixture import DerivedEventSource
from sessionflow.sources.parquet import write_events


def main():
    spark = local_session(8)
    out = sys.argv[1]
    copies = int(sys.argv[2])
    base = DerivedEventSource(spark, "/root/testdata/sf0.1").table()
    # copies of every event under distinct users (user id suffixed with the copy number)
    rep = base.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rep = rep.withColumn("user_pseudo_id", F.when(F.col("user_pseudo_id").isNotNull(),
                         F.concat(F.col("user_pseudo_id"), F.lit("-"), F.col("_c").cast("string")))).drop("_c")
    write_events(rep, out + "/even", files_per_day=8)
    # skewed variant: every third event belongs to one bot session (same ids, same session)
    sk = rep.withColumn("_h", F.pmod(F.xxhash64("user_pseudo_id", "event_timestamp", "event_name"), F.lit(3)))
    sk = sk.withColumn("user_pseudo_id", F.when(F.col("_h") == 0, F.lit("bot")).otherwise(F.col("user_pseudo_id")))
    sk = sk.withColumn("event_params", F.when(F.col("_h") == 0, F.array(F.struct(F.lit("ga_session_id").alias("key"),
          F.struct(F.lit(None).cast("string").alias("string_value"), F.lit(1).cast("long").alias("int_value"),
                   F.lit(None).cast("double").alias("float_value"), F.lit(None).cast("double").alias("double_value")).alias("value"))))
          .otherwise(F.col("event_params"))).drop("_h")
    write_events(sk, out + "/skewed", files_per_day=8)
    print(spark.read.parquet(out + "/even").count(), spark.read.parquet(out + "/skewed").where("user_pseudo_id = 'bot'").count())


if __name__ == "__main__":
    main()
