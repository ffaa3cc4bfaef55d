"""Time funnels and KPIs on the even and skewed copies; per-stage task times
come from Spark's event log written to a scratch folder.

Usage: python tools/scale_run.py OUT_DIR  (after tools/scale_build.py)
"""
import sys, os, json, time, glob, tempfile, statistics
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession
from sessionflow.session import RECOMMENDED_CONF
from sessionflow.operators import funnel, commerce, overview
from sessionflow.sources.parquet import ParquetEventSource
from sessionflow.sources.fixture import FIXTURE_OFFICIAL


def main():
    logdir = tempfile.mkdtemp(prefix="evlog-")
    b = (SparkSession.builder.master("local[8]").appName("scale")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "16")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.dir", "file://" + logdir)
         .config("spark.driver.memory", "8g"))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate(); spark.sparkContext.setLogLevel("ERROR")
    root = sys.argv[1]
    off = FIXTURE_OFFICIAL
    cases = []
    for data in ("even", "skewed"):
        src = ParquetEventSource(spark, f"{root}/{data}")
        cases += [
            (f"{data}/ordered_funnel", lambda s=src: funnel.ordered_funnel(s, off)),
            (f"{data}/presence_vs_ordered", lambda s=src: funnel.presence_vs_ordered(s, off)),
            (f"{data}/kpi_overview", lambda s=src: commerce.kpi_overview(s, off)),
            (f"{data}/dataset_overview", lambda s=src: overview.dataset_overview(s)),
        ]
    walls = {}
    for rep in range(3):
        for name, fn in cases:
            spark.sparkContext.setJobDescription(f"{name}#{rep}")
            t0 = time.perf_counter(); rows = fn().collect(); walls.setdefault(name, []).append(time.perf_counter() - t0)
            if rep == 2 and "ordered_funnel" in name:
                print(name, [r.sessions for r in rows])
    spark.stop()
    # task durations per stage from the event log, per query (second repetition)
    stage_q, tasks = {}, {}
    for f in glob.glob(logdir + "/**/events_*", recursive=True):
        for line in open(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                d = (e.get("Properties") or {}).get("spark.job.description", "")
                for sid in e["Stage IDs"]:
                    stage_q[sid] = d
            elif e["Event"] == "SparkListenerTaskEnd":
                ti = e["Task Info"]; tasks.setdefault(e["Stage ID"], []).append(ti["Finish Time"] - ti["Launch Time"])
    for name, _ in cases:
        stages = [sid for sid, d in stage_q.items() if d == f"{name}#2" and sid in tasks]
        worst = max(stages, key=lambda s: max(tasks[s]), default=None)
        if worst is None:
            continue
        t = tasks[worst]
        print(f"{name:36s} wall={min(walls[name]):6.2f}s stages={len(stages):2d} slowest-task={max(t)/1000:5.2f}s "
              f"median-task-in-that-stage={statistics.median(t)/1000:5.2f}s tasks={len(t)}")


if __name__ == "__main__":
    main()
