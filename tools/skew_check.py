"""Skew check: how much of a stage's input does its largest task read?

Derives a skewed log from the given ``events`` table: a third of all rows
come from one client, and half of those are exact copies (same client and
timestamp).  Runs the rate, split and feature jobs with Spark's event log in
a scratch folder and prints, per job, the heaviest task's shuffle-read
records relative to the mean task of the same stage (worst heavy stage).

    python -m tools.skew_check [/root/testdata/sf0.1]
"""

from __future__ import annotations

import glob
import io
import json
import sys
import tempfile
from collections import defaultdict


def _events(log_dir: str):
    import zstandard

    for f in sorted(glob.glob(f"{log_dir}/*/events_*")):
        raw = open(f, "rb").read()
        try:
            text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode()
        except zstandard.ZstdError:
            text = raw.decode()
        for line in text.splitlines():
            if line.strip():
                yield json.loads(line)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="loglens-evlog-")
    from pyspark.sql import functions as F

    from loglens.operators import ordering, rate
    from loglens.operators.boundaries import boundary_split
    from loglens.plans.feature_builder import FeatureBuilder
    from loglens.session import build_session
    from loglens.sources import fixture

    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file:{log_dir}",
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    log = fixture.fixture_log(spark, sf)
    r = F.col("event_id") % 6
    skewed = (log.withColumn("client_ip", F.when(r < 2, F.lit("10.9.9.9")).otherwise(F.col("client_ip")))
                 .withColumn("timestamp", F.when(r == 0, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
                             .otherwise(F.col("timestamp"))))
    n = skewed.count()
    sc = spark.sparkContext

    def run(label, make):
        sc.setJobGroup(label, label)  # also for jobs that run while the plan is made
        df = make() if callable(make) else make
        df.write.format("noop").mode("overwrite").save()

    run("rate bucketed", rate.request_rate(skewed, 60))
    run("rate window", rate.request_rate(skewed, 60, method="window"))
    # all traffic of one client within one minute, at distinct times: one bucket, many ranges
    crowded = log.withColumn("client_ip", F.lit("10.9.9.9")).withColumn(
        "timestamp", F.timestamp_micros(F.lit(1705320000000000) + F.col("event_id") * 500).cast("timestamp_ntz"))
    run("crowded bucketed", rate.request_rate(crowded, 60))
    rate.PIECE_BITS = 8  # small pieces for a small table
    run("crowded dense", lambda: rate.request_rate(crowded, 60, method="dense"))
    run("row index", ordering.with_row_index(skewed, ["timestamp", "event_id"]))
    sc.setJobGroup("split by boundary", "split by boundary")
    split = boundary_split(skewed, tiebreak=["event_id"])
    run("split by boundary", split)
    fb = FeatureBuilder().fit(split.where(F.col("split") == "train"))
    run("features", fb.transform(split, partition_cols=["split"], impute_columns=[]))
    spark.stop()

    job_group, stage_job = {}, {}
    task_reads = defaultdict(list)
    for e in _events(log_dir):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for s in e["Stage IDs"]:
                stage_job[s] = g
        elif ev == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            rec = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
            task_reads[e["Stage ID"]].append(rec)
    report = defaultdict(lambda: (0.0, 0, 0, 0))
    for stage, recs in task_reads.items():
        g = stage_job.get(stage)
        total = sum(recs)
        if not g or total < n // 2:  # the heavy stages only
            continue
        ratio = max(recs) / (total / len(recs))  # 1.0 = perfectly even
        if ratio > report[g][0]:
            report[g] = (ratio, max(recs), total, len(recs))
    print(f"rows={n}, hot client = 1/3 of rows, copies = 1/6 of rows; heaviest task / mean task "
          f"over each job's heavy stages (1.0 = even)")
    for g, (ratio, mx, total, tasks) in report.items():
        print(f"{g:18s} {ratio:5.2f}x  (largest task {mx} of {total} shuffle records, {tasks} tasks)")


if __name__ == "__main__":
    main(sys.argv)
