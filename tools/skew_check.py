"""Hot-key behaviour of the skew-sensitive operators, measured from Spark's event log.

Usage: python tools/skew_check.py [sf_dir]

Derives skewed inputs from the benchmark tables — one third of all events moved
to a single user, one third of all points moved into a single mesh cell — runs
dedup (A8), category count (A1), category share (W2) and the capped sweep (R5)
on 16 input partitions, and reads per-task shuffle metrics from the event log
(written to a fresh scratch folder). Writes SKEW.md.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from poicraft.operators import categories as cat, dedup, enrich, mesh, shares  # noqa: E402
from poicraft.plans import bindings as B  # noqa: E402


def session(log_dir: str) -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("skew-check")
             .config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .config("spark.eventLog.rolling.enabled", "false")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             # small thresholds so AQE's skew-join split is visible at test scale
             .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
             .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_metrics(log_dir: str):
    """{job_group: [(stage_name, records_written, max_task_records_read, tasks)]}."""
    written, max_read, tasks, names, group = defaultdict(int), defaultdict(int), defaultdict(int), {}, {}
    job_group = {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if os.path.isdir(path):
            continue
        for line in open(path):
            e = json.loads(line)
            kind = e.get("Event")
            if kind == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    job_group[sid] = g
            elif kind == "SparkListenerStageCompleted":
                info = e["Stage Info"]
                names[info["Stage ID"]] = info["Stage Name"].split(" at ")[0]
            elif kind == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                sid = e["Stage ID"]
                m = e["Task Metrics"]
                written[sid] += m.get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)
                max_read[sid] = max(max_read[sid], m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
                tasks[sid] += 1
    out = defaultdict(list)
    for sid in sorted(tasks):
        out[job_group.get(sid)].append((sid, names.get(sid, "?"), written[sid], max_read[sid], tasks[sid]))
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="poicraft-eventlog-")
    spark = session(log_dir)
    sc = spark.sparkContext
    ev = B.table(spark, sf, "events")
    hot_events = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0))
                               .otherwise(F.col("user_id"))).repartition(16)
    pts = B.points(spark, sf)
    hot_pts = pts.withColumn("lat", F.when(F.col("id") % 3 == 0, F.lit(0.01)).otherwise(F.col("lat"))) \
        .withColumn("lng", F.when(F.col("id") % 3 == 0, F.lit(0.01)).otherwise(F.col("lng"))).repartition(16)
    n_events, n_hot = hot_events.count(), hot_events.filter("user_id = 0").count()
    n_pts = hot_pts.count()
    catalog = ev.select(F.col("user_id").cast("string").alias("id_act"),
                        F.col("event_type").alias("actividad"))
    runs = {
        "A8 dedupe_by_key(user_id)": lambda: dedup.dedupe_by_key(hot_events, ["user_id"], ["event_id"]),
        "A1 category_count(user_id)": lambda: cat.category_count(hot_events, "user_id"),
        "W2 category_share(user_id, event_type)": lambda: shares.category_share(hot_events, "user_id", "event_type"),
        "R5 mesh_sweep(cap 3)": lambda: mesh.mesh_sweep(hot_pts, (-1.0, -1.0), (1.0, 1.0), 60, 70, 3),
        "J2 catalog_match, shuffle join, a third on one code": lambda: enrich.catalog_match(
            hot_events.withColumn("codigo_act", F.col("user_id").cast("string")), catalog,
            code_col="codigo_act", broadcast_bytes=-1),
        "J2 catalog_match, shuffle join, half without a code": lambda: enrich.catalog_match(
            hot_events.withColumn("codigo_act", F.when(F.col("event_id") % 2 == 0, F.lit("S/N")).otherwise(
                F.col("user_id").cast("string"))), catalog, code_col="codigo_act", broadcast_bytes=-1),
        "J1 postal_enrich, shuffle join, half without a code": lambda: enrich.postal_enrich(
            hot_events.withColumn("postalCode", F.when(F.col("event_id") % 2 == 0, F.lit("S/N")).otherwise(
                F.col("user_id").cast("string"))),
            catalog.select(F.col("id_act").alias("d_codigo"), F.col("actividad").alias("D_mnpio"),
                           F.lit("x").alias("d_tipo_asenta")), broadcast_bytes=-1),
    }
    for i, (label, build) in enumerate(runs.items()):
        sc.setJobGroup(f"g{i}", label)
        build().write.format("noop").mode("overwrite").save()
    spark.stop()
    metrics = stage_metrics(log_dir)
    lines = ["# SKEW — hot keys measured from the event log", "",
             f"Generated by `tools/skew_check.py` at `{sf}` (local[8], 16 input partitions, 16 shuffle",
             "partitions, AQE coalescing off so partitions are visible). Inputs are derived from the",
             f"tables: events with one third moved to user 0 ({n_hot:,} of {n_events:,} rows), points with",
             f"one third moved into one mesh cell ({n_pts:,} points). For each operator: the shuffle",
             "records the map side wrote (after partial aggregation / partial group limit) and the",
             "largest number of records a single reduce task read.", "",
             "| operator | stage | records written by map side | max records read by one task | tasks |",
             "|---|---|---|---|---|"]
    for i, label in enumerate(runs):
        stages = metrics.get(f"g{i}", [])
        for k, (sid, name, w, r, t) in enumerate(stages):
            role = ("spread input (round robin)" if k == 0 else
                    "reduce side (final)" if k == len(stages) - 1 else "map side (partial) → shuffle")
            lines.append(f"| {label} | {sid}: {role} | {w:,} | {r:,} | {t} |")
    lines += ["", "For J1 and J2 the catalogue is forced past its broadcast bound, so the lookup runs as a",
              "shuffle join. Every catalogue row is replicated 32 times and a fact meets one copy, chosen",
              "by a hash of its columns and input partition; facts without a code are spread by the",
              "whole hash (J2) or dropped before the join (J1)."]
    lines += ["", "The first stage of each operator only spreads the input round robin (every task reads",
              "an equal share). A hot key would show up in the later stages as one task reading about",
              "a third of the input. Here the",
              "map side sends at most one row per key (A8, A1, W2's aggregate) or at most `cap` rows per",
              "cell (R5) from each of the 16 input partitions, so the hot group's reducer reads at",
              "most 16 rows (A8, A1) or 16 × 3 rows (R5) for it."]
    path = __file__.rsplit("/tools/", 1)[0] + "/SKEW.md"
    open(path, "w").write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
