"""Headline timings; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sparkwarden import build_session  # noqa: E402
from sparkwarden.plans.proofs import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# The first cloud query also normalises its source into the event table.
HEADLINE = (
    "seq_pair",
    "seq_pair_no_blocker",
    "first_use_inventory",
    "anchored_inventory",
    "context_timeline",
    "evidence_grouping",
    "dedupe_deliveries",
    "event_identity",
    "explode_same_element",
    "score_metrics",
    "cloudtrail_files",
    "cloudtrail_events",
    "aws_new_key_admin_attach",
    "aws_log_stop_public_ingress",
    "aws_log_stop_public_ingress_restart_aware",
    "hunt_aws_key_first_use",
    "azure_diag_delete_role_assign",
    "entra_sp_cred_app_role",
    "hunt_entra_signin_inventory",
    "gcp_new_key_set_policy",
    "gcp_bucket_public_grant",
    "hunt_gcp_key_use",
    "findings_baseline",
    "finding_timelines",
)


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    timings: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
