"""A chain of stages, each a function, with a JSON log from which a later run goes on where the last one failed."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

Stages = list[tuple[str, Callable[[], object]]]


def run(spark: SparkSession, stages: Stages, log: str, resume: str | None = None, go_on: bool = False) -> list[dict]:
    """Run stages in turn and write what became of each to log; those that succeeded or were skipped in `resume` are skipped."""
    done = set()
    if resume:
        rows = spark.read.json(resume).where("status in ('success', 'skipped_resume')").select("name").collect()
        done = {r["name"] for r in rows}
    said: list[dict] = []
    for name, stage in stages:
        if name in done:
            said.append({"name": name, "status": "skipped_resume", "seconds": 0.0, "error": ""})
            continue
        began = time.time()
        try:
            stage()
            said.append({"name": name, "status": "success", "seconds": round(time.time() - began, 3), "error": ""})
        except Exception as e:  # noqa: BLE001  whatever a stage fails with is what the log is for
            said.append({"name": name, "status": "failed", "seconds": round(time.time() - began, 3), "error": str(e)[-4000:]})
            if not go_on:
                break
    spark.createDataFrame(said, "name string, status string, seconds double, error string").coalesce(1).write.mode("overwrite").json(log)
    return said
