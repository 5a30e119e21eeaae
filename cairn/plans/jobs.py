"""Jobs that can be watched and stopped: one Spark job group for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def run(spark: SparkSession, group: str, work: Callable, description: str = ""):
    """Run ``work()`` under a job group."""
    sc = spark.sparkContext
    sc.setJobGroup(group, description or group, interruptOnCancel=True)
    try:
        return work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def stop(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def progress(spark: SparkSession, group: str) -> dict[str, int]:
    """Tasks done and in all, over the group's active stages."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s:
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return {"done": done, "total": total}
