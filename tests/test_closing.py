"""A cancellation by tag reaches a run's work, not the jobs that record how it ended."""

import threading
import time

import pytest

from fieldmark.operators import versions
from fieldmark.plans import experiment, lifecycle
from tests.test_experiment import matrix  # noqa: F401 (a fixture)
from tests.test_lifecycle import head, paths, run  # noqa: F401 (a fixture)


def test_closing_jobs_carry_no_tag(spark, matrix, paths, monkeypatch):  # noqa: F811
    tag, seen = lifecycle.tag_of("e1"), []

    def watched(name, do):
        def call(*args, **kwargs):
            seen.append((name, kwargs.get("status"), tag in spark.sparkContext.getJobTags()))
            return do(*args, **kwargs)

        return call

    def stopped(*_, **__):
        raise RuntimeError("cancelled")

    monkeypatch.setattr(lifecycle, "next_version", watched("version", lifecycle.next_version))
    monkeypatch.setattr(experiment, "append", watched("run", experiment.append))
    monkeypatch.setattr(experiment, "walk_forward", stopped)
    spark.sparkContext.addJobTag(tag)
    try:
        with pytest.raises(RuntimeError, match="cancelled"):
            run(spark, paths, "e1", matrix)
        assert tag in spark.sparkContext.getJobTags()
    finally:
        spark.sparkContext.removeJobTag(tag)
    assert seen == [("version", "running", True), ("run", None, False), ("version", "failed", False)]
    assert head(spark, paths, "e1")["status"] == "failed"


def test_a_cancellation_right_after_a_claim_leaves_no_running_config(spark, matrix, paths, monkeypatch):  # noqa: F811
    tag, judge, stoppers = lifecycle.tag_of("e1"), versions.rejected, []

    def stop():
        for _ in range(10):
            spark.sparkContext.cancelJobsWithTag(tag)
            time.sleep(0.1)

    def slowly(log, key):  # the claim can be seen already, and its writer reads whether it stands
        if not stoppers:
            stoppers.append(threading.Thread(target=stop))
            stoppers[0].start()
        return judge(log.where("java_method('java.lang.Thread', 'sleep', 1000L) is null"), key)

    monkeypatch.setattr(versions, "rejected", slowly)
    monkeypatch.setattr(experiment, "walk_forward", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("stopped")))
    spark.sparkContext.addJobTag(tag)
    try:
        with pytest.raises(RuntimeError, match="stopped"):
            run(spark, paths, "e1", matrix)
    finally:
        spark.sparkContext.removeJobTag(tag)
        stoppers[0].join()
    assert head(spark, paths, "e1")["status"] == "failed"
