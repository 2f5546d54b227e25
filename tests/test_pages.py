"""Every page at once gives what turning pages gives, in a number of jobs that the rows do not change."""

from datetime import datetime

from pyspark.sql import functions as F

from fieldmark.operators import registry, serve


def saved_log(spark, n):
    rows = [(f"fw_{i}", i % 7, None if i % 9 == 0 else datetime(2024, 1, 1 + i % 11), i % 4 == 3) for i in range(n)]
    made = spark.createDataFrame(rows, "framework_id string, k int, created_at timestamp, deleted boolean")
    return made.withColumns({"seq": F.lit(1), "based_on": F.lit(None).cast("int"), "writer": F.lit("w"), "updated_at": F.lit(datetime(2024, 2, 1))})


def turned(log, limit):
    out, after, number = [], None, 0
    while True:
        seen, more = serve.has_more(registry.list_saved(log, limit, after).collect(), limit)
        out += [(r["framework_id"], number) for r in seen]
        if not more:
            return sorted(out)
        after, number = tuple(seen[-1][c] for c in registry.NEWEST_SAVED), number + 1


def test_every_page_equals_turned_pages(spark):
    for n, limit in ((23, 5), (23, 40), (20, 18), (0, 5)):  # rows without a time only fit on the first page
        log = saved_log(spark, n)
        found = registry.list_saved(log, limit, every=True)
        assert sorted((r["framework_id"], r["page"]) for r in found.collect()) == turned(log, limit)


def test_jobs_do_not_grow_with_pages(spark):
    sc, jobs = spark.sparkContext, []
    for n in (10, 200):
        sc.setJobGroup(f"pages-{n}", "")
        found = registry.list_saved(saved_log(spark, n).coalesce(1), 5, every=True)
        assert found.agg(F.max("page")).first()[0] >= n // 10
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"pages-{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(jobs) <= 2 * min(jobs) and max(jobs) < 40
