"""A run of steps that is stopped resumes without doing finished ones again."""

import pytest
from pyspark.sql import functions as F

from lociq.plans import steps
from lociq.plans.steps import Step


@pytest.fixture
def plan(spark, tmp_path):
    spark.range(10).withColumn("chrom", (F.col("id") % 3 + 1).cast("string")).write.parquet(str(tmp_path / "in"))
    ran, broken = [], set()

    def work(name, f):
        def go(spark, tables):
            ran.append(name)
            if name in broken:
                raise ValueError("broken")
            return f(tables)

        return go

    def made(factor=2):
        return [
            Step("total", work("total", lambda t: t["scaled"].agg(F.sum("id").alias("id"))), ("scaled",)),
            Step("scaled", work("scaled", lambda t: t["in"].withColumn("id", F.col("id") * factor)), ("in",), {"factor": factor}),
            Step("other", work("other", lambda t: t["in"].limit(1)), ("in",)),
        ]

    return str(tmp_path / "run"), {"in": str(tmp_path / "in")}, made, ran, broken


def test_resumes(spark, plan):
    folder, sources, made, ran, broken = plan
    broken.add("total")
    with pytest.raises(steps.StepFailed, match="step total failed; done: scaled; not run: other"):
        steps.run(spark, folder, made(), sources)
    broken.clear()
    ran.clear()
    assert steps.run(spark, folder, made(), sources) == {"scaled": "kept", "total": "done", "other": "done"} and ran == ["total", "other"]
    assert steps.Store(spark, folder).table("total").first()["id"] == 90
    ran.clear()
    assert set(steps.run(spark, folder, made(), sources).values()) == {"kept"} and not ran
    assert steps.run(spark, folder, made(3), sources) == {"scaled": "done", "total": "done", "other": "kept"}  # a setting changed: that step and what follows
    spark.range(1).withColumn("chrom", F.lit("1")).write.mode("append").parquet(sources["in"])
    assert set(steps.run(spark, folder, made(3), sources).values()) == {"done"}  # the source changed
    assert set(steps.run(spark, folder, made(3), sources, only=["total"])) == {"scaled", "total"}


def test_a_killed_step_is_not_taken_for_finished(spark, plan, tmp_path):
    folder, sources, made, ran, _ = plan
    spark.range(5).write.parquet(f"{folder}/scaled/table")  # written, but without a marker
    (tmp_path / "run" / "total").mkdir()
    (tmp_path / "run" / "total" / steps.DONE).write_text('{"fingerpr')
    assert set(steps.run(spark, folder, made(), sources).values()) == {"done"}
    spark.range(1).write.parquet(f"{folder}/old/table")
    assert steps.clean(spark, folder, made()) == ["old"] and steps.clean(spark, folder, made()) == []


def test_all_chromosomes_are_needed(spark, plan):
    folder, sources, _, _, _ = plan
    seen, missing = [], {"2"}

    def own(spark, tables, chrom):
        if chrom in missing:
            raise ValueError("not phased")
        seen.append(chrom)
        return tables["in"].filter(F.col("chrom") == chrom)

    every = [*steps.by_chromosome("phased", own, ("in",), ("1", "2", "3")), Step("after", lambda s, t: t["phased"].agg(F.count("*").alias("n")), ("phased",))]
    with pytest.raises(steps.StepFailed, match="step phased-2 failed"):
        steps.run(spark, folder, every, sources)
    assert steps.Store(spark, folder).marker("after") is None
    missing.clear()
    steps.run(spark, folder, every, sources)
    assert seen == ["1", "2", "3"] and steps.Store(spark, folder).table("after").first()["n"] == 10
    assert len(steps.by_chromosome("x", own)) == 23


def test_graphs_that_cannot_run(spark, plan):
    folder, sources, made, _, _ = plan
    none = lambda s, t: None
    for bad, why in (([Step("a", none, ("b",)), Step("b", none, ("a",))], "circle"), ([Step("a", none, ("gone",))], "neither"), ([Step("a", none), Step("a", none)], "differ"), ([Step("in", none)], "differ")):
        with pytest.raises(ValueError, match=why):
            steps.run(spark, folder, bad, sources)
    with pytest.raises(steps.StepFailed):
        steps.run(spark, folder, made(), {"in": f"{folder}/nothing"})
