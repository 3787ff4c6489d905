"""Running values of jobs of any length: stretches give what one window gives."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import jobs, ordered

EVENTS = 1_000_000


@pytest.fixture(scope="module")
def events(spark):
    """A job of a million events beside some short ones; times and steps now and then missing, starts in
    twos and threes, and a null job."""
    i = F.col("id")
    job = F.when(i < EVENTS, 7).when(i % 50 == 0, None).otherwise(i % 40)
    h = F.pmod(F.xxhash64(i), F.lit(1000))
    ts = F.when(h != 3, F.timestamp_micros(1_700_000_000_000_000 + i * 1_000_000 + F.pmod(F.xxhash64(i, F.lit(1)), F.lit(500)) * 1000))
    kind = F.when(F.pmod(F.xxhash64(F.floor(i / 3)), F.lit(5)) == 0, "PIPELINE_START").otherwise("SECTION_1_START")
    rows = spark.range(0, EVENTS + 4000, 1, 8).select(job.cast("bigint").alias("job_id"), i.alias("ord"), ts.alias("ts"), kind.alias("type"), F.when(h % 11 != 0, (h % 97).cast("double")).alias("seconds"))
    yield rows.cache()
    rows.unpersist()


def digest(df):
    """Rows, and sums that tell whether they are the same; doubles to nine digits."""
    cols = [F.format_string("%.9g", c) if t == "double" else F.col(c).cast("string") for c, t in df.dtypes]
    h = F.xxhash64(*[F.coalesce(c, F.lit("-")) for c in cols])
    return df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()


@pytest.mark.parametrize(
    "operator",
    [
        lambda e, n: jobs.checkpoint_durations(e, long=n).drop("type"),
        lambda e, n: jobs.rolling_eta(e, 2_000_000 - F.col("ord"), long=n).drop("type"),
        lambda e, n: jobs.rolling_eta(e, 2_000_000 - F.col("ord"), steps_kept=1, in_progress=True, long=n).drop("type"),
        lambda e, n: jobs.timeline(e, "job_id", "ord", F.coalesce("seconds", F.lit(0.25)), F.lit(0.5), long=n).drop("type"),
        lambda e, n: jobs.run_segments(e, long=n),
        lambda e, n: ordered.numbered(e, ["job_id"], ["ord"], "n", long=n),
        lambda e, n: ordered.numbered(e.filter("job_id = 7"), [], ["ord"], "n", long=n),
    ],
    ids=["durations", "eta", "eta_of_one", "timeline", "runs", "numbers", "all"],
)
def test_stretches_equal_one_window(events, operator):
    in_stretches = operator(events, 100_000)
    assert digest(in_stretches) == digest(operator(events, 10 * EVENTS))


def test_no_task_holds_more_than_a_stretch(events):
    hot = events.filter("job_id = 7")
    rows = ordered.in_stretches(hot, ["job_id"], ["ord"], 20)
    sizes = [r["count"] for r in rows.groupBy(ordered.STRETCH).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 100_000


def test_tiny_stretches(spark):
    """Stretches of a row or two: what is carried comes from several stretches before."""
    made = spark.createDataFrame([(j, o, ty, s) for j in (1, None) for o, (ty, s) in enumerate(zip(["PIPELINE_START"] * 3 + ["x", "PIPELINE_START", "x", "PIPELINE_START", "PIPELINE_START"], [1.0, None, 3.0, None, None, None, 7.0, 8.0]))], "job_id int, ord int, type string, seconds double").withColumn("ts", F.timestamp_seconds(F.col("ord") * F.col("ord")))
    for operator in (jobs.checkpoint_durations, jobs.run_segments, lambda e, long: jobs.rolling_eta(e, 9 - F.col("ord"), long=long), lambda e, long: jobs.timeline(e, "job_id", "ord", F.coalesce("seconds", F.lit(0.0)), F.lit(1.0), long=long)):
        want = sorted(map(tuple, operator(made, long=100).collect()), key=repr)
        for long in (1, 3):
            assert sorted(map(tuple, operator(made, long=long).collect()), key=repr) == want


def test_empty(spark):
    none = spark.createDataFrame([], "job_id int, ord int, ts timestamp, type string, seconds double")
    assert jobs.checkpoint_durations(none, long=1).collect() == jobs.run_segments(none, long=1).collect() == ordered.numbered(none, [], ["ord"], "n", long=0).collect() == []
