"""Page ranges and voices: against comparing all with all, at size, and the cases that are errors."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import joins


def test_pages_equal_comparing_all(spark):
    rng = random.Random(2)
    pages = [(b, rng.randrange(1, 400)) for b in (1, 2, 3) for _ in range(300)] + [(None, 5)]
    chapters = [(b, n, a, a + rng.choice([-3, 0, 1, 40, 63, 64, 65, 200, 10**9])) for b in (1, 2, 4) for n, a in enumerate(rng.sample(range(0, 420), 25))]
    wanted = [(b, n) for b, n, *_ in chapters if rng.random() < 0.3] + [(1, 999)]
    got = joins.pages_of_chapters(spark.createDataFrame(pages, "book int, page_no int"), spark.createDataFrame(chapters, "book int, number int, start_page int, end_page int"), spark.createDataFrame(wanted, "book int, number int"))
    want = [(b, p) for b, p in pages if any(c == b and (c, n) in wanted and a <= p <= e for c, n, a, e in chapters)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_book_of_many_chapters_takes_linear_time(spark):
    """Ten times the chapters and pages of one book; comparing all with all would take a hundred times."""
    took = []
    for n in (10_000, 100_000):
        chapters = spark.range(n).select(F.lit(1).alias("book"), F.col("id").alias("number"), (F.col("id") * 3 + 1).alias("start_page"), (F.col("id") * 3 + 3).alias("end_page"))
        pages = spark.range(1, 3 * n + 1).select(F.lit(1).alias("book"), F.col("id").alias("page_no"))
        began = time.perf_counter()
        assert joins.pages_of_chapters(pages, chapters, chapters.filter("number % 2 = 0").select("book", "number")).count() == 3 * n / 2
        took.append(time.perf_counter() - began)
    assert took[1] <= 10 * took[0] + 5


def test_a_page_past_the_end_is_an_error(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 9)] + [(2, p) for p in range(1, 9)], "book int, page_no int")
    chapters = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 5, 8)], "book int, number int, start_page int, end_page int")
    ask = lambda *rows: spark.createDataFrame(rows, "book int, number int")
    got = lambda asked, **more: sorted(map(tuple, joins.pages_wanted(pages, chapters, asked, **more).collect()))
    assert got(ask((1, 2), (2, 3), (2, 8), (1, 9))) == [(1, 5), (1, 6), (1, 7), (1, 8), (2, 3), (2, 8)]
    with pytest.raises(Exception, match="page 9 of book 2 is not there, it has 8"):
        got(ask((1, 2), (2, 9)))
    with pytest.raises(Exception, match="page 1 of book 3 is not there, it has 0"):
        got(ask((3, 1)))
    assert got(ask((2, 3), (2, 9), (3, 1)), strict=False) == [(2, 3)]


def test_voices_by_any_beginning(spark):
    catalog = spark.createDataFrame(list(enumerate(["zh-CN-A", "zh-CN-B", "zh-HK-A", "zh-CN-C", "zh-CN-D", "en-US-A"])), "catalog_pos int, voice string")
    asked = ["zh-C", "zh-CN-X", "zh-", "zh", "en-US-A", "fr-FR-A", "zh-CN-A-b", ""]
    requests = spark.createDataFrame([(i, v, "en-US-A" if i == 5 else None) for i, v in enumerate(asked)], "request_id int, voice string, fallback string")
    got = {r.request_id: (r.voice, r.how, r.suggestions) for r in joins.resolve_voice(requests, catalog).collect()}
    three = "zh-CN-A,zh-CN-B,zh-CN-C"
    assert got[0] == ("zh-C", "unverified", three) and got[1][2] == got[6][2] == three
    assert got[2][2] == "zh-CN-A,zh-CN-B,zh-HK-A" and got[3][2] == got[7][2] == "en-US-A"
    assert got[4][1] == "exact" and got[5] == ("en-US-A", "fallback", None)
