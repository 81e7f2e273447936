"""Times of lectures by label, by text, and around the turn of a year."""

from pyspark.sql import functions as F

from bulletin.functions import lecture_time as L

COLUMNS = "body string, title string, url_year int, title_year int, published string"


def settled(spark, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + COLUMNS)
    t = L.lecture_time(F.col("body"), F.col("title"), F.col("url_year"), F.col("title_year"), F.col("published"), F.lit(2024))
    got = df.select("k", t["start"].cast("string"), t["end"].cast("string"), t["confidence"], t["note"]).orderBy("k").collect()
    return [tuple(r)[1:] for r in got]


def test_labels(spark):
    body = "发布时间：2025-01-02\n报名时间：2025年1月3日\n会议时间：2025年1月4日截止\n请各位留意：\n时间：2025年1月5日\nTime: 2025-01-06 14:30\n讲座时间：1月7日"
    got = spark.createDataFrame([(body,), (None,), ("",)], "b string").select(L.label_times(F.col("b")).alias("t")).collect()
    assert [(h.tier, h.label.strip(), str(h.seg.start), h.seg.from_full) for h in got[0].t] == [(2, "时间", "2025-01-05 00:00:00", True), (1, "Time:", "2025-01-06 14:30:00", True), (1, "讲座时间", "2000-01-07 00:00:00", False)]
    assert got[1].t == got[2].t == []


def test_a_label_with_a_full_date_stands(spark):
    assert settled(
        spark,
        ("时间：2025年1月5日\n讲座时间：2025年6月3日 14:30-16:00", None, None, None, None),
        ("讲座时间：2024年6月3日\n报告时间：2025年6月4日", None, 2025, None, None),
        ("报名时间：2020年1月1日", None, None, None, None),
    ) == [
        ("2025-06-03 14:30:00", "2025-06-03 16:00:00", "high", "authoritative-label"),
        ("2025-06-04 00:00:00", None, "high", "authoritative-label"),
        ("2020-01-01 00:00:00", None, "high", "general-body-full"),
    ]


def test_month_and_day_take_a_year(spark):
    assert settled(
        spark,
        ("讲座时间：6月3日 9:00", None, None, None, None),
        ("讲座时间：6月3日 9:00", None, 2023, 2022, "2021-05-01"),
        ("讲座时间：6月3日", None, None, None, "2021-05-01"),
        ("讲座时间：1月3日 9:00-10:00", None, None, None, "2021-12-20"),
        ("定于1月3日 9:00-10:00", None, None, None, "2021-12-20"),
        ("讲座时间：6月3日\n时间：2022年6月3日", None, None, 2022, None),
        ("none", None, None, None, None),
        (None, None, None, None, None),
    ) == [
        ("2024-06-03 09:00:00", None, "high", "monthday-nopublish"),
        ("2023-06-03 09:00:00", None, "low", "crossyear-uncertain"),
        ("2021-06-03 00:00:00", None, "high", "same-year"),
        ("2021-01-03 09:00:00", "2021-01-03 10:00:00", "high", "same-year"),
        ("2021-01-03 09:00:00", "2021-01-03 10:00:00", "high", "same-year"),
        ("2022-06-03 00:00:00", None, "high", "monthday-nopublish"),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_the_turn_of_a_year_moves_both_ends(spark):
    assert settled(spark, ("讲座时间：1月3日 9:00-10:00", "预告", 2021, None, "2022-02-20"), ("讲座时间：1月3日 9:00-10:00", "x", 2021, None, "2022-12-20")) == [
        ("2022-01-03 09:00:00", "2022-01-03 10:00:00", "high", "preview-nextyear"),
        ("2022-01-03 09:00:00", "2022-01-03 10:00:00", "high", "crossyear-window"),
    ]


def test_first_time(spark):
    none = F.lit(None).cast("int")
    rows = spark.createDataFrame([("2020-01-01 时间：6月3日 9:00",), ("时间：待定 2020-01-01",), (None,)], "t string")
    got = rows.select(L.first_time(F.col("t"), F.lit(2024), F.lit(None).cast("string"), none, F.lit(2023))["start"].cast("string")).collect()
    assert [r[0] for r in got] == ["2023-06-03 09:00:00", "2020-01-01 00:00:00", None]
