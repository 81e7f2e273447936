"""Text, dates and predicates on literal rows whose results were derived by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from bulletin.functions import dates as D, predicates as P, text as T

L = F.lit


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def of(*columns):
        row = one.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
        return list(row) if len(columns) > 1 else row[0]

    return of


def test_text(value):
    assert value(T.join_cjk(L("题 目 时 间")), T.half_width(L("（甲，乙）")), T.split_bilingual(L("时间/Time: 9"))) == ["题目 时间", "(甲,乙)", "时间：Time： 9"]
    assert value(T.label_text(L("题 目：甲 【地点】乙"))) == "题目：甲 地点：乙"
    assert value(T.strip_footer(L("正文" * 20 + "版权所有 某")), T.clean_title(L("2024-05-21艺术 - 学院"))) == ["正文" * 20, "艺术"]
    assert value(T.truncate(L("abcdef"), 4), T.clean_footer(L("a Copyright b")), T.safe_url(L("javascript:x")), T.safe_url(L(" https://a "))) == ["abc…", "a", "#", "https://a"]


def test_tokens_and_similarity(value):
    a, b = T.topic_tokens(L("abcd")), T.topic_tokens(L("abce"))
    assert sorted(value(a)) == ["ab", "abcd", "bc", "cd"] and value(T.topic_tokens(L("a"))) == [] and value(T.topic_tokens(L("ab"))) == ["ab"]
    assert value(T.jaccard(a, b), T.jaccard(a, T.topic_tokens(L("")))) == [pytest.approx(2 / 6), 0.0]


def test_notes_and_abstracts(value):
    assert value(T.notes_text(F.array(L("公开"), L("内部 x"), L("也"))), T.notes_text(L(None).cast("array<string>"))) == ["公开；也", ""]
    assert value(T.abstract_of(L("主讲人简介 x"), L(None).cast("string")), T.abstract_of(L("短 文"), L("这是短文和更多的十几个字而已"))) == ["", ""]


def test_periods_and_clocks(value):
    assert value(D.in_period(L(3), L("下午")), D.in_period(L(11), L("中午")), D.in_period(L(9), L("上午")), D.in_period(L(12), L("下午"))) == [15, 23, 9, 12]
    assert value(D.make_day(L("2025"), L("2"), L("30")), D.make_day(L("2024"), L("2"), L("29"))) == [None, datetime.date(2024, 2, 29)]


def test_crossing_years(value):
    ts, day = (lambda s: L(s).cast("timestamp_ntz")), (lambda s: L(s).cast("date"))
    go = lambda s, p, retro=False, preview=False: tuple(value(D.cross_year(ts(s), day(p), L(retro), L(preview))))
    at = datetime.datetime
    assert go("2024-01-05 00:00:00", "2024-12-28") == (at(2024, 1, 5), "high", "same-year")
    assert go("2024-05-05 00:00:00", "2025-11-28") == (at(2024, 5, 5), "low", "crossyear-uncertain")
    assert go("2023-01-05 00:00:00", "2024-12-28") == (at(2024, 1, 5), "high", "crossyear-window")
    assert go("2025-12-05 00:00:00", "2024-01-28") == (at(2024, 12, 5), "low", "crossyear-window-prev")
    assert go("2025-12-05 00:00:00", "2024-01-28", preview=True) == (at(2025, 12, 5), "high", "preview-normal")
    assert go("2024-02-29 00:00:00", "2024-02-29") == (at(2024, 2, 29), "high", "same-day-normal")


def test_publish_time(value):
    none = L(None).cast("string")
    assert list(value(D.publish_time(L("发布时间：2025-05-20 15:09:00 正文"), none))) == ["2025-05-20 15:09:00", 1]
    assert list(value(D.publish_time(L("2025-05-20 15:09 点击 76"), none))) == ["2025-05-20 15:09", 2]
    assert list(value(D.publish_time(L("x 2025-05-20 y"), none))) == ["2025-05-20", 3]
    assert list(value(D.publish_time(L("x"), none))) == [None, 0]


def test_cross_validation(value):
    r = value(D.cross_validate(L("2025-05-20 15:00:00"), L("2025-05-20 14:00:00"), L("2025-08-20").cast("date"), L("2025-06-01")))
    assert list(r) == ["2025-05-20 14:00:00", "2025-05-20 15:00:00", ["cv-url-date-mismatch", "cv-publish-after-lecture", "cv-end-before-start-swapped"]]


def test_keys_and_states(value):
    assert value(D.day_key(L("2025-07-02 15:00:00")), D.day_key(L(None).cast("string")), D.short_time(L("2025-07-02 15:00:00"))) == ["2025-07-02 周三", "时间待定", "7月2日 周三 15:00"]
    now = L("2025-07-01 00:00:00").cast("timestamp_ntz")
    assert [tuple(value(D.status(L(s).cast("string"), now))) for s in ("2025-07-02 15:00:00", "2025-08-02 15:00:00", "2025-06-02 15:00:00", None)] == [("即将开始", True), ("即将开始", False), ("已结束", False), ("时间待定", False)]
    assert value(D.split_location(L("南教-209教室14: 30-17: 00")), D.absolute_url(L("/x"), L("https://a/"))) == ["南教-209教室", "https://a/x"]


def test_titles(value):
    assert value(P.is_lecture(L("学术讲座")), P.is_lecture(L("讲座回顾")), P.is_lecture(L(None).cast("string")), P.is_other_title(L("招聘启事"))) == [True, False, False, True]
    assert value(P.is_list_item(L("砺儒论坛一"), L("https://a/a/20260616/348.html")), P.is_list_item(L("首页链接"), L("https://a/a/20260616/348.html"))) == [True, False]
    assert value(P.is_admin_notice(L("关于举办教师培训会的通知"), L("")), P.is_admin_notice(L("关于举办培训的通知"), L("主讲人：张三")), P.is_admin_notice(L("关于举办培训的通知"), L("全体教师"))) == [True, False, True]


def test_gate_is_never_null(value):
    none = L(None).cast("string")
    assert value(P.is_dropped(none, none, none, none, none, L(None).cast("boolean"))) is False
    assert value(P.is_dropped(L("讲座圆满结束"), none, none, none, none, L(True)), P.is_dropped(L("讲座圆满结束"), none, none, none, none, L(False))) == [False, True]


def test_names(value):
    assert value(P.looks_like_name(L("张三")), P.looks_like_name(L("John Smith")), P.looks_like_name(L("professor")), P.looks_like_name(L("李题")), P.looks_like_name(L("讲坛甲"), ("讲坛",))) == [True, True, False, False, False]
    assert value(P.looks_like_name(L("学术讲座")), P.looks_like_name(L("广州")), P.looks_like_name(L("陈建二"))) == [False, False, True]
