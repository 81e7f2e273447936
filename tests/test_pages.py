"""Pages to records and sessions: example pages, odd pages, and places cleaned twice."""

import pytest
from pyspark.sql import functions as F

from bulletin.functions import labels
from bulletin.operators import pages, split


def page(title, body):
    return f'<html><head><title>{title}</title><script>var x="</p>题目：错";</script></head><body><nav><a href="/x">更多</a></nav><h1>{title}</h1><div class="wp_articlecontent">{body}</div></body></html>'


PAGES = [
    (1, "https://a.test/a/20250301/1.html", page("学术讲座：深度学习之美", "<p>讲座题目：深度学习之美</p><p>时间：2025年3月11日 14:30-16:00</p><p>地点：理6栋 302 腾讯会议 123</p><p>报告人：张三丰 教授（北京大学）</p><p>邀请人：李四光</p><p>摘要：本次报告介绍深度学习的若干进展，内容丰富。</p>")),
    (2, "https://a.test/b.html", page("论坛", "报告人：国家杰青刘梦赤教授长江学者陈建二教授 时间：2025年3月11日 14:30 题目：大论")),
    (3, "https://a.test/c.html", page("三月通知", "时间:2025年3月11日 报告一 时间:9:00-9:50 题目:甲论 报告人:张三丰教授 报告二 时间:10:00-10:40 题目:乙论")),
    (4, "https://a.test/d.html", page("数学之《群与环的故事》", "3月5日晚在理学院报告厅举行。王小明首先介绍了群论的历史与发展以及相关背景知识。随后他讲述了环的结构与表示的若干问题及其应用前景。<p>王小明现任某大学教授，多年从事代数学研究，毕业于北京大学，获奖多项，发表论文。</p>")),
    (5, None, None),
    (6, "", ""),
    (7, "x", "<p><b>no end <div class=content><p>x</div> < & &amp; </p></p>" + "长" * 5000),
    (8, "y", page("征文启事", "时间：2025年3月11日 14:30")),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id bigint, url string, html string, title string, `a.b` int").repartition(3)
    return pages.page_records(rows.drop("title", "a.b").withColumn("speaker", F.lit("clash"))).collect()


def test_records_of_each_kind_of_page(records):
    by = {}
    for r in sorted(records, key=lambda r: (r.page_id, r.lectureIndex or 0)):
        by.setdefault(r.page_id, []).append(r)
    assert sorted(by) == [1, 2, 3, 4, 5, 6, 7]  # 8 is no lecture
    one = by[1][0]
    assert (one.topic, one.topicSource, one.lectureStart, one.lectureEnd) == ("深度学习之美", "label", "2025-03-11 14:30:00", "2025-03-11 16:00:00")
    assert (one.location, one.speaker, one.speakerAffiliation, one.inviter) == ("理6栋302", "张三丰", "北京大学", "李四光")
    assert one.abstract == "本次报告介绍深度学习的若干进展,内容丰富。" and one.publishTimeSource == "url_proxy"
    assert [(r.speaker, r.speakerTitle, r.lectureIndex, r.sourceCount) for r in by[2]] == [("刘梦赤", "国家杰青", 1, 1), ("陈建二", "长江学者", 2, 0)]
    assert [(r.topic, r.lectureStart, r.speaker, r.speakerSource) for r in by[3]] == [("甲论", "2025-03-11 09:00:00", "张三丰", "block"), ("乙论", "2025-03-11 10:00:00", "张三丰", "inherited")]
    four = by[4][0]
    assert (four.topic, four.location, four.locationSource) == ("数学之《群与环的故事》", "理学院报告厅", "narrative")
    assert [(by[k][0].title, by[k][0].speaker) for k in (5, 6)] == [("", ""), ("", "")]


def test_an_empty_table_of_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert split.detect(none.select(F.col("page_id").alias("key"), F.col("html").alias("text"), F.col("url").alias("title"), F.col("url").alias("published"), F.lit(2024).alias("default_year"), F.lit(None).cast("int").alias("title_year"), F.lit(None).cast("int").alias("url_year"))).collect() == []
    assert pages.contents(none).collect() == []


def test_places_are_clean_and_stay_so(spark):
    rows = [("理6栋 302 腾讯会议 123", "x"), ("石牌校区研究生院 1 11 2018年4月8日", ""), ("腾讯会议:123456", None), ("一课北904经典解释与宗教", "经典解释与宗教中国化"), ("Room 5（线上：", None), (None, None), ("", ""), ("行政楼会议室诚挚邀请大家", None), ("理;三", None)]
    df = spark.createDataFrame(rows, "p string, t string").withColumn("once", pages.clean_place(F.col("p"), F.col("t")))
    got = df.withColumn("twice", pages.clean_place(F.col("once"), F.col("t"))).collect()
    assert [r.once for r in got] == ["理6栋302", "石牌校区研究生院111", "线上", "一课北904", "Room5", "", "", "行政楼会议室", "理"]
    assert all(r.once == r.twice or r.once == "线上" for r in got)


def test_scan_cuts_at_labels_longest_first(spark):
    text = "主讲人简介：某某 主讲人：张三 时间2025 地点：A【B】 题目： 主题:甲 浏览 5"
    (row,) = spark.createDataFrame([(text,), ]).toDF("t").select(labels.scan(labels.flatten(F.col("t"))).alias("s"), labels.scan(F.lit(None).cast("string")).alias("n")).collect()
    assert [(x.label, x.value) for x in row.s] == [("主讲人简介", "某某"), ("主讲人", "张三"), ("地点", "A"), ("题目", ""), ("主题", "甲")] and row.n == []


def test_sessions_of_lists_and_of_one_time_are_none(spark):
    two = "题目:甲论 时间:2025年3月11日 14:30 题目:{} 时间:2025年3月{}日 14:30"
    rows = [(1, two.format("乙论", 12), 0), (2, two.format("乙论", 11), 0), (3, two.format("甲论", 12), 0), (4, two.format("乙论", 12), 2), (5, None, 0), (6, "", None)]
    df = spark.createDataFrame(rows, "key int, text string, anchors int").selectExpr("*", "'x' AS title", "CAST(NULL AS STRING) AS published", "2024 AS default_year", "CAST(NULL AS INT) AS title_year", "CAST(NULL AS INT) AS url_year")
    assert {r.key for r in split.detect(df, anchors=F.col("anchors")).collect()} == {1}


def test_links_to_lectures_are_counted(spark):
    rows = [(1, "/a", "学术讲座预告一"), (1, "#x", "学术讲座预告二"), (1, "javascript:;", "学术讲座预告三"), (1, "http://u/", "学术讲座预告四"), (1, "/b", "讲座"), (2, "", "学术讲座预告五")]
    df = spark.createDataFrame([(*r, "http://u") for r in rows], "key int, href string, text string, url string")
    assert {(r.key, r.anchors) for r in split.lecture_anchors(df, "key").collect()} == {(1, 1), (2, 0)}
