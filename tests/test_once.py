"""Parts of texts are computed once: C10, C11, D2, D3, C13."""

import pytest
from pyspark.sql import functions as F

from bulletin.functions import dates as D, text as T


def jvm_plan(spark, column):
    return spark.range(1).select(column.alias("x"))._jdf.queryExecution().analyzed().toString()


def test_times_are_read_once(spark):
    found = D.segment_time(F.lit("2025年3月11日 14:30"), F.lit(2025), F.lit(None).cast("date"))
    plan = jvm_plan(spark, found)
    assert plan.count("regexp_extract_all") <= 10  # 4 numeric forms and clock times, in each branch once; before 60 and more


@pytest.mark.parametrize("text", ["主 讲 人 : 甲", "主讲座 题 目: 乙", "讲座内 容 摘 要 丙", "报告 主 题 讲 座 题目 时 间", "没有", None, "发 布 时 间　 来 源 ", "主 讲 人 简 介主讲 座 内 容 提 要"])
def test_labels_close_up_as_one_after_the_other(spark, text):
    from functools import reduce

    longest = sorted(T.LABELS, key=len, reverse=True)
    one_by_one = reduce(lambda c, w: F.regexp_replace(c, "".join(f"{ch}{T.SPACE}*" for ch in w), w), longest, F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(T.label_text(F.col("t")).alias("a"), one_by_one.alias("b")).first()
    assert row["a"] == row["b"]


def test_the_footer_is_looked_for_in_a_text_computed_once(spark):
    text = F.regexp_replace(F.concat(F.lit("甲" * 20), F.col("id").cast("string"), F.lit(" 版权所有")), "x", "y")
    assert jvm_plan(spark, T.strip_footer(text)).count("regexp_replace") <= 2


def test_pages_of_sessions_are_flattened_once_and_searched_where_a_label_is(spark):
    """A page's one line was made anew for each of its fields, and every block was cut for fields whose labels it hasn't."""
    from bulletin.functions.labels import block_value
    from bulletin.operators import split

    none = F.lit(None)
    pages = spark.range(3).select("id", F.lit("题目:论一 时间:2024年6月3日 14:30 地点:理楼 题目:论二 时间:2024年6月4日 14:30 专题一:123456789").alias("text"), F.lit("讲座").alias("title"), none.cast("string").alias("published"), F.lit(2024).alias("default_year"), none.cast("int").alias("title_year"), none.cast("int").alias("url_year"))
    found = spark.createDataFrame([(0, 1, "论一", None, None, "时间:2024年6月3日", "topics")], "id long, no int, topic string, start timestamp_ntz, end timestamp_ntz, block string, way string")
    rows = split.records(pages.select("id", "text", "title"), found, "id")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(translate(") <= 1
    assert len(split.marks(pages, "id", "text").select("way").distinct().collect()) == 1
    texts = spark.createDataFrame([("主讲人：张三 参与者:李四 时间",), ("主讲 参与：",), ("主讲嘉宾：王五",), (None,)], "b string")
    assert [r[0] for r in texts.select(block_value(F.col("b"), ("参与者",))).collect()] == ["李四", None, None, None]
    assert [r[0] for r in texts.select(block_value(F.col("b"), ("主讲", "主讲人"))).collect()] == ["张三", None, None, None]


def test_blanks_at_both_ends_go_and_those_between_stay(spark):
    """As the pattern did that looked at every letter."""
    from bulletin.functions.text import SPACE, strip

    texts = spark.createDataFrame([(a + "甲 　乙" + b,) for a in ("", " \t\n", "　 ", " \x85\r\n", "​") for b in ("", "\x0b\x0c ", "  ", "\n   ")] + [("",), (" 　",), (None,)], "t string")
    old = F.regexp_replace("t", f"^{SPACE}+|{SPACE}+$", "")
    assert texts.filter(~strip(F.col("t")).eqNullSafe(old)).count() == 0


@pytest.mark.parametrize("sets", ["field", "block"])
def test_labels_that_begin_alike_are_one_branch(spark, sets):
    """Every letter of a text was held against each of eighty labels, twice."""
    import random

    from bulletin.functions import labels as G

    words, stops = (G.FIELD_LABELS, G.FIELD_STOPS) if sets == "field" else (G.BLOCK_LABELS, G.BLOCK_STOPS)
    each = G.any_label(words)
    assert "主讲人" not in each and each.startswith("(?:")
    r, one = random.Random(3), "|".join(sorted(words, key=len, reverse=True))
    part = lambda: r.choice((*words, r.choice(words)[:2], "：", ":", "《", " ", "2024-1", "【", "[", "甲", "点击", "上午", "第一期", "3月4日"))
    texts = spark.createDataFrame([("".join(part() for _ in range(r.randint(1, 9))),) for _ in range(400)], "t string")
    old = rf"({one})(?!《)\s*[：:]\s*|(?:{one}|{'|'.join(stops)})"
    parts = F.split(F.regexp_replace("t", old, f"{G.CUT}$1{G.THEN}"), G.CUT)
    cut = F.transform(parts, lambda p: F.struct(F.substring_index(p, G.THEN, 1).alias("label"), T.strip(F.substring_index(p, G.THEN, -1)).alias("value")))
    want = F.filter(F.slice(cut, F.lit(2), F.size(cut)), lambda x: x["label"] != "")
    assert texts.filter(~G.scan(F.col("t"), words, stops).eqNullSafe(want)).count() == 0


def test_texts_without_a_title_at_their_end_are_not_searched_for_one(spark):
    """Ten patterns ran through every whole text; the answers are those of the patterns."""
    from functools import reduce

    texts = spark.createDataFrame([(a + b + c,) for a in ("", "张三", "张\n三", "教授") for b in ("", "教授", "副教授", "博士教授", " 讲师", "教授\n", "(a)b", "（x）") for c in ("", "(y)", "（", ")", "2024-05-06", "院士 ")] + [(None,)], "t string")
    old = T.strip(reduce(lambda c, t: F.regexp_replace(c, f"^(.+){t}$", "$1"), T.TITLES, T.strip(F.coalesce("t", F.lit("")))))
    title = F.regexp_replace(F.regexp_replace(T.squeeze(F.coalesce("t", F.lit(""))), "[（(][^）)]*[）)]$", ""), r"(20[0-9]{2}[-/]?[0-9]{2}[-/]?[0-9]{2}|20[0-9]{6})$", "")
    assert texts.filter(~T.normalize_speaker(F.col("t")).eqNullSafe(old) | ~T.normalize_title(F.col("t")).eqNullSafe(title)).count() == 0
    plan = texts.select(T.normalize_speaker(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("EndsWith") + plan.count("endswith") >= 10


def test_words_without_which_no_rule_of_reports_holds(spark):
    from bulletin.functions import predicates as P

    told = ["本次活动的成功举办", "讲座圆满结束", "活动取得圆满成功", "此次报告受到好评", "本次讲座将受到", "我院举办学术讲座", "讲座回顾：诗", "回顾与展望", "论坛落下帷幕", "顺利召开", "供稿：甲 终审：乙", "2025年5月3日，报告会在礼堂顺利举办", "我院师生参加会议", "报告会在礼堂举行，领导开展了交流，师生们都说收获很大，时间过得很快", "无", ""]
    t = F.col("t")
    every = (
        F.when(t.rlike(P.RETRO_STRONG) | t.rlike(P.RETRO), "retro-summary").when(t.rlike(P.TITLE_CONDUCT), "title-conduct").when(t.rlike(P.TITLE_RETRO) & ~t.rlike(P.TITLE_AHEAD), "title-retro")
        .when(t.rlike(P.TITLE_DONE), "title-done").when(t.rlike(P.SIGNATURES), "signature-block").when(t.rlike(f"{P.NARRATIVE_DAY}(?=.{{0,50}}?{P.DONE})"), "narrative-completion").when(t.rlike(P.TITLE_JOINED), "title-participate")
    )
    rows = spark.createDataFrame([(x,) for x in told], "t string").select("t", P.news_rule(t, t, F.lit(None).cast("string")).alias("r"), every.alias("e")).collect()
    assert [r.r for r in rows if r.r != "narrative-process"] == [r.e for r in rows if r.r != "narrative-process"]
    assert all(r.e is None for r in rows if r.r == "narrative-process") and len({r.r for r in rows}) >= 6


def test_sessions_of_one_topic_are_dealt_and_sorted_once(spark):
    from bulletin.operators import sessions

    rows = spark.createDataFrame([(1, 1, "a b", "x", 1), (1, 2, "ab", "x", 3), (1, 3, "ab", "x", 3), (1, 4, None, None, None), (1, 5, "", None, 2), (2, 1, "ab", "x", 0)], "k int, pos int, topic string, start string, rich int")
    found = sessions.dedup_sessions(rows, "k", "topic", "start", "rich", "pos")
    assert sorted((r.k, r.pos, r.slot) for r in found.collect()) == [(1, 2, 1), (1, 5, 4), (2, 1, 1)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1


def test_links_of_a_crawl_are_worked_out_once(spark, tmp_path):
    """A crawl of several rounds made its links anew in each."""
    from bulletin.operators import frontier

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    links = spark.createDataFrame([(f"/{n}", f"/{n + 1}") for n in range(5)] + [("/5", "/0")], "url string, href string").withColumn("href", counted("href"))
    seeds = spark.createDataFrame([("s", "/0")], "source string, url string")
    pages, _ = frontier.crawl(seeds, links, str(tmp_path / "crawl"), guess=False, follow=True)
    assert {(r.url, r.depth) for r in pages.collect()} == {(f"/{n}", n) for n in range(6)}
    assert seen.value <= 12  # the filter for empty ones may read them once more; before 36 and more
