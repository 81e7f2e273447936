"""Examples of the functions of dates, names and reports, beside the queries over whole tables."""

import pytest
from pyspark.sql import functions as F

from bulletin.functions import dates as D, predicates as P, text as T

TITLES = [("学术 报告通知 2026-06-25", "学术报告通知"), ("讲座2026-06-25（石牌）", "讲座"), ("讲座（石牌）2026-06-25", "讲座（石牌）"), ("a b(c)", "ab")]
SPEAKERS = [("李四教授", "李四"), ("张三副教授", "张三副"), ("教授", "教授"), (" 王五 讲师", "王五")]
URL_DATES = [("https://x.test/a/20251201/x.html", "2025-12-01"), ("https://x.test/a/2025/0507/x.html", "2025-05-07"), ("https://x.test/x/2025/1028/x.html", "2025-10-28"), ("https://x.test/a/20251301/x.html", None), ("https://x.test/q/2025/1/8/x.htm", "2025-01-08")]
NEXT_PAGES = [("/xs/2.html", "/xs/3.html"), ("/xs/", "/xs/2.html"), ("/xs/index.html", None)]
YEARS = [("2025-07-02 15:00:00", None, "x", "2025"), (None, "2024-01-05", "x", "2024"), (None, None, "研讨2023年", "2023"), (None, None, "研讨", "其他")]
LATE = [("2025-05-31 00:00:00", "2025-05-31 20:00:00", False), ("2025-05-31 15:00:00", "2025-05-31 20:00:00", True), ("2025-05-31 15:00:00", "2025-06-02", False), (None, "2025-06-02 00:00:00", False)]
NAMES = [("张三", True), ("12 ,", False), ("通知", False), ("王", False)]
NEWS = [("我院举办学术讲座", "", "title-conduct"), ("关于举办学术讲座的通知", "", None), ("讲座回顾：诗歌", "", "title-retro"), ("回顾与展望", "", None), ("论坛圆满落幕", "", "title-done"), ("x", "初审：甲 复审：乙 终审：丙", "signature-block"), ("x", "讲座圆满结束。", "retro-summary"), ("我院师生参加会议", "", "title-participate"), ("x", "2025年5月3日，报告会在礼堂顺利举办", "narrative-completion")]
SEGMENTS = [("2025年6月3日 下午3点半", "2025-06-03 15:30:00", None), ("时间：2025-06-03 14:30-16:00", "2025-06-03 14:30:00", "2025-06-03 16:00:00"), ("6月3日 上午9：00", "2024-06-03 09:00:00", None), ("06/10", "2024-06-10 00:00:00", None), ("2025年2月30日", None, None), ("2025年6月3日 25:00", "2025-06-03 00:00:00", None), ("none", None, None)]

def none():
    return F.lit(None).cast("string")


def seg(*names):
    return lambda s: [D.segment_time(s, F.lit(2024), F.lit(None).cast("date"))[n].cast("string") for n in names]


@pytest.mark.parametrize(
    ("examples", "n", "f"),
    [
        (TITLES, 1, lambda a: [T.normalize_title(a)]),
        (SPEAKERS, 1, lambda a: [T.normalize_speaker(a)]),
        (URL_DATES, 1, lambda a: [D.date_in_url(a).cast("string")]),
        (NEXT_PAGES, 1, lambda a: [D.next_page(a)]),
        (YEARS, 3, lambda a, b, c: [D.year_of(a, b, c)]),
        (LATE, 2, lambda a, b: [P.is_late(a, b, none())]),
        (NAMES, 1, lambda a: [P.is_speaker(a)]),
        (NEWS, 2, lambda a, b: [P.news_rule(a, b, none())]),
        (SEGMENTS, 1, seg("start", "end")),
    ],
    ids="titles speakers url_dates next_pages years late names news segments".split(),
)
def test_examples(spark, examples, n, f):
    rows = spark.createDataFrame([(k, *r[:n]) for k, r in enumerate(examples)], "k int, " + ", ".join(f"x{i} string" for i in range(n)))
    got = rows.select("k", *(c.alias(f"y{i}") for i, c in enumerate(f(*(F.col(f"x{i}") for i in range(n)))))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [r[n:] for r in examples]
