"""Queries of pages and their fields, with SQL. Texts of pages are made of the tables' values by one
expression for Spark and SQL, as the tables hold no Chinese text; SQL works the answers out
from what was put in."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import dates as D, extract as X, labels, predicates as P, text as T
from .operators import frontier, pages, split
from .registry import _BARE_D, _BARE_M, _DATE, _DAY, _Y, _has_any, query, table
from .session import ready_to_checkpoint

# ------------------------------------------------------------------------- sessions

_NEXT = f"CAST({_DATE} + INTERVAL 1 DAY AS DATE)"
_NEXT_DAY = f"CAST({_NEXT} AS STRING)"
_NY, _NM, _ND = (f"substring({_NEXT_DAY}, {at}, {n})" for at, n in ((1, 4), (6, 2), (9, 2)))
_FIRST = f"concat({_Y}, '年', {_BARE_M}, '月', {_BARE_D}, '日')"
_SECOND = f"concat({_NY}, '年', CAST(CAST({_NM} AS INT) AS STRING), '月', CAST(CAST({_ND} AS INT) AS STRING), '日')"
_T1, _T2 = "concat('论', CAST(o_custkey AS STRING))", "concat('谈', o_orderpriority)"
#: Seven kinds of pages: five ways to announce two sessions, one topic at two times, two topics at one time.
SESSIONS = f"""CASE o_orderkey % 7
  WHEN 0 THEN concat('时间:', {_FIRST}, ' 地点:石牌校区 报告一 时间:9:00-9:50 题目:', {_T1}, ' 报告人:张三丰教授 摘要:本次报告介绍之 报告二 时间:10:00-10:40 题目:', {_T2}, ' 摘要:y')
  WHEN 1 THEN concat('题目:', {_T1}, ' 时间:', {_FIRST}, ' 14:30-16:00 主讲人:张三丰教授 主持人:李四光 题目:', {_T2}, ' 时间:', {_SECOND}, ' 下午2:05 会议号:562 395 609 腾讯会议')
  WHEN 2 THEN concat('时间:', {_FIRST}, '9:00-12:00 报告时间:9:20-10:00 报告题目:', {_T1}, ' 报告摘要:A 报告人:古天龙,暨南大学 报告时间:10:00-10:40 报告题目:', {_T2}, ' 报告摘要:B 报告人:王小明教授')
  WHEN 3 THEN concat('题目1:甲 题目2:乙 时间:', {_FIRST}, ' 14:30 题目1:', {_T1}, ' 报告人1:於志文 题目2:', {_T2}, ' 报告人2:李小明')
  WHEN 4 THEN concat('第7讲:', {_T1}, ' 时间:', {_FIRST}, ' 14:30 第8讲:', {_T2}, ' 时间:', {_SECOND}, ' 15:30-17:00')
  WHEN 5 THEN concat('题目:', {_T1}, ' 时间:', {_FIRST}, ' 14:30 题目:', {_T1}, ' 时间:', {_SECOND}, ' 14:30')
  ELSE concat('题目:', {_T1}, ' 时间:', {_FIRST}, ' 14:30 题目:', {_T2}, ' 时间:', {_FIRST}, ' 14:30') END"""
SESSIONS_TITLE = "CASE WHEN o_custkey % 2 = 0 THEN '讲座第3-5期' ELSE '讲座' END"
SESSIONS_SPEAKER = "CASE WHEN o_custkey % 3 = 0 THEN '基底人' END"
_SESSIONS_SQL = f"""p AS (
  SELECT o_orderkey, o_orderkey % 7 AS form, CAST({_DATE} AS VARCHAR) AS a, CAST({_NEXT} AS VARCHAR) AS b, {_T1} AS t1, {_T2} AS t2, {SESSIONS_TITLE} AS title, {SESSIONS_SPEAKER} AS base
  FROM orders WHERE o_orderkey % 7 < 5 AND o_orderkey % 11 <> 0),
s AS (
  SELECT *, k, concat(CASE k WHEN 1 THEN t1 ELSE t2 END, CASE WHEN form = 4 THEN ' 时间' ELSE '' END) AS topic, CASE WHEN title = '讲座' THEN k ELSE k + 2 END AS no,
    concat(CASE WHEN form IN (1, 4) AND k = 2 THEN b ELSE a END, ' ', list_extract(CASE form WHEN 0 THEN ['09:00:00', '10:00:00'] WHEN 1 THEN ['14:30:00', '14:05:00'] WHEN 2 THEN ['09:20:00', '10:00:00'] WHEN 3 THEN ['14:30:00', '14:30:00'] ELSE ['14:30:00', '15:30:00'] END, k)) AS starts,
    list_extract(CASE form WHEN 0 THEN ['09:50:00', '10:40:00'] WHEN 1 THEN ['16:00:00', NULL] WHEN 2 THEN ['10:00:00', '10:40:00'] WHEN 3 THEN [NULL, NULL] ELSE [NULL, '17:00:00'] END, k) AS until,
    list_extract(['reports', 'topics', 'fields', 'numbered', 'series'], CAST(form AS INTEGER) + 1) AS way
  FROM p, (VALUES (1), (2)) AS x(k))"""


def _session_pages(spark, sf_dir):
    """A page an order; every eleventh is a list with two links to lectures."""
    none = F.lit(None)
    made = [F.expr(SESSIONS).alias("text"), F.expr(SESSIONS_TITLE).alias("title"), F.expr(SESSIONS_SPEAKER).alias("speaker")]
    years = [none.cast("string").alias("published"), F.lit(2024).alias("default_year"), none.cast("int").alias("title_year"), none.cast("int").alias("url_year")]
    return table(spark, sf_dir, "orders").select("o_orderkey", *made, *years, F.when(F.col("o_orderkey") % 11 == 0, 2).alias("anchors"))


@query(f"""WITH {_SESSIONS_SQL} SELECT o_orderkey, no, topic, starts AS s, concat(substring(starts, 1, 11), until) AS e, way FROM s WHERE until IS NOT NULL
UNION ALL SELECT o_orderkey, no, topic, starts, NULL, way FROM s WHERE until IS NULL""")
def split_sessions(spark, sf_dir):
    """Pages of seven kinds, one an order."""
    found = split.detect(_session_pages(spark, sf_dir), "o_orderkey", anchors=F.col("anchors"))
    return found.select("o_orderkey", "no", "topic", F.col("start").cast("string").alias("s"), F.col("end").cast("string").alias("e"), "way")


@query(f"""WITH {_SESSIONS_SQL},
r AS (SELECT *, CASE form WHEN 0 THEN ['张三丰', '张三丰'] WHEN 1 THEN ['张三丰', '张三丰'] WHEN 2 THEN ['古天龙', '王小明'] WHEN 3 THEN ['於志文', '李小明'] ELSE [base, base] END AS who FROM s)
SELECT o_orderkey, no AS "lectureIndex", concat(title, '— ', topic) AS title, list_extract(who, k) AS speaker, CASE WHEN form IN (0, 1) OR form = 2 AND k = 2 THEN '教授' END AS post, CASE WHEN form = 2 AND k = 1 THEN '暨南大学' END AS unit,
  CASE WHEN list_extract(who, k) IS NULL THEN NULL WHEN form IN (0, 1) AND k = 2 OR form = 4 THEN 'inherited' ELSE 'block' END AS source, CASE WHEN form = 1 AND k = 1 THEN '李四光' END AS host,
  CASE WHEN form = 1 AND k = 2 THEN '562395609' END AS meeting, CASE WHEN form = 1 AND k = 2 THEN '腾讯会议' END AS platform,
  CASE WHEN form = 0 AND k = 1 THEN '本次报告介绍之' WHEN form = 2 AND k = 1 THEN 'A 报告人:古天龙,暨南大学' WHEN form = 2 THEN 'B 报告人:王小明教授' END AS abstract, CASE WHEN form = 0 THEN '石牌校区' END AS place, CASE WHEN k = 1 THEN 1 ELSE 0 END AS notices
FROM r WHERE NOT (starts < '2024-06-01')""")
def session_records(spark, sf_dir):
    """A record a session; those held before a day of publishing go."""
    pages = _session_pages(spark, sf_dir)
    rows = split.records(pages.select("o_orderkey", "text", "title", "speaker", F.lit("2024-05-31").alias("publishTime"), F.lit("label").alias("publishTimeSource")), split.detect(pages, "o_orderkey", anchors=F.col("anchors")), "o_orderkey")
    kept = split.keep_ahead(rows.withColumn("publishTime", F.lit("2024-05-31 23:59:59")))
    return kept.select("o_orderkey", "lectureIndex", "title", "speaker", F.col("speakerTitle").alias("post"), F.col("speakerAffiliation").alias("unit"), F.col("speakerSource").alias("source"), "host", F.col("meetingId").alias("meeting"), F.col("meetingPlatform").alias("platform"), "abstract", F.col("location").alias("place"), F.col("sourceCount").alias("notices"))


# ------------------------------------------------------------------------- labelled fields

LABELLED = f"""concat('通知 ', CASE o_orderkey % 4 WHEN 0 THEN concat('讲座题目： ', {_T1}) WHEN 1 THEN concat('主题:', {_T1}, ' 题目：再来') WHEN 2 THEN '报告题目：' ELSE 'Topic: x' END, ' ',
  CASE o_orderkey % 5 WHEN 0 THEN '课程地点：石牌校区' WHEN 1 THEN concat('地点:', o_orderpriority, ' 点击：5') WHEN 2 THEN concat('地点：A', chr(10), 'B【校】') WHEN 3 THEN '没有' ELSE '地点：理6栋 2025-05' END,
  CASE o_orderkey % 3 WHEN 0 THEN ' 主讲《书名》：不是 报告人：李四' WHEN 1 THEN concat(' 主讲人简介：某人 主讲嘉宾:', CAST(o_custkey AS STRING), '来源') ELSE ' 演讲人 没有冒号' END, ' 邀请人：', CAST(o_orderkey AS STRING), ' 发布')"""


@query(f"""WITH t AS (SELECT *, CASE WHEN o_orderkey % 5 = 3 THEN ' 没有' ELSE '' END AS tail FROM orders)
SELECT o_orderkey, nullif(trim(CASE o_orderkey % 4 WHEN 0 THEN concat({_T1}, tail) WHEN 1 THEN {_T1} WHEN 2 THEN tail ELSE concat('x', tail) END), '') AS topic,
  CASE o_orderkey % 5 WHEN 0 THEN '石牌校区' WHEN 1 THEN o_orderpriority WHEN 2 THEN 'A B' WHEN 4 THEN '理6栋' END AS place, CASE o_orderkey % 3 WHEN 0 THEN '李四' WHEN 1 THEN CAST(o_custkey AS VARCHAR) END AS speaker, CAST(o_orderkey AS VARCHAR) AS inviter FROM t""")
def label_fields(spark, sf_dir):
    """Four fields of one scan: labels within labels, without colons, before book titles, with nothing
    behind them, and all that ends a value; one text an order."""
    found = table(spark, sf_dir, "orders").select("o_orderkey", labels.scan(labels.flatten(F.expr(LABELLED))).alias("f"))
    of = lambda names: labels.field(F.col("f"), names)
    return found.select("o_orderkey", of(labels.TOPIC).alias("topic"), of(labels.PLACE).alias("place"), of(labels.SPEAKER).alias("speaker"), of(labels.INVITER).alias("inviter"))


# ------------------------------------------------------------------------- whole pages

_C = "CAST(c_custkey AS STRING)"
PAGE_BODY = f"""CASE c_custkey % 5
  WHEN 0 THEN concat('<p>讲座题目：论', {_C}, '</p><p>时间：2025年3月11日 14:30-16:00</p><p>地点：理', {_C}, '栋 302 腾讯会议 123</p><p>报告人：张三丰 教授（北京大学）<p>邀请人：李四光</p><p>摘要：本次报告介绍之', {_C}, '。</p>')
  WHEN 1 THEN concat('<p>Topic: on ', {_C}, '</p><p>Speaker: Yan Zhang, University of Oslo</p><b>时间：</b>2025年3月12日 9:05<br><p>Venue: 石牌校区</p>')
  WHEN 2 THEN concat('<p>报告人：国家杰青刘梦赤教授长江学者陈建二教授</p><p>时间：2025年3月13日 下午3:00</p><p>题目：谈', {_C}, '</p><!-- 题目：错 -->')
  WHEN 3 THEN '<p>讲座圆满结束。</p>'
  ELSE concat('<p>报告一 时间：2025年3月14日 9:00-9:50 题目：甲', {_C}, ' 报告人：王小明教授</p><p>报告二 时间：2025年3月14日 10:00-10:40 题目：乙', {_C}, '</p>') END"""
PAGE_TITLE = f"concat('学术讲座：第', {_C}, '号研究')"
PAGE = f"""concat('<html><head><title>站点</title><script>var a = "</p>题目：错误";</script></head><body><div class="nav"><a href="/l">更多讲座与报告信息</a></div>',
  CASE WHEN c_custkey % 2 = 0 THEN concat('<h1>通知公告</h1><h3>', {PAGE_TITLE}, '</h3>') ELSE concat('<h1>', {PAGE_TITLE}, '</h1>') END, '<div class="box wp_articlecontent">', {PAGE_BODY}, '</div></body></html>')"""


@query(f"""WITH p AS (SELECT c_custkey, c_custkey % 5 AS form, {_C} AS c, {PAGE_TITLE} AS title FROM customer WHERE c_custkey % 5 <> 3),
r AS (SELECT *, k FROM p, (VALUES (1), (2)) AS x(k) WHERE k = 1 OR form IN (2, 4))
SELECT c_custkey, CASE WHEN form IN (2, 4) THEN k END AS no, concat(title, CASE WHEN form = 4 THEN concat('— ', CASE k WHEN 1 THEN '甲' ELSE '乙' END, c) ELSE '' END) AS title,
  CASE form WHEN 0 THEN concat('论', c) WHEN 1 THEN concat('on ', c) WHEN 2 THEN concat('谈', c) ELSE concat(CASE k WHEN 1 THEN '甲' ELSE '乙' END, c) END AS topic,
  CASE form WHEN 0 THEN '2025-03-11 14:30:00' WHEN 1 THEN '2025-03-12 09:05:00' WHEN 2 THEN '2025-03-13 15:00:00' ELSE CASE k WHEN 1 THEN '2025-03-14 09:00:00' ELSE '2025-03-14 10:00:00' END END AS s,
  CASE form WHEN 0 THEN '2025-03-11 16:00:00' WHEN 4 THEN CASE k WHEN 1 THEN '2025-03-14 09:50:00' ELSE '2025-03-14 10:40:00' END END AS e,
  CASE form WHEN 0 THEN concat('理', c, '栋302') WHEN 1 THEN '石牌校区' ELSE '' END AS place, CASE form WHEN 0 THEN '张三丰' WHEN 1 THEN 'Yan Zhang' WHEN 2 THEN CASE k WHEN 1 THEN '刘梦赤' ELSE '陈建二' END ELSE '王小明' END AS speaker,
  CASE form WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN CASE k WHEN 1 THEN '国家杰青' ELSE '长江学者' END ELSE '教授' END AS post, CASE form WHEN 0 THEN '北京大学' WHEN 1 THEN 'University of Oslo' ELSE '' END AS unit, CASE WHEN form = 0 THEN '李四光' ELSE '' END AS inviter,
  CASE form WHEN 0 THEN concat('本次报告介绍之', c, '。') WHEN 1 THEN concat('Topic: on ', c, ' Speaker: Yan Zhang, University of Oslo') ELSE '' END AS abstract FROM r""")
def notice_records(spark, sf_dir):
    """Records of pages of five kinds, one page a customer: labelled, Latin, a run of
    speakers, a report (dropped), two sessions; with scripts, comments and unclosed elements."""
    made = table(spark, sf_dir, "customer").select("c_custkey", F.lit("https://x.test/n.html").alias("url"), F.expr(PAGE).alias("html"))
    rows = pages.page_records(made, "c_custkey")
    return rows.select("c_custkey", F.col("lectureIndex").alias("no"), "title", "topic", F.col("lectureStart").alias("s"), F.col("lectureEnd").alias("e"), F.col("location").alias("place"), "speaker", F.col("speakerTitle").alias("post"), F.col("speakerAffiliation").alias("unit"), "inviter", "abstract")


@query()
def page_records(spark, sf_dir):
    """P6 over every page: HTML as it comes, with decoys in scripts, comments and advertisements."""
    return pages.page_records(table(spark, sf_dir, "pages"))


# ------------------------------------------------------------------------- following pages


@query("""WITH RECURSIVE r(n, d) AS (SELECT s_suppkey, 0 FROM supplier UNION SELECT DISTINCT l_partkey, d + 1 FROM r JOIN lineitem ON l_orderkey = n WHERE d < 24)
SELECT concat('/p/', CAST(n AS VARCHAR)) AS url, CAST(min(d) AS INTEGER) AS depth FROM r GROUP BY n""")
def crawl_reach(spark, sf_dir):
    """Pages reached from the suppliers' numbers, an order being a page that links to its parts' numbers;
    the graph has cycles."""
    at = lambda c: F.concat(F.lit("/p/"), F.col(c).cast("string"))
    seeds = table(spark, sf_dir, "supplier").select(F.lit("s").alias("source"), at("s_suppkey").alias("url"))
    links = table(spark, sf_dir, "lineitem").select(at("l_orderkey").alias("url"), at("l_partkey").alias("href")).distinct()
    ready_to_checkpoint(spark)
    visited, _ = frontier.crawl(seeds, links, f"{spark.sparkContext.getCheckpointDir()}/crawl-{uuid.uuid4().hex}", guess=False, follow=True)
    return visited.select("url", "depth")


# ------------------------------------------------------------------------- kinds of titles, fields of the display

KIND_TITLE = """CASE doc_id % 9 WHEN 0 THEN '学术讲座预告' WHEN 1 THEN '讲座回顾' WHEN 2 THEN '关于举办教师培训的通知' WHEN 3 THEN '征文启事' WHEN 4 THEN '首页' WHEN 5 THEN '学术沙龙第三期' WHEN 6 THEN '关于组织讲座推荐的公告'
  WHEN 7 THEN 'Home of the seminar' ELSE concat('研讨会 ', source) END"""
KIND_BODY = "concat(CASE doc_id % 4 WHEN 0 THEN '请各学院、各单位参加' WHEN 1 THEN '主讲人：张三 请务必参加培训' WHEN 2 THEN '请务必参加培训' ELSE '' END, coalesce(text, ''))"
KIND_URL = "concat('https://x.test', CASE doc_id % 5 WHEN 0 THEN '/a/20250102/7.html' WHEN 1 THEN '/2025/0102/7.html' WHEN 2 THEN '/2025/01/02/seven.html' WHEN 3 THEN '/list.html' ELSE '/a/2025/7.html' END)"


@query(rf"""WITH t AS (SELECT doc_id, coalesce({KIND_TITLE}, '') AS t, {KIND_BODY} AS b, {KIND_URL} AS u FROM documents)
SELECT doc_id, {_has_any('t', P.LECTURE)} AND NOT {_has_any('t', P.NO_LECTURE)} AS lecture,
  NOT {_has_any('lower(t)', P.NAVIGATION)} AND NOT {_has_any('t', P.NO_ITEM)} AND length(t) >= 4 AND regexp_matches(u, '/((a/[0-9]{{8}}/[0-9]+\.html)|([0-9]{{4}}/[0-9]{{4}}/[0-9]+\.html)|([0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}/.*\.html))') AS item,
  {_has_any('t', P.OTHER_TITLE)} AS other,
  regexp_matches(t, '{P.ADMIN_FRAME}') AND {_has_any('t', P.ADMIN_TITLE)} AND NOT regexp_matches(b, '主讲[人师][:：]\s*[一-龥]{{2,4}}') AND ({' OR '.join(f"contains(b, '{w}')" for w in P.ADMIN_BODY)} OR {_has_any('t', P.ADMIN_STRONG)}) AS admin FROM t""")
def title_kinds(spark, sf_dir):
    """F1-F4 over the whole text of every document, with titles and addresses of nine kinds."""
    t, b, u = F.expr(KIND_TITLE), F.expr(KIND_BODY), F.expr(KIND_URL)
    return table(spark, sf_dir, "documents").select("doc_id", P.is_lecture(t).alias("lecture"), P.is_list_item(t, u).alias("item"), P.is_other_title(t).alias("other"), P.is_admin_notice(t, b).alias("admin"))


SHOWN_URL = "concat(CASE o_orderkey % 5 WHEN 0 THEN 'HTTPS://x/' WHEN 1 THEN ' http://y/' WHEN 2 THEN 'javascript:' WHEN 3 THEN 'ftp://z/' ELSE '' END, CAST(o_orderkey AS STRING))"
SHOWN_START = f"CASE o_orderkey % 4 WHEN 0 THEN concat({_DAY}, ' 15:30:00') WHEN 1 THEN {_DAY} WHEN 2 THEN NULL ELSE concat({_DAY}, ' 09:05:00') END"
SHOWN_TITLE = "concat('讲座', CASE o_orderkey % 3 WHEN 0 THEN concat('第', CAST(o_orderkey % 4 AS STRING), '场') WHEN 1 THEN '第1期' ELSE '' END)"
SHOWN_BIO = "concat('主讲 人简介', o_orderpriority, '教授 很好')"
SHOWN_ABSTRACT = "CASE o_orderkey % 6 WHEN 0 THEN concat(o_orderpriority, '教授很好') WHEN 1 THEN '主讲人简介：某某' WHEN 2 THEN '资讯及通知 列表' WHEN 3 THEN NULL ELSE concat(' 摘要', o_orderpriority, CAST(o_orderkey AS STRING)) END"
_STARTED_AT = "CASE WHEN length(st) = 19 THEN CAST(st AS TIMESTAMP) END"
_WEEKDAY = "list_extract(['日', '一', '二', '三', '四', '五', '六'], CAST(dayofweek(CAST(st AS TIMESTAMP)) AS INTEGER) + 1)"


@query(f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS p, trim({SHOWN_URL}) AS u, {SHOWN_START} AS st, {SHOWN_TITLE} AS t, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey % 4 AS INTEGER) END AS i, trim(coalesce({SHOWN_ABSTRACT}, '')) AS a, replace({SHOWN_BIO}, ' ', '') AS bio FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE '#' END AS url, CASE WHEN length(p) <= 6 THEN p ELSE concat(substring(p, 1, 5), '…') END AS short, concat_ws('；', CASE WHEN p <> '5-LOW' THEN p END, '公开') AS notes,
  CASE WHEN i IS NOT NULL AND NOT contains(t, concat('第', CAST(i AS VARCHAR), '场')) AND NOT contains(t, concat('第', CAST(i AS VARCHAR), '期')) THEN concat(t, '（第', CAST(i AS VARCHAR), '期）') ELSE t END AS title,
  CASE WHEN starts_with(a, '主讲人简介') OR contains(bio, replace(a, ' ', '')) OR contains(a, '资讯及通知') THEN '' WHEN length(a) <= 9 THEN a ELSE concat(substring(a, 1, 8), '…') END AS abstract,
  CASE WHEN {_STARTED_AT} IS NULL THEN '时间待定' WHEN {_STARTED_AT} < TIMESTAMP '2024-06-15 12:00:00' THEN '已结束' ELSE '即将开始' END AS state, coalesce({_STARTED_AT} BETWEEN TIMESTAMP '2024-06-15 12:00:00' AND TIMESTAMP '2024-06-22 12:00:00', false) AS hot,
  CASE WHEN st IS NULL THEN '时间待定' ELSE concat(substring(st, 1, 10), ' 周', {_WEEKDAY}) END AS day,
  CASE WHEN st IS NULL THEN '待定' ELSE concat(CAST(month(CAST(st AS TIMESTAMP)) AS VARCHAR), '月', CAST(day(CAST(st AS TIMESTAMP)) AS VARCHAR), '日 周', {_WEEKDAY}, ' ', strftime(CAST(st AS TIMESTAMP), '%H:%M')) END AS clock FROM t""")
def display_fields(spark, sf_dir):
    """What a page shows of a notice, one an order."""
    e = F.expr
    shown = D.status(e(SHOWN_START), F.lit("2024-06-15 12:00:00").cast("timestamp_ntz"))
    notes = F.array(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), F.lit("内部 x"), F.lit("公开"))
    index = e("CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey % 4 AS INT) END")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.safe_url(e(SHOWN_URL)).alias("url"), T.truncate(F.col("o_orderpriority"), 6).alias("short"), T.notes_text(notes).alias("notes"), T.episode_title(e(SHOWN_TITLE), index).alias("title"), T.abstract_of(e(SHOWN_ABSTRACT), e(SHOWN_BIO), 9).alias("abstract"),
        shown["label"].alias("state"), shown["hot"].alias("hot"), D.day_key(e(SHOWN_START)).alias("day"), D.short_time(e(SHOWN_START)).alias("clock"),
    )


# ------------------------------------------------------------------------- forms of texts

_K, _P = "CAST(o_orderkey AS STRING)", "o_orderpriority"
FORMS = {
    "half": f"concat('题 目：甲（', {_K}, '）／【', {_P}, '】')",
    "closed": f"concat('【地点】石', {_K}, ' 主 讲 人 : ', {_P})",
    "both": f"concat('时间/Time: ', {_K})",
    "foot": f"concat(repeat('甲', 20), {_K}, ' 版权所有 x')",
    "title": f"concat('【讲座通知】', {_P}, '论坛） - 学院')",
    "unit": "concat('教授，现为', CASE o_orderkey % 2 WHEN 0 THEN '暨南大学计算机学院' ELSE '北京大学' END, '教授')",
    "latin": "concat('Yan Zhang, University of ', CASE o_orderkey % 2 WHEN 0 THEN 'Oslo' ELSE 'Rome' END, ' 报告')",
    "run": "concat('国家杰青刘梦赤教授', CASE o_orderkey % 3 WHEN 0 THEN '长江学者陈建二教授' ELSE '' END)",
    "place": f"concat('南教', {_K}, '室14: 30-17: 00')",
    "dated": f"CASE o_orderkey % 4 WHEN 0 THEN concat('报告 ', {_Y}, ' 年 ', {_BARE_M}, '月', {_BARE_D}, '日') WHEN 1 THEN concat('报告', replace({_DAY}, '-', ''), '号') WHEN 2 THEN concat('报告', {_DAY}) ELSE concat('报告', {_Y}, '年') END",
    "told": "CASE o_orderkey % 4 WHEN 0 THEN '阅读 发布时间：2024-01-02 10:00 其他 2024-05-05' WHEN 1 THEN '来源：本站 2024-01-03 11:30' WHEN 2 THEN '见 2024-01-04' ELSE '无' END",
}


@query(f"""SELECT o_orderkey, concat('题目:甲(', {_K}, ')/[', {_P}, ']') AS half, concat('地点：石', {_K}, ' 主讲人: ', {_P}) AS closed, concat('时间：Time： ', {_K}) AS both, concat(repeat('甲', 20), {_K}) AS foot, concat({_P}, '论坛') AS title,
  CASE o_orderkey % 2 WHEN 0 THEN '暨南大学计算机学院' ELSE '北京大学' END AS unit, concat('Yan Zhang/University of ', CASE o_orderkey % 2 WHEN 0 THEN 'Oslo' ELSE 'Rome' END) AS latin, CASE o_orderkey % 3 WHEN 0 THEN '国家杰青刘梦赤教授,长江学者陈建二教授' ELSE '国家杰青刘梦赤教授' END AS run,
  concat('南教', {_K}, '室') AS place, CASE WHEN o_orderkey % 4 < 3 THEN {_DAY} END AS dated, CASE WHEN o_orderkey % 4 IN (1, 2) THEN CAST(substring({_DAY}, 1, 4) AS INTEGER) END AS year,
  CASE o_orderkey % 4 WHEN 0 THEN '1 2024-01-02 10:00' WHEN 1 THEN '2 2024-01-03 11:30' WHEN 2 THEN '3 2024-01-04' ELSE '0' END AS told FROM orders""")
def text_forms(spark, sf_dir):
    """Texts as pages write them, one of each form an order."""
    f = {k: F.expr(v) for k, v in FORMS.items()}
    said = lambda x: F.concat(x["honour"], x["speaker"], x["title"])
    latin = D.let(X.latin_speaker(f["latin"]), lambda x: F.concat_ws("/", x["name"], x["affiliation"]))
    told = D.let(D.publish_time(f["told"], F.lit("")), lambda x: F.concat_ws(" ", x["level"].cast("string"), x["time"]))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.half_width(f["half"]).alias("half"), T.label_text(f["closed"]).alias("closed"), T.split_bilingual(f["both"]).alias("both"), T.strip_footer(f["foot"]).alias("foot"), T.clean_title(f["title"]).alias("title"), X.affiliation(f["unit"]).alias("unit"), latin.alias("latin"),
        F.array_join(F.transform(X.speakers(f["run"]), said), ",").alias("run"), D.split_location(f["place"]).alias("place"), D.date_in_title(f["dated"]).cast("string").alias("dated"), D.year_in(f["dated"]).alias("year"), told.alias("told"),
    )


CHECKED = f"concat({_DAY}, ' 15:00:00')", f"CASE o_orderkey % 2 WHEN 0 THEN concat({_DAY}, ' 14:00:00') WHEN 1 THEN concat({_DAY}, ' 16:00:00') END", f"CASE o_orderkey % 3 WHEN 0 THEN CAST({_DATE} + INTERVAL 40 DAY AS DATE) WHEN 1 THEN {_DATE} END", f"CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST({_DATE} + INTERVAL 1 DAY AS DATE) AS STRING) WHEN 1 THEN {_DAY} END"


@query(f"""WITH t AS (SELECT o_orderkey AS k, {CHECKED[0]} AS s, {CHECKED[1]} AS e FROM orders)
SELECT k AS o_orderkey, least(s, e) AS s, greatest(s, e) AS e, concat_ws(';', CASE WHEN k % 3 = 0 THEN 'cv-url-date-mismatch' END, CASE WHEN k % 5 = 0 THEN 'cv-publish-after-lecture' END, CASE WHEN k % 2 = 0 THEN 'cv-end-before-start-swapped' END) AS flags,
  CASE WHEN k % 5 = 1 AND k % 4 > 0 THEN NULL WHEN k % 5 = 0 OR k % 5 = 1 THEN 'told' END AS told FROM t""")
def checked_times(spark, sf_dir):
    """Ends before starts, days of addresses and of publishing that don't fit, one an order."""
    s, e, url, told = (F.expr(x) for x in CHECKED)
    found = D.cross_validate(s, e, url, told)
    kept = D.void_publish(F.struct(told.alias("time"), F.expr("CAST(o_orderkey % 4 + 1 AS INT)").alias("level")), s)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["start"].alias("s"), found["end"].alias("e"), F.array_join(found["flags"], ";").alias("flags"), F.when(kept.isNotNull(), "told").alias("told"))
