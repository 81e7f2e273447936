"""Operators on small tables: ties, nulls, empty input."""

import datetime

import pytest
from pyspark.sql import functions as F

from bulletin.operators import counters, cube, dedup, links, maintain, resolve, serve, sessions
from bulletin.sources import readers, schema, writers

AT = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def lectures(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))

    def of(rows):
        names = [f.split(" ")[0] for f in schema.LECTURE.split(", ")]
        data = [tuple([i, *(r.get(n) for n in names)]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "ord bigint, " + schema.LECTURE)

    return of


def test_throttle_counts_from_the_last_accepted(spark):
    e = spark.createDataFrame([("a", AT + datetime.timedelta(seconds=s)) for s in (360, 0, 100, 180, 300, 359)] + [("b", None)], "k string, ts timestamp_ntz")
    assert sorted((r.ts - AT).seconds for r in counters.accepted(e, ["k"]).collect()) == [0, 180, 360]
    assert counters.accepted(e.limit(0), ["k"]).collect() == []


def test_likes_are_floored_after_every_event(spark):
    e = spark.createDataFrame([("u", i, d) for i, d in enumerate((1, -1, -1, 1))] + [("v", 0, -1)], "u string, o int, d int")
    assert {r.u: r.likes for r in counters.likes(e, "u", "d", ["o"]).collect()} == {"u": 1, "v": 0}


def test_notice_count_keeps_zero(lectures):
    s = [("u", "c", "p", "t")]
    r = cube.notice_count(lectures([{"sourceCount": 0}, {"sources": s + s}, {}])).first()
    assert (r.lectureCount, r.sourceNoticeCount) == (3, 3)


def test_dedup_keeps_the_fullest_then_the_first(lectures):
    base = {"college": "c", "title": "讲座", "lectureStart": "2025-01-01 10:00:00", "sourceUrl": "https://a/1/"}
    rows = lectures([base, base | {"topic": "t"}, base | {"topic": "u"}, base | {"sourceUrl": "https://a/2"}, base | {"isMultiLecture": True, "lectureIndex": 2}])
    assert sorted(r.ord for r in dedup.dedup(rows).collect()) == [1, 3, 4]


def test_resolve_merges_other_colleges_only(lectures):
    base = {"speaker": "张三教授", "lectureStart": "2025-01-01 10:00:00", "title": "诗歌与远方讲座", "topic": "诗歌与远方"}
    x = base | {"college": "X", "sourceUrl": "1", "location": "hall"}
    y = base | {"college": "Y", "sourceUrl": "2", "organizer": "o"}
    out = {r.ord: r for r in resolve.resolve(lectures([x, y, base | {"college": "X", "sourceUrl": "3"}, {"college": "Z", "sourceUrl": "4"}])).collect()}
    assert set(out) == {0, 2, 3} and out[0].merged and out[0].sourceCount == 2 and [s.college for s in out[0].sources] == ["Y"]
    assert out[0].organizer == "o" and not out[2].merged
    assert len(resolve.resolve(lectures([x, x | {"sourceUrl": "9"}])).collect()) == 2
    assert resolve.resolve(lectures([])).collect() == []


def test_sorting_and_paging(lectures):
    rows = lectures([{"lectureStart": s, "title": t} for s, t in ((None, "a"), ("2024-01-01 10:00:00", "第2讲"), ("2024-01-01 11:00:00", "第1讲"), ("2025-01-01 10:00:00", "b"))])
    assert [r.ord for r in serve.page(rows, 1, serve.newest_first(), 3).collect()] == [3, 2, 1]
    assert [r.ord for r in serve.page(rows, 1, serve.timeline(), 9).collect()] == [3, 1, 2, 0]
    assert [r.ord for r in serve.latest(rows).collect()] == [0, 3, 2, 1] and [r.ord for r in serve.latest(rows, undated_first=False).collect()][-1] == 0
    assert serve.page_window(5, 10) == [1, "…", 3, 4, 5, 6, 7, "…", 10]


def test_facets_match_sources(lectures):
    rows = lectures([{"campus": "A", "sources": [("u", "c", "B", "t")]}, {"campus": "C"}, {"title": "Wave"}])
    assert [r.ord for r in serve.search(rows, campus="B").collect()] == [0]
    assert [r.ord for r in serve.search(rows, query=" wAVE ").collect()] == [2]


def test_next_value_is_at_or_after(spark):
    rows = spark.createDataFrame([(1, 5, "title", "a"), (1, 10, "time", None), (1, 20, "time", None), (1, 30, "title", "b"), (1, 30, "time", None), (1, 40, "time", None)], "p int, pos int, kind string, v string")
    assert sorted((r.pos, r.next_value) for r in sessions.next_value(rows, "p", "pos", "kind", "time", "title", "v").collect()) == [(10, "b"), (20, "b"), (30, "b"), (40, None)]


def test_inherit(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(("A", "", "B", None))], "p int, o int, s string")
    assert [r.s for r in sessions.inherit(rows, "p", "o", "s").orderBy("o").collect()] == ["A", "A", "B", "B"]


def test_links_need_a_parser():
    html = "<a href=/x>学术讲座 <b>一</b></a><script>'<a href=/no>'</script><a href=content.html><a href=/y>讲座</a></a><a href=''>空</a>"
    assert links.links_of(html) == [("/x", "学术讲座一"), ("/y", "讲座")] and links.links_of(None) == []
    assert links.decode("讲座".encode("gb18030")) == "讲座" and links.decode("讲座".encode()) == "讲座"


def test_collect_links(spark):
    page = spark.createDataFrame([(1, "https://a/list/", "https://a", "<a href=/a/1.html>学术讲座</a><a href=/index.html>讲座</a><a href='#'>讲座</a><a href=/list>讲座</a><a href=/q>新闻</a>")], "page_id bigint, url string, base string, html string")
    assert [r.url for r in links.collect(page).collect()] == ["https://a/a/1.html"]


def test_upsert_and_unseen(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "k string, v int, ord int")
    new = spark.createDataFrame([("b", 2, 0), ("b", 3, 1), ("c", 4, 2)], "k string, v int, ord int")
    assert sorted((r.k, r.v) for r in maintain.upsert(old, new, "k").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    found = spark.createDataFrame([("s", "u/"), ("s", "u"), ("t", "u"), ("s", "w")], "source string, url string")
    assert sorted((r.source, r.url) for r in maintain.unseen(found, spark.createDataFrame([("w/",)], "url string")).collect()) == [("s", "u"), ("t", "u")]
    assert maintain.guard(10, 5) and not maintain.guard(10, 4)


def test_documents_round_trip(spark, lectures, tmp_path):
    rows = lectures([{"title": "甲", "notes": ["x"], "sourceCount": 0}, {"title": "乙"}])
    writers.write_document(rows, str(tmp_path / "d"), "now")
    got = readers.read_lectures(spark, str(tmp_path / "d")).orderBy("ord").collect()
    assert [(r.ord, r.title, r.notes, r.sourceCount, r.updatedAt) for r in got] == [(0, "甲", ["x"], 0, "now"), (1, "乙", None, None, "now")]
    (tmp_path / "bare.json").write_text('[{"title": "丙", "notes": "n"}]')
    assert [(r.title, r.notes) for r in readers.read_lectures(spark, str(tmp_path / "bare.json")).collect()] == [("丙", ["n"])]
    assert readers.read_lectures(spark, str(tmp_path / "none.json")).collect() == []


def test_small_readers(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"urls": ["https://a/", "https://b"]}')
    assert sorted(r.url for r in readers.read_excluded(spark, str(tmp_path / "e.json")).collect()) == ["https://a", "https://b"]
    (tmp_path / "v.json").write_text('{"total": 100, "by_day": {"2024-01-01": 70}}')
    total, days = readers.read_visits(spark, str(tmp_path / "v.json"))
    s = cube.visit_summary(days, total).first()
    assert (s.legacy, s.n_days, s.day_sum) == (30, 1, 70)
    assert readers.college_rows([{"name": "n", "list_urls": ["u", {"url": "w", "collect_mode": "all_items"}]}])[0][3] == [("u", "auto"), ("w", "all_items")]
    assert "<td>7</td>" in writers.visits_report(cube.year_month_matrix(spark.createDataFrame([("2024-03-01", 7), ("bad", 1)], "day string, n int")))


def test_notices_split_by_speaker_count_once(spark):
    from bulletin.functions import extract
    from bulletin.operators import sessions

    rows = spark.createDataFrame([("u1", "国家杰青刘梦赤教授长江学者陈建二教授"), ("u2", "李明助理教授")], "sourceUrl string, label string").withColumn("speakers", extract.speakers(F.col("label")))
    got = sessions.by_speaker(rows).orderBy("sourceUrl", "lectureIndex").collect()
    assert [(r.speaker, r.speakerTitle, r.lectureIndex, r.lectureCount, r.sourceCount) for r in got] == [("刘梦赤", "国家杰青", 1, 2, 1), ("陈建二", "长江学者", 2, 2, 0), ("李明", "", 1, 1, 1)]
    assert all(r.isMultiLecture and r.notes == [] and r.speakerAffiliation == "" for r in got)


def test_first_number_of_a_rising_range(spark):
    from bulletin.operators import sessions

    titles = ["学术讲座第12-15期", "第 3 - 5 期", "第5-3期", "12-15期", "第1-2讲", None]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.n for r in rows.select(sessions.first_number(F.col("t")).alias("n")).collect()] == [12, 3, 1, 1, 1, 1]
