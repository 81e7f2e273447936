"""When a lecture takes place, from labels in a page's text, else from the text as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .dates import cross_year, day, let, resolve_year, segment_time, year_in
from .text import SPACE, strip

# Labels of times; those that stand for the lecture's own time; of others those that may
# stand for a deadline; what before a label, and in a value, says that it isn't the lecture's.
LABEL = rf"讲座时间|报告时间|学术报告时间|开讲时间|开课时间|会议时间|seminar{SPACE}*时间|seminar{SPACE}*time{SPACE}*:?|time{SPACE}*:?|时间|时闻"
STRONG = "(?i)^(讲座时间|报告时间|学术报告时间|seminartime:?|time.*)$"
MAY_BE_DEADLINE = ("开讲时间", "开课时间", "会议时间")
OTHER_TIME = "报名|截止|直播|提交|签到|用餐|返程|发布|更新|修改|审核|创建"
DEADLINE = "(?i)截止|deadline|提交"
LABEL_ANYWHERE = "时间|时闻|讲座时间|讲座时闻|报告时间|学术报告时间|开讲时间|开课时间|会议时间"
# Words of reports and of announcements.
TOLD_AFTER = ("成功", "已举办", "已举行", "圆满", "回顾", "报道", "纪实", "日前")
TOLD_BEFORE = ("将", "拟", "定于", "将于", "预告", "即将", "本周", "下周")


def label_times(body: Column) -> Column:
    """Array of struct(tier, label, value, seg) of labelled dates in their order: tier 1 for
    labels of lectures, 2 for others. A label within four letters of a word for another time is
    passed over together with its value; a value's month and day are of the year 2000."""
    other = rf"(?<=(?:{OTHER_TIME})[\s\S]{{0,4}})|(?<=regist)(?=time)"
    # the first letters of labels come first, so what stands before is looked at only where one may begin
    pattern = F.lit(rf"(?i)(?=[讲报学开会课时st])(?:(?:{other})(?:{LABEL})|({LABEL})){SPACE}*[：:]?{SPACE}*(.{{0,50}})")
    text = F.coalesce(body, F.lit(""))
    bare = lambda label: F.regexp_replace(label, SPACE, "")
    hit = lambda label, value: F.struct(F.when(bare(label).rlike(STRONG), 1).otherwise(2).alias("tier"), label.alias("label"), strip(value).alias("value"))
    found = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), hit)
    own = F.filter(found, lambda h: (h["label"] != "") & ~(h["label"].isin(*MAY_BE_DEADLINE) & h["value"].rlike(DEADLINE)))
    dated = F.transform(own, lambda h: h.withField("seg", segment_time(h["value"], F.lit(2000), F.lit(None).cast("date"))))
    return F.filter(dated, lambda h: h["seg"].isNotNull())


def lecture_time(body: Column, title: Column, url_year: Column, title_year: Column, published: Column, default_year: Column, list_title: Column | None = None) -> Column:
    """struct(start, end, confidence, note), or null if the body has no date.

    The best label decides: of the lower tier number, first those whose full date is of the
    address's or title's year. A full date stands; month and day take a year by D7, or by a
    weaker label with a trusted year, and are then put right around the turn of a year (D8).
    Without a label the body's first date counts by the same rules. The notes are fixed values."""
    named = title_year if list_title is None else F.coalesce(title_year, year_in(list_title))
    text = F.coalesce(F.when(published != "", F.replace(body, published, F.lit(""))), body, F.lit(""))
    told, told_year = day(published), F.substring(published, 1, 4).try_cast("int")
    says = lambda words: reduce(lambda x, w: x | F.concat_ws(" ", title, text).contains(w), words, F.lit(False))
    trusted = lambda h: h["seg"]["from_full"] & F.coalesce(F.year(h["seg"]["start"]).isin(url_year, named), F.lit(False))

    def out(start: Column, end: Column, confidence: Column, note: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), confidence.alias("confidence"), note.alias("note"))

    def settle(seg: Column, full: str, bare: str) -> Column:
        def moved(c: Column) -> Column:
            years = F.year(c["start"]) - F.year(seg["start"])
            return out(c["start"], seg["end"] + F.make_interval(years=years), c["confidence"], c["note"])

        turned = let(cross_year(seg["start"], told, says(TOLD_AFTER), says(TOLD_BEFORE)), moved)
        as_it_is = lambda note: out(seg["start"], seg["end"], F.lit("high"), F.lit(note))
        return F.when(seg["from_full"], as_it_is(full)).when(published.isNull() | (published == ""), as_it_is(bare)).otherwise(turned)

    def by_label(hits: Column) -> Column:
        tier = F.array_min(F.transform(hits, lambda h: h["tier"]))
        best = F.coalesce(F.get(F.filter(hits, lambda h: (h["tier"] == tier) & trusted(h)), F.lit(0)), F.get(F.filter(hits, lambda h: h["tier"] == tier), F.lit(0)))
        weaker = F.get(F.filter(hits, lambda h: (h["tier"] > tier) & trusted(h)), F.lit(0))
        year = F.coalesce(F.year(weaker["seg"]["start"]), resolve_year(url_year, named, told_year, default_year)["year"])
        dated = lambda h: F.when(h["seg"]["from_full"], h["seg"]).otherwise(F.coalesce(segment_time(h["value"], year, told), h["seg"]))
        return let(best, lambda h: F.when(h.isNotNull(), let(dated(h), lambda seg: settle(seg, "authoritative-label", "monthday-nopublish"))))

    general = segment_time(text, F.coalesce(named, url_year, told_year, default_year), told)
    by_text = let(general, lambda seg: F.when(seg.isNotNull(), settle(seg, "general-body-full", "general-body-monthday-nopublish")))
    return F.coalesce(let(label_times(text), by_label), by_text)


def first_time(text: Column, default_year: Column, published: Column, title_year: Column, url_year: Column) -> Column:
    """D3's struct of the first label's value, else of the whole text."""
    year = F.coalesce(title_year, url_year, F.substring(published, 1, 4).try_cast("int"), default_year)
    labelled = F.regexp_extract(text, rf"(?:{LABEL_ANYWHERE}){SPACE}*[：:]?{SPACE}*(.{{0,80}})", 1)
    return F.coalesce(segment_time(labelled, year, day(published)), segment_time(text, year, day(published)))
