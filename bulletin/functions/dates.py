"""Dates and times of notices as Column -> Column; impossible ones are null, never errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, present, squeeze

# Parts of the day, and those that add twelve hours.
PERIOD = "上午|早上|中午|下午|晚上|傍晚"
AFTERNOON = ("中午", "下午", "晚上", "傍晚")
WEEKDAYS = ("日", "一", "二", "三", "四", "五", "六")
# The label of notices without a date or a year.
NO_DATE, NO_YEAR = "时间待定", "其他"

_STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(text: Column) -> Column:
    """A full ``YYYY-MM-DD HH:MM:SS``; anything less precise is null."""
    s = F.substring(text, 1, 19)
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.try_to_timestamp(s, F.lit(_STAMP))).cast("timestamp_ntz")


def day(text: Column) -> Column:
    """The date that a text starts with."""
    s = F.regexp_extract(F.coalesce(text, F.lit("")), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(s != "", F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))).cast("date")


def make_day(y: Column, m: Column, d: Column) -> Column:
    """A date of three numbers or texts; null if there is no such day."""
    zero = F.lit(0)

    def of(n: Column) -> Column:
        ok = n["m"].between(1, 12) & n["d"].between(1, 31) & n["y"].between(1, 9999)
        return F.when(ok, F.try_make_timestamp_ntz(n["y"], n["m"], n["d"], zero, zero, zero)).cast("date")

    return let(F.struct(y.try_cast("int").alias("y"), m.try_cast("int").alias("m"), d.try_cast("int").alias("d")), of)


def in_period(hour: Column, period: Column) -> Column:
    """Afternoon hours before twelve get twelve more."""
    return F.when(period.isin(*AFTERNOON) & (hour < 12), hour + 12).otherwise(hour) % 24


# A clock time in digits, and one that is said.
CLOCK = r"([0-9]{1,2})\s*[:：]\s*([0-9]{2})"
SPOKEN = r"([0-9]{1,2})\s*点\s*(?:([0-9]{1,2})\s*分?|半)?"


def times_on(date: Column, segment: Column) -> Column:
    """struct(start, end, has_time) of a date and the first two clock times after it. Each form is
    looked for once, and numbers are taken from what was found."""
    part = lambda hit, pattern, k: F.regexp_extract(hit, pattern, k).try_cast("int")
    numbers = lambda h0, m0, h1, m1: F.struct(h0.alias("h0"), m0.alias("m0"), h1.alias("h1"), m1.alias("m1"))
    none = F.lit(None).cast("int")

    def read(clocks: Column) -> Column:
        first, second = F.get(clocks, F.lit(0)), F.get(clocks, F.lit(1))
        return numbers(part(first, CLOCK, 1), part(first, CLOCK, 2), part(second, CLOCK, 1), part(second, CLOCK, 2))

    def heard(hit: Column) -> Column:
        said = F.regexp_extract(hit, SPOKEN, 2)
        minute = F.when(said != "", said.try_cast("int")).when(segment.contains("半"), F.lit(30)).otherwise(F.lit(0))
        return F.when(hit != "", numbers(part(hit, SPOKEN, 1), minute, none, none)).otherwise(numbers(none, none, none, none))

    def of(t: Column) -> Column:
        valid = lambda h, m: h.between(0, 23) & m.between(0, 59)
        at = lambda h, m: F.when(valid(h, m) & date.isNotNull(), date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), in_period(h, t["period"]), m))
        n = t["n"]
        has_time = F.coalesce(valid(n["h0"], n["m0"]), F.lit(False)) & date.isNotNull()
        start = F.coalesce(at(n["h0"], n["m0"]), date.cast("timestamp_ntz"))
        return F.struct(start.alias("start"), F.when(has_time, at(n["h1"], n["m1"])).alias("end"), has_time.alias("has_time"))

    found = let(F.regexp_extract_all(segment, F.lit(CLOCK), F.lit(0)), lambda c: F.when(F.size(c) > 0, read(c)).otherwise(let(F.regexp_extract(segment, SPOKEN, 0), heard)))
    return let(F.struct(F.regexp_extract(segment, f"({PERIOD})", 1).alias("period"), found.alias("n")), of)


def segment_time(segment: Column, default_year: Column, published: Column) -> Column:
    """D3: struct(start, end, has_time, from_full) of the first date of a text: a full
    Chinese date, then a full numeric one that isn't the day of publishing, then month and
    day in the default year."""
    return let(squeeze(F.coalesce(segment, F.lit(""))), lambda seg: _segment_time(seg, default_year, published))


# Forms of dates; of the numeric ones the year stands first.
ZH_DATE = r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})[日号]"
NUMERIC_DATES = (r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"([0-9]{4})\.([0-9]{2})\.([0-9]{2})", r"([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", r"([0-9]{4})/([0-9]{2})([0-9]{2})")
MONTH_DAY, SLASH_DAY = r"([0-9]{1,2})月([0-9]{1,2})[日号]?", r"(?<!20[0-9]{2}/)([0-9]{1,2})/([0-9]{1,2})"


def _segment_time(seg: Column, default_year: Column, published: Column) -> Column:
    """Each form is looked for once in the segment, and only where none before it has a date; numbers
    are taken from what was found."""
    part = lambda hit, pattern, *ks: [F.regexp_extract(hit, pattern, k) for k in ks]
    choose = lambda d, hit, full: F.struct(d.alias("d"), hit.alias("h"), F.lit(full).alias("full"))

    def numeric(pattern: str) -> Column:
        dated = F.transform(F.regexp_extract_all(seg, F.lit(pattern), F.lit(0)), lambda h: choose(make_day(*part(h, pattern, 1, 2, 3)), h, True))
        return F.get(F.filter(dated, lambda x: x["d"].isNotNull() & ~F.coalesce(x["d"] == published, F.lit(False))), F.lit(0))

    own = lambda pattern: let(F.regexp_extract(seg, pattern, 0), lambda hit: F.when(hit != "", choose(make_day(default_year, *part(hit, pattern, 1, 2)), hit, False)))
    other = F.coalesce(*map(numeric, NUMERIC_DATES), own(MONTH_DAY), own(SLASH_DAY))
    found = let(F.regexp_extract(seg, ZH_DATE, 0), lambda zh: F.when(zh != "", choose(make_day(*part(zh, ZH_DATE, 1, 2, 3)), zh, True)).otherwise(other))
    behind = lambda c: F.substring(seg, F.position(c["h"], seg), F.length(seg))
    timed = lambda c, t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["has_time"].alias("has_time"), c["full"].alias("from_full"))
    on = lambda c: let(behind(c), lambda rest: let(times_on(c["d"], rest), lambda t: timed(c, t)))
    return let(found, lambda c: F.when(c["d"].isNotNull(), on(c)))


def year_in(text: Column) -> Column:
    """The year of the first full date of a text."""
    patterns = (r"(20[0-9]{2})[-/.年]\s*[0-9]{1,2}[-/.月]\s*[0-9]{1,2}", r"(20[0-9]{2})([0-9]{2})([0-9]{2})")
    return F.coalesce(*(present(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)) for p in patterns)).cast("int")


def date_in_title(title: Column) -> Column:
    """A full date in a title: Chinese, eight lone digits, or with separators."""
    t = F.coalesce(title, F.lit(""))
    patterns = (r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*[日号]?", r"(?<![0-9])(20[0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])", r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"([0-9]{4})\.([0-9]{2})\.([0-9]{2})")
    return F.coalesce(*(make_day(*(F.regexp_extract(t, p, k) for k in (1, 2, 3))) for p in patterns))


def date_in_url(url: Column) -> Column:
    """The date of a content page's path, by the first of four forms that has one."""
    u = F.coalesce(url, F.lit(""))
    patterns = (r"/a/(20[0-9]{2})([0-9]{2})([0-9]{2})/", r"/a/(20[0-9]{2})/([0-9]{2})([0-9]{2})/", r"/(20[0-9]{2})/([0-9]{2})([0-9]{2})/[^/]+\.html?$", r"/(20[0-9]{2})/([0-9]{1,2})/([0-9]{1,2})/[^/]+\.html?$")
    return F.coalesce(*(make_day(*(F.regexp_extract(u, p, k) for k in (1, 2, 3))) for p in patterns))


def resolve_year(url: Column, title: Column, published: Column, default: Column) -> Column:
    """struct(year, source) by the order of trust."""
    source = F.when(url.isNotNull(), "url").when(title.isNotNull(), "title").when(published.isNotNull(), "publish").otherwise("current")
    return F.struct(F.coalesce(url, title, published, default).alias("year"), source.alias("source"))


def cross_year(start: Column, published: Column, retro: Column, preview: Column) -> Column:
    """struct(start, confidence, note): a start in another year than the publishing may
    belong a year later or earlier. Within one year nothing moves. The notes are fixed values."""
    shifted = lambda n: F.to_timestamp_ntz(F.date_format(start, "yyyy-MM-dd HH:mm:ss"), F.lit(_STAMP)) + F.expr(f"INTERVAL '{n}' YEAR")
    rule = lambda moved, conf, note: F.struct(moved.alias("start"), F.lit(conf).alias("confidence"), F.lit(note).alias("note"))
    s, p = start.cast("date"), published
    before = s < p
    return (
        F.when(p.isNull(), rule(start, "low", "publish-unparseable"))
        .when(s == p, rule(start, "high", "same-day-normal"))
        .when(F.year(s) == F.year(p), rule(start, "high", "same-year"))
        .when(before & retro, rule(start, "high", "retrospective-report"))
        .when(before & preview, rule(shifted(1), "high", "preview-nextyear"))
        .when(before & F.month(p).isin(11, 12) & F.month(s).isin(1, 2), rule(shifted(1), "high", "crossyear-window"))
        .when(before, rule(start, "low", "crossyear-uncertain"))
        .when(preview, rule(start, "high", "preview-normal"))
        .when(retro, rule(shifted(-1), "high", "retro-prevyear"))
        .when(F.month(p).isin(1, 2) & F.month(s).isin(11, 12), rule(shifted(-1), "low", "crossyear-window-prev"))
        .otherwise(rule(start, "low", "crossyear-uncertain"))
    )


def year_of(start: Column, published: Column, title: Column) -> Column:
    """Year of the start, else of publishing, else the first in the title, else a mark."""
    head = F.substring(F.trim(F.coalesce(published, F.lit(""))), 1, 4)
    in_title = present(F.regexp_extract(F.coalesce(title, F.lit("")), "([0-9]{4})", 1))
    return F.coalesce(F.substring(present(start), 1, 4), F.when(head.rlike("^[0-9]+$"), head), in_title, F.lit(NO_YEAR))


def _weekday(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(ts))


def day_key(start: Column) -> Column:
    """The day's heading on a timeline."""
    ts = F.coalesce(stamp(start), day(start).cast("timestamp_ntz"))
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" 周"), _weekday(ts)), F.lit(NO_DATE))


def short_time(start: Column) -> Column:
    """Month, day, weekday and clock."""
    ts = F.coalesce(stamp(start), day(start).cast("timestamp_ntz"))
    return F.coalesce(F.concat(F.month(ts).cast("string"), F.lit("月"), F.dayofmonth(ts).cast("string"), F.lit("日 周"), _weekday(ts), F.lit(" "), F.date_format(ts, "HH:mm")), F.lit("待定"))


def status(start: Column, now: Column, hot_days: int = 7) -> Column:
    """P10: struct(label, hot) at the time ``now``."""
    ts = stamp(start)
    soon = (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) <= hot_days * 86_400_000_000
    label = F.when(ts.isNull(), NO_DATE).when(ts < now, "已结束").otherwise("即将开始")
    return F.struct(label.alias("label"), F.coalesce((ts >= now) & soon, F.lit(False)).alias("hot"))


def publish_time(body: Column, page: Column) -> Column:
    """struct(time, level): 1 by label, 2 beside a counter or author, 3 by place."""
    date = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:\s+[0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?"
    minute = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:\s+[0-9]{2}:[0-9]{2})?"
    near = "来源|点击|评论|浏览|作者"
    label = rf"(?i)(?:发布(?:时间|日期)?|发表时间|发布于|posted|date)\s*[：:]?\s*({date})"
    rules = [(body, label, 1), (page, label, 1), (body, rf"(?:{near})[：: ]*\D{{0,20}}?({minute})", 2), (body, rf"({minute})\D{{0,20}}?:[0-9]{{2}}\s*(?:{near})", 2), (body, rf"({minute})\D{{0,20}}?(?:{near})", 2), (body, f"({date})", 3), (page, f"({date})", 3)]
    none = F.struct(F.lit(None).cast("string").alias("time"), F.lit(0).alias("level"))
    rule = lambda text, p, level: let(F.regexp_extract(text, p, 1), lambda time: F.when(time != "", F.struct(time.alias("time"), F.lit(level).alias("level"))))
    return F.coalesce(*(rule(*r) for r in rules), none)


def void_publish(found: Column, start: Column) -> Column:
    """A time found by place only doesn't count if it is the lecture's day."""
    return F.when((found["level"] >= 2) & (F.substring(found["time"], 1, 10) == F.substring(start, 1, 10)), F.lit(None)).otherwise(found["time"])


def cross_validate(start: Column, end: Column, url_date: Column, published: Column) -> Column:
    """struct(start, end, flags): swapped if the end comes first, and what looks odd."""
    s, e = stamp(start), stamp(end)
    swap = F.coalesce(e < s, F.lit(False))
    flags = F.array_compact(
        F.array(
            F.when(F.abs(F.date_diff(day(start), url_date)) > 30, "cv-url-date-mismatch"),
            F.when(day(published) > day(start), "cv-publish-after-lecture"),
            F.when(swap, "cv-end-before-start-swapped"),
        )
    )
    return F.struct(F.when(swap, end).otherwise(start).alias("start"), F.when(swap, start).otherwise(end).alias("end"), flags.alias("flags"))


def split_location(location: Column) -> Column:
    """A place without the times that slipped into it."""
    at = r"[0-9]{1,2}\s*[:;]\s*[O0-9]{1,2}\s*[-–~—]\s*[0-9]{1,2}\s*[:;]"
    cut = F.regexp_extract(location, rf"^(.*?)\s*{at}", 1)
    return F.when(location.rlike(at) & (cut != ""), F.trim(cut)).otherwise(location)


def absolute_url(href: Column, base: Column) -> Column:
    """A link of a page with its site before it."""
    root = F.rtrim(base, F.lit("/"))
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, F.lit("/"), href))


def next_page(url: Column) -> Column:
    """The next numbered page of a list, by its address alone."""
    n = F.regexp_extract(url, r"/([0-9]+)\.html$", 1)
    following = F.concat(F.regexp_replace(url, r"/[0-9]+\.html$", "/"), (n.try_cast("bigint") + 1).cast("string"), F.lit(".html"))
    return F.when(n != "", following).when(url.endswith("/"), F.concat(F.rtrim(url, F.lit("/")), F.lit("/2.html")))


def heat(value: Column, largest: Column) -> Column:
    """The shade of a cell of a heat map."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.06), value / F.greatest(largest, F.lit(1))))

