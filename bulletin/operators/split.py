"""One page, several sessions: G1, G2, G4, F18 over W2-W6, J12 and J13.

Each way of announcing sessions is a pattern of marks. All marks of a page are found in one
scan a pattern and become rows with their places; blocks run from mark to mark; a block
with a topic and a time is a session. Of the ways that give two sessions or more the first
in the order of trust counts. Everything is keyed by page, so a page's rows meet in one
shuffle and the text goes to them once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import let
from ..functions.extract import affiliation, latin_speaker
from ..functions.labels import CUT, THEN, block_value, flatten
from ..functions.lecture_time import first_time
from ..functions.predicates import is_late, looks_like_name
from ..functions.text import present, strip, where
from .sessions import first_number, meeting_of, next_value, number, richness

# Numerals; the marks of each way to announce sessions; what ends a topic.
NUMERAL = "一二三四五六七八九十百零0-9"
MARKS = {
    "topics": f"(?:报告[{NUMERAL}]+\\s*[题目主题]|专题[{NUMERAL}]+\\s*[题目主题]|主题[0-9]+|讲座题目|题目|主题|讲座主题|报告题目|演讲题目|报告主题|Topic|Title)[：:]",
    "reports": f"报告\\s*[{NUMERAL}]+(?![题目主题摘要人师])(?![{NUMERAL}])",
    "fields": "报告时间:|报告题目:|报告摘要:|报告人:",
    "numbered": "(?:报告题目|讲座题目|专题题目|报告专题|题目|主题)\\s*[0-9]+\\s*[：:]",
    "series": f"第\\s*[{NUMERAL}]+\\s*[讲场期](?![题主报人目介摘])(?![{NUMERAL}])",
}
TOPIC_END = f"(?=\\s*(?:主讲[人师]|报告人|主持人|时间|地点|摘要|简介|主办|承办|邀请人|报告(?=\\s*(?:[0-9]|时间|地点|人|摘要))|$|【|第[{NUMERAL}]+期))"
NUMBERED_END = "(?=\\s*(?:报告人|主讲人|演讲人|讲者|报告专家))"
REPORT_TOPIC = "(?:报告题目|题目|主题|报告主题|专题题目)[：:]\\s*(.+?)(?=\\s*(?:摘要|简介|报告人|主讲人|讲者|时间|地点|报告时间|报告地点|$))"
FIELD_END = "报告题目|报告人|报告时间|报告摘要|报告地点|地点|时间|摘要|简介"
TOPIC_TAILS = (r"\s*(?:主讲人|报告人|预告)\s*[:：]?.*$", "形式[:：].*$")
# Words without which a way has no mark.
MARKED_BY = {"topics": ("题", "报告", "Topic", "Title"), "reports": ("报告",), "fields": ("报告",), "numbered": ("题",), "series": ("第",)}
# How much each label of a block tells; words of links that lead to lectures.
WEIGHTS = {"报告人": 3, "主讲人": 3, "主讲": 3, "参与者": 2, "摘要": 1, "报告时间": 1, "报告地点": 1}
LECTURE_LINK = "讲座|报告|讲坛|论坛|沙龙|研讨会|座谈"
# Surnames of two letters, posts, and what follows a name.
SURNAMES = (
    "欧阳", "司马", "上官", "诸葛", "东方", "令狐", "皇甫", "澹台", "独孤", "夏侯", "宇文", "慕容", "司徒", "拓跋", "尉迟", "闻人", "公孙", "轩辕", "长孙", "鲜于", "万俟", "赫连", "宗政", "濮阳",
    "淳于", "单于", "太叔", "申屠", "仲孙", "乐正", "钟离", "闾丘", "梁丘", "左丘", "东郭", "微生",
)
POST = "特聘教授|特任教授|副教授|助理教授|副研究员|助理研究员|研究员|教授|讲师|博士后|博士|院士"
BODY_WORD = ("学院", "大学", "中心", "学会", "协会", "研究会", "委员会", "办公室", "编辑部")
# Labels of a block's abstract and biography, what ends them, meetings, places.
ABSTRACT = f"(?s)(?:学术报告简介|报告简介|内容简介|讲座简介|报告摘要|摘要)[：:]\\s*(.+?)(?=\\s*(?:讲者简介|报告人简介|主讲人简介|个人简介|简介|专家介绍|报告[{NUMERAL}]|报告时间|报告地点|报告题目|报告摘要|$))"
BIO = f"(?s)(?:讲者简介|报告人简介|主讲人简介|个人简介|简介)[：:]\\s*(.+?)(?=\\s*(?:报告[{NUMERAL}]|报告时间|报告地点|报告题目|报告摘要|$))"
ABSTRACT_TAILS = (r"\s*(?:时间|时闻)\s*[:：\s].*$", r"\s*地点\s*[:：\s].*$", r"\s*20[0-9]{2}年\s*[0-9]{1,2}月\s*[0-9]{1,2}日.*$", r"\s*(?:诚挚邀请|敬请|请各位|欢迎\s*(?:广大|各位|师生|同学|莅临|参加|光临|届时|踊跃|提出|关注)|感兴趣).*$")
MEETING = r"(?:会议号|会议ID|腾讯会议号|Meeting ID|会议号码)[：:\s]*([0-9][0-9\s]{5,})"
MEETINGS = r"(?:腾讯会议\s*)?专题\s*([一二三四五六七八九十]+)\s*[：:]\s*([0-9][0-9\s]{5,})"
DIGITS = "一二三四五六七八九十"
BLOCK_PLACE = r"报告[0-9]*地点[：:]\s*([\x{4E00}-\x{9FA5}A-Za-z0-9（）()号\-／/\s]{2,40}?)(?=报告[0-9]|报告摘要|报告人|报告时间|报告题目|时间|题目|主题|摘要|内容简介|$)"
PAGE_PLACES = (r"活动地点\s*[：:]?\s*([^，。；\s]{2,40})", r"(?<!主)地点\s*[：:]?\s*([^，。；\s]{2,40})")
PLACE_WORD = "校区|楼|室|学院|大学|馆|中心|房|场"
ROUND_TABLE = "该期为圆桌论坛/座谈会形式，无独立主讲人"


def _trimmed(text: Column, tails: tuple[str, ...]) -> Column:
    return reduce(lambda c, p: strip(F.regexp_replace(c, p, "")), tails, text)


def marks(pages: DataFrame, key: str, text: str, patterns: dict[str, str] = MARKS) -> DataFrame:
    """key, way, label, at, after: every mark of every pattern with its place and the place behind it."""
    words = lambda way, p: MARKED_BY[way] if MARKS.get(way) == p else ("",)
    parts = lambda way, p: where(F.col(text), words(way, p), F.split(F.regexp_replace(text, p, f"{CUT}$0{THEN}"), CUT))
    cut = F.array(*(F.struct(F.lit(way).alias("way"), parts(way, p).alias("parts")) for way, p in patterns.items()))
    # ways without a mark have one part
    rows = pages.select(key, F.explode(cut).alias("cut")).filter(F.size("cut.parts") > 1).select(key, "cut.way", F.posexplode("cut.parts").alias("seq", "part"))
    before = Window.partitionBy(key, "way").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length(F.replace("part", F.lit(THEN), F.lit("")))).over(before), F.lit(0)))
    label = F.substring_index("part", THEN, 1)
    return rows.filter("seq > 0").select(key, "way", label.alias("label"), F.col("at").cast("int").alias("at"), (F.col("at") + F.length(label)).cast("int").alias("after"))


def blocks(found: DataFrame, key: str) -> DataFrame:
    """key, way, label, slot, start, stop of the blocks between marks (W2). Reports and numbered
    topics that a page lists twice count where they stand last, in the first one's order (W3)."""
    again = F.col("way").isin("reports", "numbered")
    ordinal = F.when(again, F.regexp_extract("label", f"[{NUMERAL}]+", 0)).otherwise(F.col("at").cast("string"))
    last = found.filter("way <> 'fields'").groupBy(key, "way", ordinal.alias("ordinal")).agg(F.max(F.struct("at", "after", "label")).alias("m"), F.min("at").alias("slot"))
    start = F.when(F.col("way") == "reports", F.col("m.at")).otherwise(F.col("m.after"))
    following = F.lead("m.at").over(Window.partitionBy(key, "way").orderBy("slot"))
    return last.select(key, "way", "m.label", "slot", start.alias("start"), following.alias("stop"))


def field_lists(found: DataFrame, key: str) -> DataFrame:
    """key, slot, title, title_end, next_title: of pages that list fields, each time with the next title
    at or after it (J12) and the title that follows that one."""
    own = found.filter("way = 'fields'")
    enough = [F.count(F.when(F.col("label") == f"{name}:", 1)).over(Window.partitionBy(key)) >= 2 for name in ("报告时间", "报告题目", "报告摘要")]
    own = own.withColumn("enough", reduce(lambda a, b: a & b, enough)).filter("enough").drop("enough")
    title = F.col("label") == "报告题目:"
    ahead = Window.partitionBy(key, title).orderBy("at")
    own = own.withColumn("title", F.when(title, F.struct(F.col("at").alias("start"), F.col("after").alias("value"), F.lead("at").over(ahead).alias("stop"))))
    paired = next_value(own, key, "at", "label", "报告时间:", "报告题目:", "title")
    return paired.filter("next_value IS NOT NULL").select(key, F.lit("fields").alias("way"), "label", F.col("at").alias("slot"), "next_value.start", "next_value.stop", F.col("next_value.value").alias("value"))


def _topic(way: Column, label: Column, block: Column) -> Column:
    """The topic of a block, by the way it was announced."""
    first = lambda p: present(F.regexp_extract(block, p, 1))
    plain = first(rf"^\s*(.+?)\s*{TOPIC_END}")
    series = F.coalesce(first(r"[:：]\s*([^\n：:]{3,40})"), first(r"^\s*([^\n]{3,40})"), F.concat(F.lit("讲座"), label))
    return (
        F.when(way == "topics", _trimmed(strip(plain), TOPIC_TAILS))
        .when(way == "numbered", _trimmed(strip(F.coalesce(plain, first(rf"^\s*(.+?){NUMBERED_END}"))), TOPIC_TAILS))
        .when(way == "reports", _trimmed(strip(first(REPORT_TOPIC)), TOPIC_TAILS[:1]))
        .when(way == "fields", strip(F.regexp_extract(block, f"^报告题目:(.*?)(?={FIELD_END}|$)", 1)))
        .otherwise(strip(series))
    )


def detect(pages: DataFrame, key: str = "key", text: str = "text", title: str = "title", published: str = "published", default_year: str = "default_year", title_year: str = "title_year", url_year: str = "url_year", anchors: str | None = None) -> DataFrame:
    """G1: key, no, topic, start, end, block, way of the sessions of pages that announce several: at least two
    with a topic and a clock time, not all of one topic, and not all at one time unless
    numbered. F18: pages with as many links to lectures (``anchors``) as sessions are lists.
    A null text has none; a text is taken as one line."""
    years = (F.col("default_year"), F.col("published"), F.col("title_year"), F.col("url_year"))
    page = pages.select(key, flatten(F.col(text)).alias("text"), F.col(title).alias("title"), F.col(published).alias("published"), F.col(default_year).cast("int").alias("default_year"), F.col(title_year).cast("int").alias("title_year"), F.col(url_year).cast("int").alias("url_year"), (F.lit(0) if anchors is None else F.coalesce(anchors, F.lit(0))).alias("anchors"))
    # dealt by page once: all that follows is within a page, so nothing is shuffled again, and a table in few files is many tasks
    page = page.repartition(key)
    # lists of fields are told apart here, so that no text is searched for marks that are then left out
    of = lambda *ways: marks(page, key, "text", {w: MARKS[w] for w in ways})
    own = blocks(of("topics", "reports", "numbered", "series"), key).withColumn("value", F.lit(None).cast("int"))
    own = own.unionByName(field_lists(of("fields"), key))
    several = F.count("*").over(Window.partitionBy(key, "way")) >= 2
    own = own.withColumn("several", several).filter("several").drop("several")
    # the day of the whole page is written before blocks that have only clock times
    whole = page.withColumn("whole", first_time(F.col("text"), *years)["start"])
    day = F.coalesce(F.date_format("whole", "yyyy年M月d日 "), F.lit(""))
    with_clock = F.coalesce(F.date_format("whole", "yyyy年M月d日 HH:mm "), F.lit(""))
    cut = lambda a, b: F.substring(F.col("text"), F.col(a) + 1, F.coalesce(F.col(b), F.length("text")) - F.col(a))
    way = F.col("way")
    timed = F.when(way == "fields", F.concat(day, F.substring("text", F.col("slot") + 1, F.length("text")))).when(way == "topics", F.col("block")).when(way == "numbered", F.concat(with_clock, F.col("block"))).otherwise(F.concat(day, F.col("block")))
    joined = own.join(whole, key).withColumn("block", cut("start", "stop"))
    rows = joined.select(key, "way", "label", "slot", "title", "anchors", "block", _topic(way, F.col("label"), F.col("block")).alias("topic"), first_time(timed, *years).alias("t"))
    midnight = (F.date_format("t.start", "HH:mm") == "00:00") & F.col("t.end").isNull()
    # counted before they are filtered: a filter would move below and compute the times once more
    rows = rows.withColumn("valid", F.col("t.start").isNotNull() & (F.length("topic") >= 2) & ((way == "series") | ~midnight))
    # the ways in the order of trust, of those with two sessions at least
    rank = reduce(lambda c, x: c.when(way == x[1], x[0]), enumerate(("reports", "topics", "fields", "numbered", "series")), F.when(F.lit(False), -1))
    rows = rows.withColumn("n", F.count(F.when(F.col("valid"), 1)).over(Window.partitionBy(key, "way"))).filter("valid AND n > 1").withColumn("rank", rank)
    rows = rows.withColumn("best", F.min("rank").over(Window.partitionBy(key))).filter("rank = best")
    rows = rows.select(key, "way", "slot", "title", "anchors", "block", "topic", F.col("t.start").alias("start"), F.col("t.end").alias("end"), richness(F.col("block"), WEIGHTS).alias("rich"))
    # One topic at one time is one session, told by its richest block in the first one's place
    same = Window.partitionBy(key, F.regexp_replace("topic", r"\s+", ""), "start")
    rows = rows.withColumns({"first": F.min("slot").over(same), "best": F.row_number().over(same.orderBy(F.desc("rich"), "slot"))}).filter("best = 1")
    of = Window.partitionBy(key)
    minute = F.date_format("start", "yyyy-MM-dd HH:mm")
    rows = rows.withColumns({"n": F.count("*").over(of), "topics": F.size(F.collect_set("topic").over(of)), "times": F.size(F.collect_set(minute).over(of))})
    kept = rows.filter((F.col("n") > 1) & (F.col("topics") > 1) & ((F.col("way") == "numbered") | (F.col("times") > 1)) & (F.col("anchors") < F.col("n")))
    numbered = number(kept, key, "first", first_number(F.col("title")))
    return numbered.select(key, F.col("lectureIndex").alias("no"), "topic", "start", "end", "block", "way")


def lecture_anchors(links: DataFrame, key: str, href: str = "href", text: str = "text", url: str = "url") -> DataFrame:
    """key and number of a page's links that say a lecture's word and lead elsewhere."""
    bare = lambda c: F.rtrim(F.trim(c), F.lit("/"))
    leads = (F.trim(href) != "") & ~F.trim(href).rlike("^(#|javascript:)") & ~(bare(F.col(href)).eqNullSafe(bare(F.col(url))))
    says = (F.length(text) >= 6) & F.col(text).rlike(LECTURE_LINK)
    return links.groupBy(key).agg(F.count(F.when(leads & says, 1)).alias("anchors"))


def _named(block: Column) -> Column:
    """struct(name, title, affiliation) of a block's own speaker; null if it names none."""
    value = block_value(block, ("主讲人", "主讲师", "报告人", *(f"报告人{n}" for n in range(1, 10)), "讲者", *(f"讲者{n}" for n in range(1, 10)), "讲者简介"), 400)

    def pick(c: Column) -> Column:
        struct = lambda n, a: F.struct(n.alias("name"), present(c["post"]).alias("title"), present(a).alias("affiliation"))
        return F.when(looks_like_name(c["name"]), struct(c["name"], affiliation(c["rest"]))).when(looks_like_name(c["latin"]["name"]), struct(c["latin"]["name"], c["latin"]["affiliation"]))

    def of(v: Column) -> Column:
        post = F.regexp_extract(v, f"({POST})", 1)
        name = F.regexp_extract(v, rf"^((?:{'|'.join(SURNAMES)})[\x{{4E00}}-\x{{9FA5}}]{{2}}|[\x{{4E00}}-\x{{9FA5}}·]{{2,3}})", 1)
        rest = F.regexp_replace(F.substring(v, F.length(name) + 1, F.length(v)), r"^[\s（(，,）)]+|[\s（(，,）)]+$", "")
        return F.when(v.isNotNull(), let(F.struct(post.alias("post"), name.alias("name"), rest.alias("rest"), latin_speaker(v).alias("latin")), pick))

    return let(value, of)


def records(base: DataFrame, sessions: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """A record a session out of the record of its page: own topic, times, host, meeting,
    participants, speaker, abstract, biography and place; a missing speaker is the last
    one's before (W4), at a round table too. ``base`` keeps its other columns."""
    fields = ("title", "topic", "lectureStart", "lectureEnd", "location", "speaker", "speakerTitle", "speakerAffiliation", "speakerSource", "speakerBio", "abstract", "host", "participants", "meetingId", "meetingPlatform", "isMultiLecture", "lectureIndex", "lectureCount", "sourceCount", "notes")
    own = lambda c: present(F.col(f"base.{c}")) if c in base.columns else F.lit(None).cast("string")
    others = [F.col(f"base.`{c}`") for c in base.columns if c not in (*fields, text)]
    block, full = F.col("block"), F.col("base.__flat")
    # one line of each page, made before its sessions take it up
    base = base.withColumn("__flat", flatten(F.col(text)))
    platform = lambda t: F.when(t.contains("腾讯会议"), "腾讯会议").when(t.rlike("(?i)zoom"), "Zoom").when(t.rlike("(?i)webex"), "Webex")
    met = where(block, ("会议", "Meeting ID"), F.regexp_replace(present(F.regexp_extract(block, MEETING, 1)), r"\s", ""))
    numerals, ids = (F.regexp_extract_all(full, F.lit(MEETINGS), F.lit(k)) for k in (1, 2))
    found = F.filter(F.arrays_zip(F.transform(numerals, lambda x: F.position(x, F.lit(DIGITS))).alias("n"), ids.alias("id")), lambda x: x["n"] > 0)
    by_number = lambda pairs: F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: x["n"])), lambda n: F.struct(n, F.regexp_replace(F.element_at(F.filter(pairs, lambda x: x["n"] == n), -1)["id"], r"\s", ""))))
    listed = where(full, ("专题",), let(found, by_number))
    bio = where(block, ("简介",), strip(present(F.regexp_extract(block, BIO, 1))))
    # what several columns need stands in a projection of its own, so it is computed once
    drawn = {
        "__told": where(block, ("简介", "摘要"), _trimmed(strip(present(F.regexp_extract(block, ABSTRACT, 1))), ABSTRACT_TAILS)),
        "__bio": F.regexp_extract(bio, r"^([\x{4E00}-\x{9FA5}·]{2,4})", 1),
        "__about": strip(F.regexp_replace(bio, r"^[\x{4E00}-\x{9FA5}·]{2,4}\s*[,，]\s*", "")),
        "participants": block_value(block, ("参与者",)),
    }
    bio_name, told, about, participants = (F.col(f"s.{c}") for c in ("__bio", "__told", "__about", "participants"))
    in_page = F.coalesce(*(let(F.regexp_extract(full, p, 1), lambda v: F.when(v.rlike(PLACE_WORD), v)) for p in PAGE_PLACES))
    place = F.coalesce(where(block, ("地点",), present(strip(F.regexp_extract(block, BLOCK_PLACE, 1)))), own("location"), where(full, ("地点",), in_page))
    tidy = F.regexp_replace(F.regexp_replace(F.get(F.split(place, "报告[0-9]"), F.lit(0)), r"\s+", ""), "报告(摘要|人|时间)?$", "")
    rows = base.alias("base").join(sessions.withColumns(drawn).alias("s"), key)
    rows = rows.select(
        *others, F.col("s.topic").alias("topic"), F.col("s.start").alias("__start"), F.col("s.end").alias("__end"), F.col("s.no").alias("lectureIndex"), F.concat(F.coalesce(own("title"), F.lit("")), F.lit("— "), F.col("s.topic")).alias("title"),
        block_value(block, ("主持人",)).alias("host"), participants.alias("participants"), met.alias("__met"), platform(block).alias("__by"), meeting_of(F.row_number().over(Window.partitionBy(key).orderBy("s.no")), listed).alias("__listed"), platform(full).alias("__full"),
        (participants.isNotNull() | block.rlike("圆桌|座谈")).alias("__round"), _named(block).alias("__own"), F.when(looks_like_name(bio_name) & ~bio_name.rlike(f"({'|'.join(BODY_WORD)})$") & (F.length(about) >= 10), bio_name).alias("__bio_name"),
        F.coalesce(F.when(F.length(told) > 5, told), own("abstract")).alias("abstract"), F.coalesce(F.when(F.length(about) >= 10, about), own("speakerBio")).alias("speakerBio"), F.coalesce(present(tidy), own("location")).alias("location"),
        own("speaker").alias("__speaker"), own("speakerTitle").alias("__title"), own("speakerAffiliation").alias("__aff"),
    )
    order = Window.partitionBy(key).orderBy("lectureIndex")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # who speaks: the block's own speaker, at a round table one named by a biography; else the last before; else,
    # while there is none, the first whom a biography names
    by = lambda name, source: F.struct(F.col(name).alias("name"), F.lit(source).alias("source"))
    rows = rows.withColumn("__sure", F.when(F.col("__own").isNotNull(), by("__own.name", "block")).when(F.col("__round") & F.col("__bio_name").isNotNull(), by("__bio_name", "block-bio")))
    none_yet = F.col("__speaker").isNull() & F.last("__sure", ignorenulls=True).over(before).isNull() & (F.count("__bio_name").over(before) == 0)
    rows = rows.withColumn("__new", F.coalesce("__sure", F.when(none_yet & F.col("__bio_name").isNotNull(), by("__bio_name", "block-bio"))))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    speaker = F.coalesce(F.last("__new.name", ignorenulls=True).over(upto), F.col("__speaker"))
    none, is_round = F.lit(None).cast("string"), F.col("__own").isNull() & F.col("__round")
    # posts and units go with the speaker; a round table has no post, and none is handed on from it
    post = F.when(F.col("__own").isNotNull(), F.struct(F.coalesce("__own.title", "__title").alias("v"))).when(is_round, F.struct(none.alias("v")))
    unit = F.when(F.col("__own").isNotNull(), F.struct(F.coalesce("__own.affiliation", "__aff").alias("v")))
    handed = lambda c, page: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.struct(F.col(page).alias("v")))["v"]
    rows = rows.withColumns({"__post": post, "__unit": unit})
    source = F.when(F.col("__new").isNotNull(), F.col("__new.source")).when(is_round, none).when(speaker.isNotNull(), "inherited")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    meeting = F.coalesce("__met", "__listed")
    rows = rows.withColumns({
        "speaker": speaker, "speakerSource": source, "speakerTitle": handed("__post", "__title"), "speakerAffiliation": handed("__unit", "__aff"), "lectureStart": stamp("__start"), "lectureEnd": stamp("__end"),
        "meetingId": meeting, "meetingPlatform": F.when(F.col("__met").isNotNull(), F.col("__by")).when(meeting.isNotNull(), F.col("__full")), "isMultiLecture": F.lit(True), "lectureCount": F.count("*").over(Window.partitionBy(key)).cast("int"), "sourceCount": F.when(F.row_number().over(order) == 1, 1).otherwise(0),
        "notes": F.when(is_round, F.array(F.lit(ROUND_TABLE))).otherwise(F.array().cast("array<string>")),
    })
    return rows.select(*(c for c in rows.columns if not c.startswith("__")))


def keep_ahead(rows: DataFrame, published: str = "publishTime", source: str = "publishTimeSource") -> DataFrame:
    """Sessions that were held before they were published go, each by itself."""
    return rows.filter(~is_late(F.col("lectureStart"), F.col(published), F.col(source)))
