"""From pages to records: P6 over C5, C10-C24, D5-D15, F9, F17, G1-G4.

HTML is parsed in Arrow batches, once a page; all else is columns. A field is decided by
rules in order, each giving evidence (a value and where it is from); the first that is
accepted wins, and what it is from stays beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T_

from ..functions import dates as D, labels as G, predicates as P, text as T
from ..functions.extract import affiliation, latin_speaker, posters, speakers
from ..functions.lecture_time import first_time, lecture_time
from ..functions.text import HONOURS, CJK, half_width, label_text, present, strip, strip_footer
from ..session import ready_to_checkpoint
from . import split
from .sessions import by_speaker

# Classes of the element that holds a page's content, the surest first ("article" is the tag);
# classes around a site's own pictures; names of sections that stand in place of titles.
CONTENT = ("wp_articlecontent", "wp_entry", "article-content", "content", "news-details-all", "news-details-middle", "<article>", "entry-content")
BANNER = ("header", "footer", "banner", "nav", "topbar", "sidebar", "tool", "crumb", "logo")
SECTION = ("通知公告", "新闻动态", "学术讲座", "新闻详情", "通知", "公告", "新闻", "动态", "首页", "主页", "关于我们", "联系我们", "列表", "详情")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """What the rules read of a page. Each open element may have lists that take up the text in
    it; an unclosed one ends with the element around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.open: list[tuple[str, str, list[list[str]], int | None]] = []  # tag, classes, lists, rank of content
        self.blocks: dict[int, list[str]] = {}
        self.heads: dict[str, list[str]] = {}
        self.metas: list[str] = []
        self.paragraphs: list[tuple[set[int], list[str]]] = []
        self.images: list[tuple[set[int], str, bool]] = []
        self.links: list[tuple[set[int], str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        around = {rank for *_, rank in self.open if rank is not None}
        if tag == "meta" and {found.get("name", ""), found.get("property", "")} & {"description", "og:description"}:
            self.metas.append(found.get("content", ""))
        if tag == "img":
            classes = " ".join(c for _, c, *_ in self.open[-2:]).lower()
            self.images.append((around, found.get("src") or found.get("data-src", ""), any(b in classes for b in BANNER)))
        if tag in _VOID:
            return
        lists: list[list[str]] = []
        names = {"<article>"} if tag == "article" else set(found.get("class", "").split()) if tag == "div" else set()
        rank = next((r for r, name in enumerate(CONTENT) if name in names and r not in self.blocks), None)
        if rank is not None:
            lists.append(self.blocks.setdefault(rank, []))
        if tag in ("h1", "h2", "h3", "h4", "title") and tag not in self.heads:
            lists.append(self.heads.setdefault(tag, []))
        if tag == "p":
            self.paragraphs.append((around, []))
            lists.append(self.paragraphs[-1][1])
        if tag == "a":
            self.links.append((around, found.get("href", "").strip(), []))
            lists.append(self.links[-1][2])
        self.open.append((tag, found.get("class", ""), lists, rank))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style", "template"):
            return
        self.text.append(data)
        for _, _, lists, _ in self.open:
            for words in lists:
                words.append(data)


def read_page(html: str | None) -> dict:
    """Headings, text, content, and the content's paragraphs, pictures and links; where no element is
    the content, those of the whole page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    best = min(page.blocks, default=None)
    inside = lambda around: best is None or best in around
    closed = lambda words: "".join(w.strip() for w in words)
    out: dict = {h: closed(page.heads[h]) if h in page.heads else None for h in ("h1", "h2", "h3", "h4", "title")}
    metas = [m.strip() for m in page.metas if len(m.strip()) > 3]
    out["text"] = " ".join((*page.text, *metas))
    out["body"] = None if best is None else " ".join(page.blocks[best])
    out["paragraphs"] = [" ".join(" ".join(words).split()) for around, words in page.paragraphs if best is not None and inside(around)]
    out["images"] = [src for around, src, banner in page.images if src and inside(around) and not banner]
    out["links"] = [(href, closed(words)) for around, href, words in page.links if inside(around)]
    return out


_READ = "h1 string, h2 string, h3 string, h4 string, title string, text string, body string, paragraphs array<string>, images array<string>, links array<struct<href:string,text:string>>"


def contents(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' other columns and ``page``, what `read_page` finds in them."""
    found = T_.StructType.fromDDL(_READ)
    others = [f for f in pages.schema if f.name != html]
    schema = T_.StructType(others + [T_.StructField(f"__{f.name}", f.dataType) for f in found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = pd.DataFrame([read_page(body) for body in pdf[html]], columns=found.names, index=pdf.index)
            yield pd.concat([pdf.drop(columns=html), read.add_prefix("__")], axis=1)

    read = pages.select(*(F.col(f"`{f.name}`") for f in others), html).mapInPandas(run, schema)
    return read.select(*(F.col(f"`{f.name}`") for f in others), F.struct(*(F.col(f"__{n}").alias(n) for n in found.names)).alias("page"))


def page_title(page: Column, list_title: Column) -> Column:
    """The list's title, else the first heading that is no section's name, else the page's."""
    head = F.coalesce(page["h1"], page["h2"])
    section = (F.length(head) <= 6) | head.isin(*SECTION)
    own = F.when(head.isNull(), page["title"]).when(section, F.coalesce(page["h3"], page["h4"], page["title"], head)).otherwise(head)
    return T.clean_title(F.coalesce(present(list_title), own, F.lit("")))


def plain(text: Column) -> Column:
    """A page's text as the rules read it: one line, half width, labels closed up, no footer."""
    return strip_footer(label_text(half_width(G.flatten(text))))


# ------------------------------------------------------------------------- places

# What ends a place, what has leaked into it, what is left over at its end, what says that it is online.
PLACE_ENDS = (
    "线上培训", "网络直播", "直播链接", "腾讯会议", "会议号", "会议密码", "会议议程", "报名表", "报名", "欢迎", "咨询", "联系电话", "电话", "二维码", "扫码", "议程", "备注", "网络会议", "线上会议",
    "内容", "详细内容", "主要内容", "会议注册", "讲座教授", "特邀专家", "面向对象", "主持", "职称", "Tencent ?Meeting",
)
PLACE_LEAKS = ((r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月|(?:学校|学院|研究院|系)\s*简介", 3), ("诚挚|请|欢迎|感兴趣|师生参加|参加！", 5), (rf"[：:][^\s:：]{{8,}}|{CJK}{{2,4}},{CJK}{{2,6}},[0-9]{{4}}", 5))
PLACE_NOISE = "主办单位|协办单位|承办单位|邀请人|讲座人|主持人|上一篇|下一篇|标签|Tags|Copyright|版权所有|All Rights Reserved|SCNU|教学工作坊"
PLACE_LEFT = (r"[（(：:；;，,+、#]+\s*$", r";[一二三四五六七八九十百千万0-9]\s*$", r"(?:线上|线下)[:：]?\s*$")
ONLINE, ONLINE_WORD = "线上", "腾讯会议|线上|会议号|会议 ?ID|网络会议|直播|Tencent ?Meeting"


def clean_place(place: Column, title: Column) -> Column:
    """A place without what follows it in the text: codes of meetings, dates, invitations, the
    title or the first six to twelve letters of it; no blanks. What is only a meeting's code is online;
    cleaning twice changes nothing more."""
    return D.let(strip(F.coalesce(place, F.lit(""))), lambda text: F.when(text == "", "").otherwise(_clean_place(text, title)))


def _clean_place(text: Column, title: Column) -> Column:
    before = lambda p, least: lambda c: let_cut(c, F.regexp_instr(c, F.lit(p)) - 1, least)
    cut = strip(F.get(F.split(text, "|".join(PLACE_ENDS), 2), F.lit(0)))
    for pattern, least in PLACE_LEAKS:
        cut = strip(D.let(cut, before(pattern, least)))
    even = lambda c: F.replace(F.translate(c, "：（）", ":()"), F.lit("——"), F.lit("--"))

    def without_title(c: Column) -> Column:
        def by(x: Column) -> Column:
            starts = F.transform(F.sequence(F.greatest(F.least(F.length(x["name"]), F.lit(12)), F.lit(6)), F.lit(6), F.lit(-1)), lambda k: F.position(F.substring(x["told"], F.lit(1), k), x["even"], F.lit(4)))
            first = let_first(starts)
            return D.let(first, lambda at: F.when((F.length(x["name"]) >= 6) & (at > 0), F.substring(c, F.lit(1), at - 1)).otherwise(c))

        return D.let(strip(F.coalesce(title, F.lit(""))), lambda name: D.let(F.struct(name.alias("name"), even(name).alias("told"), even(c).alias("even")), by))

    def closed(c: Column) -> Column:
        bare = T.squeeze(c)
        return reduce(lambda x, _: reduce(lambda y, p: strip(F.regexp_replace(y, p, "")), PLACE_LEFT, x), range(3), bare)

    return D.let(D.let(strip(D.let(cut, without_title)), closed), lambda c: F.when((c == "") & text.rlike(ONLINE_WORD), ONLINE).otherwise(c))


def let_first(places: Column) -> Column:
    """The first place that is one, or 0."""
    return F.coalesce(F.get(F.filter(places, lambda p: p > 0), F.lit(0)), F.lit(0))


def let_cut(text: Column, at: Column, least: int) -> Column:
    """``text`` up to ``at`` (letters before the cut) if that is more than ``least``."""
    return D.let(at, lambda n: F.when(n > least, F.substring(text, F.lit(1), n)).otherwise(text))


def place_of(fields: Column, title: Column) -> Column:
    """The place of a page's fields: cut at noise, without a clock time that slipped in."""
    found = D.let(G.field(fields, G.PLACE), lambda v: strip(F.get(F.split(v, PLACE_NOISE, 2), F.lit(0))))
    short = D.let(found, lambda v: F.when(F.length(v) > 60, strip(F.get(F.split(v, "[。，;；]", 2), F.lit(0)))).otherwise(v))
    return present(clean_place(D.split_location(short), title))


# ------------------------------------------------------------------------- speakers

# Posts behind a name, what makes up a unit, what no speaker ends with, parts of posts cut short, bodies.
POST = "特聘教授|特任教授|长聘教授|副教授|助理教授|副研究员|助理研究员|研究员|教授|讲师|博士后|博士|院士|老师|导师|先生|女士"
UNIT_AHEAD = "大学|学院|研究院|研究所|教授|副教授|讲师|博士|院士|中心|实验室"
NO_SPEAKER_END = "(?:处|部|院|系|中心|公司|局|委|办|室|科|所|厅|署|集团|大学|学院|研究院|巡视员|科员|干事|二级|一级|三级)$"
CUT_SHORT = f"^({CJK}{{2,4}}?)(?:特[聘任]|专|硕|师|范|教|授|研|员|博|士|导|主任|院长)$"
BODY = "^(?:法学会|学会|协会|研究会|联合会|基金会|中心|委员会|团队|联盟|工作组|办公室|编辑部|理事会|组委会)$"
INVITED = r"(?:讲座)?(?:特邀专家|特邀嘉宾|报告专家|演讲嘉宾)[：:\s]*(\S{2,4})(?:[，,。\s]|$)"
ONLY_POST = "^(?:特聘教授|特任教授|助理教授|副教授|副研究员|助理研究员|研究员|教授|讲师|博士后|博士|院士|老师|导师|先生|女士|主任|院长|所长|秘书长)+$"
BIO_POST = "教授|研究员|博士|院长|主任|讲师|院士|博导|处长|司长|局长|书记|会长|秘书长|理事"
EPISODE = "^第[一二三四五六七八九十0-9]+[场期讲]"


def accepted(name: Column) -> Column:
    """F15 with the last guards: no body, no rank, no end of an office's name."""
    return P.looks_like_name(name) & ~name.rlike(NO_SPEAKER_END) & ~name.rlike(BODY)


def evidence(name: Column, title: Column, unit: Column, source: str) -> Column:
    """What a rule found, or null if it isn't a name. A post cut short behind a name goes."""
    whole = D.let(strip(F.coalesce(name, F.lit(""))), lambda n: F.coalesce(present(F.regexp_extract(n, CUT_SHORT, 1)), n))
    made = lambda n: F.struct(n.alias("speaker"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(unit, F.lit("")).alias("unit"), F.lit(source).alias("source"))
    return D.let(whole, lambda n: F.when(accepted(n), made(n)))


def labelled_speaker(value: Column) -> Column:
    """Evidence of a speaker's field: a Latin name; an honour before a name or a run of speakers; a
    name before brackets; a name before a comma; the name that the value begins with."""
    none = F.lit(None).cast("string")

    def rules(v: Column) -> Column:
        post = F.regexp_extract(v, f"(?:{POST})+$", 0)
        latin = latin_speaker(v)
        bracketed = v.rlike("[（(]")
        run = speakers(v)
        honoured = v.rlike("|".join(HONOURS)) | (F.size(run) >= 2)
        first = F.get(run, F.lit(0))
        tight = F.when(v.rlike(CJK), T.squeeze(v)).otherwise(v)
        bare = F.regexp_replace(tight, f"(?:{POST}).*$", "")
        unit_in = F.regexp_replace(F.regexp_replace(F.regexp_extract(tight, "[（(]([^）)]{2,40})[）)]", 1), r"^(?:现为|现任|现供职于|目前任职于|就职于)", ""), f"(?:{POST}).*$", "")
        comma = rf"^({CJK}{{2,4}}|{CJK}{{2,3}}(?:{POST}))[，,]({CJK}{{4,40}})$"
        head = F.coalesce(present(F.regexp_extract(bare, rf"^({CJK}{{2,3}})(?=[^a-zA-Z0-9]*?(?:{UNIT_AHEAD}))", 1)), F.regexp_extract(bare, rf"^({CJK}{{2,4}})", 1))
        return F.coalesce(
            F.when(latin["name"] != "", evidence(latin["name"], post, latin["affiliation"], "label")),
            F.when(~bracketed & honoured, evidence(first["speaker"], F.coalesce(present(first["honour"]), post), none, "label")),
            F.when(bracketed, evidence(F.get(F.split(bare, "[（(]"), F.lit(0)), post, unit_in, "label")),
            evidence(F.regexp_replace(F.regexp_extract(tight, comma, 1), f"(?:{POST})$", ""), post, F.regexp_replace(F.regexp_extract(tight, comma, 2), f"(?:{POST}).*$", ""), "label"),
            D.let(head, lambda h: evidence(h, post, affiliation(F.substring(tight, F.length(h) + 1, F.length(tight))), "label")),
            evidence(bare, post, none, "label"),
        )

    return F.when(value.isNotNull(), D.let(value, rules))


def tidy_unit(unit: Column) -> Column:
    """A unit that is only a post is none; no brackets around it; no blanks in Chinese ones."""
    bare = F.regexp_replace(strip(F.coalesce(unit, F.lit(""))), "^[（()）]+|[（()）]+$", "")
    return D.let(bare, lambda b: F.when(F.regexp_replace(b, r"[\s（(）)]", "").rlike(ONLY_POST), "").when(b.rlike(CJK), T.squeeze(b)).otherwise(b))


# ------------------------------------------------------------------------- topics, biographies, abstracts

# Labels of abstracts; what follows the content; what biographies and lectures tell of; ends of abstracts; headings.
SUMMARY = "讲座内容提要|内容提要|讲座内容摘要|内容摘要|内容简介|报告简介|讲座主题简介|讲座简介|讲座内容|报告内容|讲座概要|内容概要|摘要|Abstract|Synopsis"
NOISE = "资讯及通知|相关新闻|最新动态|推荐阅读|相关文章|相关讲座|上一篇|下一篇|附件下载|相关链接|网友评论|分享|标签|相关推荐|通知公告|最新公告|站内搜索|快速导航"
RIGHTS = "Copyright|版权所有|备案|ICP|All Rights Reserved|Reserved|粤ICP"
PICTURE = r"\s*(//[\w./-]+\.(jpg|jpeg|png|gif))\s*"
BIO = f"(?:报告人简介|主讲人简介|主讲人简历|简历|(?<!内容)简介|Bio)[\\s:：]*(.+?)(?=\\s*(?:{SUMMARY}|{NOISE}|$))"
OF_BIO = ("任教", "所长", "现任", "毕业于", "博士（", "获", "主要从事", "研究方向", "个人著作", "学者", "简历", "供职于", "兼职")
OF_LECTURE = ("本报告", "本次讲座", "本期讲座", "将介绍", "主要内容", "我们", "讲座将", "本次报告", "报告将", "现将")
TOPIC_TAIL = r"\s*(?:摘要|主讲人?|报告人|预告|讲座特邀专家|特邀专家|特邀嘉宾|讲座嘉宾)\s*[:：]?.*$"
TOPIC_IN_TITLE = "(?:学术讲座|讲座|报告会|学术报告)[：:]\\s*(.+)$"
SERIES = r"^[^\"]*?(?:系列讲座|系列活动?)\s*第[一二三四五六七八九十0-9]+[场期讲]\s*[—–-]{1,2}\s*"
# How a narrative tells a place, a speaker and what isn't its abstract.
HALL = "楼|室|厅|馆|校区|校园|中心|广场|会议室|教室|礼堂|报告厅|学术厅|综合楼|行政楼|教学楼|信息楼|院楼|大楼"
HELD_AT = rf"[在于]\s*([^。，；]{{2,55}}?(?:{HALL})(?:\s*[0-9]+)?)\s*(?:成功)?(?:举行|举办|召开|进行|开展)"
TELLER = "主讲|主持|带来"
TELLER_LEAD = "^(?:由学院新引进的|由学院|讲座由|由|院长兼|副院长兼|人工智能学院|计算机学院|学院|新引进的|青年拔尖人才|拔尖人才)+"
TELLER_POST = "教授|副教授|讲师|博士|老师|副院长|院长"
META = r"^([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\s+[0-9]{1,2}:[0-9]{2}|[0-9]{4}\s*年\s*[0-9]{1,2}\s*月|Zoom\s+link|Passcode|主讲人[：:]|报告人[：:]|主持人[：:]|讲座时间[：:]|讲座地点[：:]|主办单位[：:])"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def _prose(text: Column) -> Column:
    """Running text: nothing at all beside a copyright mark, no pictures, nothing of the page behind it."""
    bare = F.regexp_replace(F.when(text.rlike(RIGHTS), "").otherwise(text), PICTURE, "")
    return strip(F.get(F.split(bare, NOISE, 2), F.lit(0)))


def topic_of(fields: Column, title: Column, body: Column) -> Column:
    """struct(value, source): of its label, behind a colon of the title, in the title's book marks, the
    title itself without its series and ending, in book marks behind the speaker."""
    label = strip(F.regexp_replace(G.field(fields, G.TOPIC), TOPIC_TAIL, ""))
    behind = strip(F.regexp_replace(strip(F.regexp_extract(title, TOPIC_IN_TITLE, 1)), "(?:教授|老师|先生|女士)\\s*(学术讲座|讲座|报告|讲坛)$", ""))
    named = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"^[\s\"「]*", ""), SERIES, ""), r"(?:讲座|报告|讲坛|通知|预告)\s*$", ""))
    rules = [(present(label), "label"), (F.when(F.length(behind) > 3, behind), "title"), (F.when((F.length(title) > 8) & (F.length(named) >= 4), named), "title"), (present(strip(F.regexp_extract(title, "《([^《》]{3,60})》", 1))), "title"), (present(strip(F.regexp_extract(body, r"主讲\s*[《<]([^》>]{3,60})[》>]", 1))), "narrative")]
    return _first(rules)


def _first(rules: list[tuple[Column, str]]) -> Column:
    none = F.struct(F.lit("").alias("value"), F.lit(None).cast("string").alias("source"))
    of = lambda source: lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(source).alias("source")))
    return F.coalesce(*(D.let(value, of(source)) for value, source in rules), none)


def bio_of(body: Column, paragraphs: Column, speaker: Column) -> Column:
    """struct(value, source) of the text behind its label, else the first paragraph of thirty letters
    or more that begins with the speaker's name."""
    label = _prose(strip(F.regexp_extract(body, BIO, 1)))
    opens = lambda p: F.regexp_replace(p, r"^\s*(Professor|Dr\.|Mr\.|Ms\.|教授|副教授|讲师|研究员|博士)\s*", "")
    told = F.transform(F.filter(F.coalesce(paragraphs, F.array().cast("array<string>")), lambda p: (F.length(p) >= 30) & (speaker != "") & opens(p).startswith(speaker)), _prose)
    long = lambda v: F.when(F.length(v) > 10, v)
    return _first([(D.let(label, long), "label"), (F.get(F.filter(told, lambda p: F.length(p) > 10), F.lit(0)), "paragraph")])


def abstract_of(body: Column) -> Column:
    """struct(value, source) of the text behind its label, else of the narrative: up to three sentences
    of over twenty letters, behind a first one that tells time and place."""
    tails = lambda c: reduce(lambda x, p: strip(F.regexp_replace(x, p, "")), split.ABSTRACT_TAILS, c)
    label = D.let(_prose(strip(F.regexp_extract(body, f"(?:{SUMMARY})[：:]\\s*(.+)", 1))), lambda v: F.when(F.length(v) > 5, present(tails(v))))

    def of(sentences: Column) -> Column:
        skip = F.get(sentences, F.lit(0)).rlike("月|日|晚|召开|举行|举办|主讲|由") & (F.size(sentences) > 1)
        text = F.concat(F.array_join(F.slice(sentences, F.when(skip, 2).otherwise(1), F.lit(3)), "。"), F.lit("。"))
        bare = strip(F.regexp_replace(F.when(text.rlike(RIGHTS), "").otherwise(text), r"\s*图\s*[0-9]+\s*.*$", ""))
        return D.let(bare, lambda b: F.when((F.length(b) > 15) & ~b.rlike(META) & ~b.rlike(T.NOTICE_LIST), present(tails(b))))

    parts = F.filter(F.transform(F.split(body, "。+"), strip), lambda p: F.length(p) > 20)
    long = lambda v: F.when(F.length(v) > 3, v)
    return _first([(D.let(label, long), "label"), (D.let(D.let(parts, of), long), "narrative")])


def told_speaker(body: Column) -> Column:
    """Evidence of whom a narrative lets speak, before the first word of speaking that names one."""

    def before(word: str) -> Column:
        left = F.when(body.contains(word), F.element_at(F.split(F.substring_index(body, word, 1), "[。，；]"), -1))
        bare = F.regexp_replace(F.regexp_replace(strip(left), TELLER_LEAD, ""), f"^(?:{TELLER_POST})", "")
        name = F.regexp_replace(F.regexp_extract(bare, f"^({CJK}{{2,4}}?)(?=\\s*(?:{TELLER_POST}|$))", 1), f"(?:{TELLER_POST})$", "")
        return evidence(name, F.lit(""), F.lit(""), "narrative")

    return F.coalesce(*(before(w) for w in TELLER.split("|")))


def own_fields(rows: DataFrame) -> DataFrame:
    """Speaker, biography, abstract, topic and place of rows with fields, title, text, body, paragraphs; the
    guards that move values between them last (C24)."""
    label = F.col("__label")
    in_title = F.regexp_replace(F.regexp_extract("title", "（([^（）]*?(?:教授|研究员|副教授|讲师|博士)[^（）]*?)）", 1), r"\s*(教授|研究员|副教授|讲师|博士|老师).*$", "")
    none = F.lit("")
    rows = rows.withColumn("__label", G.field(F.col("fields"), G.SPEAKER))
    rows = rows.withColumn("__topic", topic_of(F.col("fields"), F.col("title"), F.col("body"))).withColumn("__who", F.coalesce(labelled_speaker(label), evidence(in_title, none, none, "title"), F.when(label.isNull(), told_speaker(F.col("body"))), evidence(F.regexp_extract("text", INVITED, 1), none, none, "invited")))
    topic = F.col("__topic.value")
    in_topic = F.when(label.isNotNull() & ~topic.rlike(EPISODE), evidence(F.regexp_extract(topic, rf"^([\x{{4E00}}-\x{{9FA5}}·]{{2,4}})\s+.{{4,}}$", 1), none, none, "topic"))
    rows = rows.withColumn("__who", F.coalesce("__who", in_topic)).withColumn("__bio", bio_of(F.col("body"), F.col("paragraphs"), F.coalesce("__who.speaker", F.lit("")))).withColumn("__abs", abstract_of(F.col("body")))
    # an abstract that tells of a person is the biography, if there is none
    told = F.col("__abs.value")
    moved = (F.col("__bio.value") == "") & (F.length(told) > 30) & _any(told, OF_BIO) & ~_any(told, OF_LECTURE)
    rows = rows.withColumn("__moved", moved)
    rows = rows.withColumn("bio", F.when(F.col("__moved"), F.struct(told.alias("value"), F.lit("abstract").alias("source"))).otherwise(F.col("__bio"))).withColumn("about", F.when(F.col("__moved"), F.struct(F.lit("").alias("value"), F.lit(None).cast("string").alias("source"))).otherwise(F.col("__abs")))
    opening = F.coalesce(present(F.regexp_extract("bio.value", f"^({CJK}{{2,4}})(?=\\s*[，,])", 1)), F.regexp_extract("bio.value", f"^({CJK}{{2,4}}?)\\s*(?:{BIO_POST})", 1))
    rows = rows.withColumn("who", F.coalesce("__who", evidence(opening, none, none, "bio")))
    hall = clean_place(strip(F.regexp_extract("body", HELD_AT, 1)), F.col("title"))
    place = _first([(place_of(F.col("fields"), F.col("title")), "label"), (present(hall), "narrative")])
    return rows.withColumn("topic", F.col("__topic")).withColumn("place", place)


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", default_year: int = 2024, list_title: str | None = None, page_retry: bool = False) -> DataFrame:
    """A row a page of `contents` with all that records and sessions need. Times fall back from the
    content to the whole page (D9, if ``page_retry``), the list's title, the title, the address; a time of
    publishing that was found by its place only and is the lecture's own day doesn't count (D15)."""
    listed = F.col(list_title) if list_title else F.lit(None).cast("string")
    page, year = F.col("page"), F.lit(default_year)
    rows = pages.select(key, F.col(url).alias("url"), listed.alias("listed"), page_title(page, listed).alias("title"), plain(page["text"]).alias("text"), plain(F.coalesce(page["body"], page["text"])).alias("body"), page["paragraphs"].alias("paragraphs"), page["images"].alias("images"), page["links"].alias("links"))
    rows = rows.withColumns({"url_day": D.date_in_url(F.col("url")), "title_year": D.year_in(F.col("title")), "found": D.publish_time(F.col("body"), F.col("text")), "fields": G.scan(F.col("text"))})
    rows = rows.withColumn("url_year", F.year("url_day"))
    years = (year, F.col("found.time"), F.col("title_year"), F.col("url_year"))
    by = lambda c, how, sure=None: F.when(c["start"].isNotNull(), F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(sure).cast("string").alias("confidence"), (F.lit(how) if isinstance(how, str) else how).alias("note")))
    whole = [by(F.col("__page"), F.when(F.col("__page.from_full"), "general-page-full").otherwise("general-page-monthday-nopublish"), "mid")] if page_retry else []
    none = F.lit(None).cast("timestamp_ntz")
    at = lambda d, how: F.when(d.isNotNull(), F.struct(d.cast("timestamp_ntz").alias("start"), none.alias("end"), F.lit(None).cast("string").alias("confidence"), F.lit(how).alias("note")))
    rows = rows.withColumns({
        "__body": lecture_time(F.col("body"), F.col("title"), F.col("url_year"), F.col("title_year"), F.col("found.time"), year, F.col("listed")),
        **({"__page": F.when(F.col("text") != F.col("body"), first_time(F.replace("text", F.coalesce("found.time", F.lit("\0")), F.lit("")), *years))} if page_retry else {}),
        "__list": first_time(F.coalesce("listed", F.lit("")), *years),
    })
    rows = rows.withColumn("t", F.coalesce("__body", *whole, by(F.col("__list"), "list-title"), at(D.date_in_title(F.col("title")), "title-day"), at(F.col("url_day"), "url-day")))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    told = D.void_publish(F.col("found"), stamp("t.start"))
    rows = rows.withColumn("publishTime", told)
    source = F.when(F.col("publishTime").isNotNull(), F.element_at(F.array(F.lit("label"), F.lit("companion"), F.lit("position")), F.greatest("found.level", F.lit(1)))).when(F.col("url_day").isNotNull(), "url_proxy")
    return own_fields(rows.withColumn("publishTimeSource", source))


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", default_year: int = 2024, list_title: str | None = None, skip_news: Column | None = None, page_retry: bool = False) -> DataFrame:
    """The records of pages: one a page, one a session (G1, G2), or one a speaker of a run of
    them (G3). Reports, administrative notices and other titles go (F9), and sessions that were held
    before they were told of (G4).

    Defined cases: a null page has no text, and a record with nothing but its key and address; a page that
    stands twice gives its records twice only if its key differs, as keys are taken to be unique."""
    # parsed once, for all that follows; and no filter may move below it, where it would repeat the rules
    ready_to_checkpoint(pages.sparkSession)
    # dealt by page first, as a table of few files would be few tasks
    rows = parsed(contents(pages.repartition(key), html), key, url, default_year, list_title, page_retry).checkpoint()
    checked = D.cross_validate(F.date_format("t.start", "yyyy-MM-dd HH:mm:ss"), F.date_format("t.end", "yyyy-MM-dd HH:mm:ss"), F.col("url_day"), F.col("publishTime"))
    rows = rows.withColumn("cv", checked)
    ahead = ~P.is_dropped(F.col("title"), F.col("body"), F.col("cv.start"), F.col("publishTime"), F.col("publishTimeSource"), F.lit(False) if skip_news is None else skip_news)
    note = F.concat_ws(";", F.col("t.note"), present(F.array_join("cv.flags", ";")))
    base = rows.withColumn("__ahead", ahead).filter("__ahead").select(
        key, "url", "text", "title", "title_year", "url_year", F.col("topic.value").alias("topic"), F.col("topic.source").alias("topicSource"), F.col("cv.start").alias("lectureStart"), F.col("cv.end").alias("lectureEnd"), F.col("t.confidence").alias("timeConfidence"), present(note).alias("timeNote"),
        F.col("place.value").alias("location"), F.col("place.source").alias("locationSource"), F.coalesce("who.speaker", F.lit("")).alias("speaker"), F.coalesce("who.title", F.lit("")).alias("speakerTitle"), tidy_unit(F.col("who.unit")).alias("speakerAffiliation"), F.col("who.source").alias("speakerSource"),
        F.coalesce(G.field(F.col("fields"), G.INVITER, 30), F.lit("")).alias("inviter"), F.col("bio.value").alias("speakerBio"), F.col("bio.source").alias("bioSource"), F.col("about.value").alias("abstract"), F.col("about.source").alias("abstractSource"), "publishTime", "publishTimeSource",
        posters(F.col("images"), F.col("url_year")).alias("posters"), F.when(F.col("who.source") == "label", speakers(F.col("__label"))).alias("run"), F.size(F.filter("links", lambda a: (F.length(a["text"]) >= 6) & a["text"].rlike(split.LECTURE_LINK) & (a["href"] != "") & ~a["href"].rlike("^(#|javascript:)") & (F.rtrim(a["href"], F.lit("/")) != F.rtrim(F.col("url"), F.lit("/"))))).alias("anchors"),
    )
    base = base.withColumn("default_year", F.lit(default_year))
    found = split.detect(base, key, published="publishTime", anchors=F.col("anchors"))
    helpers = ("text", "title_year", "url_year", "default_year", "anchors", "run")
    sessions = split.keep_ahead(split.records(base.drop(*(h for h in helpers if h != "text")), found, key))
    alone = base.join(found.select(key).distinct(), key, "left_anti")
    several = (F.size("run") >= 2) & ~F.coalesce(G.field(G.scan("text"), G.SPEAKER), F.lit("")).rlike("[（(]")
    alone = alone.withColumn("__run", F.coalesce(several, F.lit(False)))
    shared = by_speaker(alone.filter("__run"), "run").drop("__run", *helpers)
    single = alone.filter("NOT __run").drop("__run", *helpers)
    rows = sessions.unionByName(shared, allowMissingColumns=True).unionByName(single, allowMissingColumns=True)
    return rows.fillna("", subset=["title", "topic", "location", "speaker", "speakerTitle", "speakerAffiliation", "speakerBio", "abstract", "inviter"])
