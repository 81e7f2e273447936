"""String functions as Column -> Column. White space and word classes are Unicode's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Academic titles, stripped from names in this order.
TITLES = ("教授", "副教授", "讲师", "研究员", "副研究员", "院士", "博士", "博士后", "博士生导师", "硕士生导师")
# What stands behind a name: posts and degrees, forms of address, parties.
POSTS = ("特聘教授", "特任教授", "长聘教授", "讲座教授", "讲席教授", "客座教授", "名誉教授", "兼职教授", "青年教授", "卓越教授", "二级教授", "三级教授", "四级教授", "一级教授", "副教授", "助理教授", "副研究员", "助理研究员", "研究员", "教授", "讲师", "博士后", "博士", "硕士", "学士", "院士")
ADDRESS = ("老师", "导师", "先生", "女士")
PARTIES = ("中共党员", "共产党员", "党员", "九三学社", "民进", "民盟", "民建", "致公党", "农工党", "台盟", "无党派")
# Posts that end a Latin speaker's unit, posts that end a speaker in a run of speakers, honours that stand before a name.
POSTS_OF_LATIN = ("特聘教授", "特任教授", "长聘教授", "副教授", "助理教授", "副研究员", "助理研究员", "研究员", "教授", "讲师", "博士后", "博士", "院士", "老师", "导师", "先生", "女士")
POSTS_IN_RUN = ("教授", "研究员", "副教授", "助理教授", "副研究员", "助理研究员", "讲师", "院士", "博士")
HONOURS = ("国家杰青", "长江学者", "国家优青", "优秀青年", "万人计划", "百人计划", "青年千人", "千人计划", "中科院院士", "中国工程院院士", "973首席", "国家万人", "杰青", "优青")
# Full-width signs and their ASCII forms.
FULL_WIDTH, HALF_WIDTH = "：，（）／【】；“”‘’　", ":,()/[];\"\"'' "
# Bilingual labels.
LABELS_ZH = ("题目", "主题", "时间", "地点", "主讲人", "报告人", "主讲", "演讲人", "摘要", "简介", "简历", "主办单位")
LABELS_EN = ("Topic", "Title", "Time", "Date", "Venue", "Location", "Place", "Speaker", "Presenter", "Lecturer", "Abstract", "Bio", "Synopsis")
# Field labels that pages space out or put in brackets.
LABELS = (
    "题目", "主题", "讲座主题", "报告题目", "演讲题目", "报告主题", "讲座题目", "地点", "时间", "主讲人", "主讲师", "报告人", "主讲嘉宾", "演讲人", "主讲", "学术主持", "主办单位",
    "主讲人简介", "主讲人简历", "简历", "简介", "摘要", "讲座内容", "讲座内容提要", "内容提要", "讲座摘要", "报告摘要", "内容摘要", "内容简介", "讲座简介", "报告内容", "讲座概要", "内容概要",
    "发布时间", "发布日期", "来源",
)
# What opens a page's footer.
FOOTERS = ("关于华南师范大学", "版权所有", "All Rights Reserved", "粤ICP", "常用链接", "统一认证", "移动平台", "旧版网站", "网站地图", "无障碍", "联系我们")
# What opens a speaker's biography rather than an abstract.
BIO_PREFIXES = ("主讲人简介", "报告人简介", "嘉宾介绍", "专家介绍", "报告人介绍", "主讲人介绍", "演讲者简介", "About the Speaker")
# Notes that are for maintainers only, and lists of administrative notices.
INTERNAL_NOTE = "(?i)Pattern4|夹逼定位|置信度|建议人工核验|OCR.*跳过|识别失败|内部|调试"
NOTICE_LIST = "资讯及通知|(?:关于.{2,40}(?:通知|公告|申报|征集|转发|招标|遴选).*){2,}"

# letters below 256 are named one by one: they are looked up at once, where a class of a class is asked for each letter
SPACE = r"[ \t\n\x0B\f\r\x{0085}\x{00A0}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{1680}]"
BLANKS = " \t\n\x0b\f\r\x85\xa0\u3000\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u1680"
CJK = r"[\x{4E00}-\x{9FA5}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written and computed once: long expressions that use
    a part several times would otherwise grow by powers."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(c: Column) -> Column:
    """The value, or null where it is empty: empty and missing are the same."""
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Only the ends are looked at, not every letter between them."""
    return F.trim(c, F.lit(BLANKS))


def holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of a few words, each looked for as bytes."""
    return reduce(lambda x, w: x | c.contains(w), words[1:], c.contains(words[0]))


def where(c: Column, words: tuple[str, ...], value: Column) -> Column:
    """``value``, or null where the text holds none of the words: what is cheap to see keeps patterns from texts
    that can't match. The value must be null without the words."""
    return F.when(holds(c, words), value)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "")


def normalize_title(title: Column) -> Column:
    """No white space, then no closing bracket, then no closing date."""
    closed = lambda c: F.when(c.endswith("）") | c.endswith(")"), F.regexp_replace(c, "[（(][^）)]*[）)]$", "")).otherwise(c)
    bare = let(squeeze(F.coalesce(title, F.lit(""))), closed)
    return F.regexp_replace(bare, r"(20[0-9]{2}[-/]?[0-9]{2}[-/]?[0-9]{2}|20[0-9]{6})$", "")


def normalize_speaker(speaker: Column) -> Column:
    """Titles stripped from the end, one after the other in their order."""
    # a stripped text has no line's end behind its last letter, nor has what is left of it
    drop = lambda c, t: let(c, lambda x: F.when(x.endswith(t), F.regexp_replace(x, f"^(.+){t}$", "$1")).otherwise(x))
    ends = tuple(dict.fromkeys(t[-1] for t in TITLES))
    return let(strip(F.coalesce(speaker, F.lit(""))), lambda n: F.when(F.right(n, F.lit(1)).isin(*ends), strip(reduce(drop, TITLES, n))).otherwise(n))


def topic_tokens(text: Column) -> Column:
    """The set of letter pairs of a text without punctuation, and from four letters on
    the whole of it, too."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"""[\s\x{3000},，。、；;：:！!？?·…—\-()（）\[\]【】“”"'《》<>／/]+""", "")
    none = F.array().cast("array<string>")
    pairs = lambda b: F.when(F.length(b) >= 2, F.transform(F.sequence(F.lit(1), F.length(b) - 1), lambda i: F.substring(b, i, F.lit(2)))).otherwise(none)
    return let(bare, lambda b: F.array_union(pairs(b), F.when(F.length(b) >= 4, F.array(b)).otherwise(none)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def join_cjk(text: Column) -> Column:
    """One or two spaces between two Chinese letters go; matches don't overlap."""
    return F.regexp_replace(text, f"({CJK}){SPACE}{{1,2}}({CJK})", "$1$2")


def half_width(text: Column) -> Column:
    """Full-width signs as ASCII, then C6."""
    return join_cjk(F.translate(text, FULL_WIDTH, HALF_WIDTH))


def split_bilingual(text: Column) -> Column:
    """``时间/Time:`` becomes two labels."""
    zh, en = "|".join(sorted(LABELS_ZH, key=len, reverse=True)), "|".join(LABELS_EN)
    text = F.regexp_replace(text, rf"({zh})\s*/\s*({en})\s*[:：]", "$1：$2：")
    return F.regexp_replace(text, rf"({en})\s*/\s*({zh})\s*[:：]", "$2：$1：")


def label_text(text: Column) -> Column:
    """Bracketed labels get a colon, spaced-out ones are closed up, the longest first."""
    longest = sorted(LABELS, key=len, reverse=True)
    text = F.regexp_replace(split_bilingual(text), rf"[【\[]\s*({'|'.join(longest)})\s*[】\]]", "$1：")
    # only a blank behind a label's letter can be closed up
    return let(text, lambda t: F.when(t.rlike(f"{SPACE}(?<=[{''.join(sorted(set(''.join(LABELS))))}]{SPACE})"), reduce(_close_up, _apart(longest), t)).otherwise(t))


def _apart(words: list[str]) -> list[list[str]]:
    """Words in lists, in each of which none begins within another and ends behind it."""
    overlap = lambda a, b: any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b))))
    out: list[list[str]] = []
    for w in words:
        own = next((x for x in out if not any(overlap(v, w) or overlap(w, v) for v in x)), None)
        own.append(w) if own is not None else out.append([w])
    return out


def _close_up(text: Column, words: list[str]) -> Column:
    """The blanks in and behind words of one list go, in one pass: each letter is a group, and those of
    words that aren't there are empty."""
    letters = sum(map(len, words))
    return F.regexp_replace(text, "|".join("".join(f"({ch}){SPACE}*" for ch in w) for w in words), "".join(f"${k + 1}" for k in range(letters)))


def strip_footer(text: Column) -> Column:
    """C11: cut at the first footer mark that stands in the last seven tenths."""

    def cut(t: Column) -> Column:
        far = let(F.length(t), lambda n: F.filter(F.array(*(F.locate(m, t) - 1 for m in FOOTERS)), lambda p: (p > 0) & (p >= n * 0.3)))
        return let(F.array_min(far), lambda at: F.when(at.isNotNull(), F.substring(t, F.lit(1), at)).otherwise(t))

    return strip(let(text, cut))


def clean_title(title: Column) -> Column:
    """A site's suffix, the notice prefix, quotes, a stray bracket and a leading date go."""
    t = strip(title)
    t = strip(F.substring_index(t, " - ", 1))
    t = strip(F.substring_index(t, "｜", 1))
    for pattern in (rf"^[{SPACE[1:-1]}【\[]*讲座通知[{SPACE[1:-1]}】]", rf"^[{SPACE[1:-1]}｜|：:]*", "^讲座通知[｜|（(]"):
        t = strip(F.regexp_replace(t, pattern, ""))
    for _ in range(2):
        t = F.when((F.length(t) > 4) & t.startswith('"') & t.endswith('"'), strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    t = strip(F.regexp_replace(t, rf"^[｜|{SPACE[1:-1]}]+", ""))
    t = strip(F.regexp_replace(t, "[）)]$", ""))
    return strip(F.regexp_replace(t, r"^\s*(?:19|20)[0-9]{2}\s*[-/年.]\s*[0-9]{1,2}\s*[-/月.]\s*[0-9]{1,2}\s*[日号]?\s*", ""))


def block_field(block: Column, labels: str, stops: str, most: int = 40) -> Column:
    """What follows a label in a block up to the next label or line, cut at ``most``."""
    found = F.regexp_extract(block, rf"(?:{labels})\s*[:：]\s*(.{{0,{most * 4}}}?)(?=(?:{stops})\s*[:：]|[\n\r]|$)", 1)
    return present(strip(F.substring(found, 1, most)))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` letters, the last an ellipsis where any are cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def clean_footer(text: Column) -> Column:
    """Nothing from a copyright mark on."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), "(?is)(Copyright|版权所有|备案|ICP|All Rights Reserved|Reserved).*", ""))


def notes_text(notes: Column) -> Column:
    """Public notes in one line."""
    return F.array_join(F.filter(F.coalesce(notes, F.array().cast("array<string>")), lambda n: ~n.rlike(INTERNAL_NOTE)), "；")


def abstract_of(abstract: Column, bio: Column, most: int = 300) -> Column:
    """The abstract, unless it is a biography, part of it, or a list of notices."""
    a, flat = strip(F.coalesce(abstract, F.lit(""))), squeeze(F.coalesce(bio, F.lit("")))
    is_bio = reduce(lambda x, p: x | a.startswith(p), BIO_PREFIXES, F.lit(False)) | ((F.length(flat) > 10) & flat.contains(squeeze(a)))
    return F.when(is_bio | a.rlike(NOTICE_LIST), F.lit("")).otherwise(truncate(a, most))


def safe_url(url: Column) -> Column:
    """Http and https links only."""
    return F.when(strip(url).rlike("(?i)^https?://"), strip(url)).otherwise(F.lit("#"))


def distinct_first(primary: Column, others: Column) -> Column:
    """The primary value and the others of its sources, in order, each once."""
    return F.array_distinct(F.filter(F.concat(F.array(primary), F.transform(others, lambda o: F.coalesce(present(o), primary))), lambda x: x.isNotNull()))


def episode_title(title: Column, index: Column) -> Column:
    """The session's number after the title, unless it is there."""
    there = F.regexp_like(title, F.concat(F.lit("第"), index.cast("string"), F.lit("[场期讲]")))
    return F.when(index.isNotNull() & ~there, F.concat(title, F.lit("（第"), index.cast("string"), F.lit("期）"))).otherwise(title)
