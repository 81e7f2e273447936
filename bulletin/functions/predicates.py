"""What is a lecture notice and what isn't, as Column -> Column that is never null."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .dates import let, stamp
from .text import CJK, holds, strip

# Words of lecture titles, and those that rule one out.
LECTURE = ("学术讲座", "讲座", "学术报告", "学术沙龙", "讲坛", "报告会", "前沿讲座", "工作坊", "沙龙", "论坛", "研讨会", "座谈会")
NO_LECTURE = ("回顾", "总结", "新闻", "喜报", "招聘", "招生", "答辩", "公示", "报名截止", "报名结束", "获奖", "申请表", "纪实", "侧记", "花絮", "速递", "快讯", "征文", "征稿", "招募")
# Titles that are no lectures at all.
OTHER_TITLE = (
    "喜讯", "喜报", "获奖", "获奖名单", "入选名单", "录用名单", "录取名单", "征文", "征稿", "招聘", "招贤", "招募", "招新", "纳新", "答辩", "开题", "中期考核", "公示名单", "改期", "延期", "暂停举办", "暂缓举行",
    "纪实", "侧记", "花絮", "速递", "快讯",
)
# Administrative notices.
ADMIN_FRAME = "关于(举办|开展|组织).*?(通知|公告)"
ADMIN_TITLE = ("培训", "行前", "报名表", "征集", "评选", "申报", "推荐", "选拔", "遴选", "答辩", "开题")
ADMIN_BODY = ("各学院、各单位", "全体教师", "请.*参加培训", "报名表", "微信扫码", "长按识别", "会议议程", "会议密码", "腾讯会议号")
ADMIN_STRONG = ("培训会", "行前培训", "报名表")
# Navigation and other entries of lists.
NAVIGATION = ("首页", "主页", "上一页", "下一页", "尾页", "返回", "更多", ">>", "home", "about", "contact", "rss", "sitemap")
NO_ITEM = (
    "通知", "招聘", "答辩", "公示", "大赛", "初赛", "复赛", "决赛", "培训", "宣讲", "招募", "报名", "征稿", "评奖", "获奖", "喜报", "放假", "就业", "职路", "生涯", "课程", "安排", "年会", "夏令营",
    "实习", "调剂", "复试", "录取", "考试", "成果获", "研究成果", "论文", "发表", "论点摘编", "出版", "立项", "结项", "获批", "荣获",
)
CONTENT_URL = r"(?i)/((a/[0-9]{8}/[0-9]+\.html)|([0-9]{4}/[0-9]{4}/[0-9]+\.html)|([0-9]{4}/[0-9]{2}/[0-9]{2}/.*\.html))"
# Reports of what has taken place.
RETRO_STRONG = "(本次活动的成功举办|讲座圆满结束|活动圆满结束|圆满落幕|活动取得圆满成功|圆满成功举办|讲座在我院成功举办|报告会圆满|论坛圆满|讲座取得圆满)"
# Words without which a pattern of reports can't match.
RETRO_STRONG_BY, RETRO_BY, CONDUCT_BY, DONE_BY, TITLE_DONE_BY = ("圆满", "成功"), ("本次", "此次"), ("举办", "开展", "举行"), ("圆满", "成功", "顺利"), ("圆满", "成功", "顺利", "落下帷幕")
RETRO = "(本次讲座|此次讲座|本次报告|此次报告)(?!.{0,30}?(将|拟|计划|旨在|期待|希望))(?=.{0,30}?(不仅|为师生|让师生|受到|得到|圆满|顺利|史料|内容翔实|气氛热烈|拓宽|开拓|反响|一致好评|纷纷表示|收获|深入交流|提供(了)?新))"
TITLE_CONDUCT = "^(?!.*(通知|预告|公示|启事|将|拟|定于|将于))(?=.*(举办|开展|举行))(?=.*(学术讲座|专题讲座|讲座|报告会|学术报告)).+"
TITLE_RETRO, TITLE_AHEAD = "回顾(?!与|及|·|、|—|－|和)", "预告|通知|征稿|招募|报名|启事"
TITLE_DONE = "(圆满落幕|圆满结束|圆满完成|成功举办|顺利举办|顺利开展|顺利召开|成功召开|落下帷幕|讲座圆满|报告圆满|活动圆满|取得圆满成功|取得圆满)"
SIGNATURES = "((供稿|撰稿)[:：].{0,40})?(初审[:：].{0,30})?(复审[:：].{0,30})?终审[:：]"
NARRATIVE_DAY = "(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日"
DONE = "(顺利举办|成功举办|顺利开展|圆满完成|圆满结束|圆满落幕|顺利召开|成功召开)"
TITLE_JOINED = "^(国际商学院|华南师范大学|我院|学院|学校|研究生院|党支部|党委|师生|团队).{0,14}?(参加|赴.*参加|组织.*参加|师生参加|团队参加)"
MARKERS = ("举行", "举办", "开展", "召开", "报告会", "圆满", "顺利", "成功", "落幕", "闭幕", "落下帷幕", "圆满结束", "圆满落幕")
STRUCTURE = r"(时间|地点|主讲|主办|承办|讲座时间|讲座地点)(?=[\s:：．·0-9\x{4E00}-\x{9FA5}])"
# What a speaker's field holds that is no name.
NO_NAME = (
    "联系方式", "报名", "投稿", "截止", "审核", "发布", "更新", "修改", "创建", "我校", "学院", "中心", "研究院", "实验室", "办公室", "秘书处", "组委会", "筹备组", "主办方", "承办方", "协办方", "通知", "公告",
    "欢迎", "敬请", "详情", "咨询", "联系",
)


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text contains any of the words, as they are: one pattern, so the text is
    written and read once."""
    return c.rlike("|".join(map(re.escape, words)))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_lecture(title: Column) -> Column:
    """F1."""
    return any_of(_text(title), LECTURE) & ~any_of(_text(title), NO_LECTURE)


def is_list_item(text: Column, url: Column) -> Column:
    """an entry of a list where every entry is a lecture."""
    t = _text(text)
    return ~any_of(F.lower(t), NAVIGATION) & ~any_of(t, NO_ITEM) & (F.length(t) >= 4) & _text(url).rlike(CONTENT_URL)


def is_other_title(title: Column) -> Column:
    """F3."""
    return any_of(_text(title), OTHER_TITLE)


def is_admin_notice(title: Column, body: Column) -> Column:
    """F4. Body marks are literal, that with dots included."""
    t, b = _text(title), _text(body)
    framed = t.rlike(ADMIN_FRAME) & any_of(t, ADMIN_TITLE) & ~b.rlike(r"主讲[人师][:：]\s*[\x{4E00}-\x{9FA5}]{2,4}")
    return framed & (any_of(b, ADMIN_BODY) | any_of(t, ADMIN_STRONG))


def is_late(start: Column, published: Column, source: Column) -> Column:
    """published after the lecture. By the clock if the lecture's is known, else by day;
    a publishing day taken from the address must be two days late."""
    s, p = stamp(start), stamp(published)
    days = F.date_diff(p.cast("date"), s.cast("date"))
    timed = F.date_format(s, "HH:mm:ss") != "00:00:00"
    return F.coalesce(F.when(_text(source) == "url_proxy", days > 1).when(timed, p > s).otherwise(days > 0), F.lit(False))


def tells_of_this(body: Column, start: Column) -> Column:
    """a day of the lecture's month with a word of completion within fifty letters."""
    b, s = _text(body), F.when(stamp(F.concat(F.substring(start, 1, 10), F.lit(" 00:00:00"))).isNotNull(), F.substring(start, 1, 7))
    days = F.regexp_extract_all(b, F.lit(f"{NARRATIVE_DAY}(?=.{{0,50}}?{DONE})"), F.lit(0))
    month = lambda d: F.format_string("%s-%02d", F.regexp_extract(d, NARRATIVE_DAY, 1), F.regexp_extract(d, NARRATIVE_DAY, 2).cast("int"))
    return holds(b, DONE_BY) & F.exists(days, lambda d: s.isNull() | (month(d) == s))


def tells_a_story(body: Column) -> Column:
    """F8: a flowing report: no fields, and enough words of a report."""
    b = _text(body)
    hits = sum((b.contains(m).cast("int") for m in MARKERS), F.lit(0))
    preview = b.contains("摘要") & b.rlike("教授|研究员|博士|院士") & b.rlike("简介|介绍|个人简介")
    return (F.length(b) >= 30) & (hits >= F.when(F.length(b) > 200, 1).otherwise(2)) & ~b.rlike(STRUCTURE) & ~preview


def news_rule(title: Column, body: Column, start: Column) -> Column:
    """the name of the first rule that takes a page for a report, or null."""
    t, b = _text(title), _text(body)
    return (
        F.when(holds(b, RETRO_STRONG_BY) & b.rlike(RETRO_STRONG) | holds(b, RETRO_BY) & b.rlike(RETRO), "retro-summary")
        .when(holds(t, CONDUCT_BY) & t.rlike(TITLE_CONDUCT), "title-conduct")
        .when(t.contains("回顾") & t.rlike(TITLE_RETRO) & ~t.rlike(TITLE_AHEAD), "title-retro")
        .when(holds(t, TITLE_DONE_BY) & t.rlike(TITLE_DONE), "title-done")
        .when(b.contains("终审") & b.rlike(SIGNATURES), "signature-block")
        .when(tells_of_this(body, start), "narrative-completion")
        .when(t.contains("参加") & t.rlike(TITLE_JOINED), "title-participate")
        .when(tells_a_story(body), "narrative-process")
    )


def is_dropped(title: Column, body: Column, start: Column, published: Column, source: Column, skip_news: Column) -> Column:
    """the last gate of an ingest."""
    news = is_late(start, published, source) | news_rule(title, body, start).isNotNull()
    return is_other_title(title) | is_admin_notice(title, body) | (~F.coalesce(skip_news, F.lit(False)) & news)


def is_speaker(name: Column) -> Column:
    """two to fifteen letters, no word of a form, not only digits and signs."""
    n = _text(name)
    return F.length(n).between(2, 15) & ~any_of(n, NO_NAME) & ~n.rlike(r"(?U)^[\d\s\W]+$")


# Words that are no names, parts that no name has, Latin words that are no names.
NO_NAME_WORDS = (
    "作为", "首席", "主讲", "报告", "学院", "大学", "邀请", "专家", "嘉宾", "简介", "简历", "主持", "致辞", "出席", "参加", "单位", "教授", "研究员", "博士", "老师", "先生", "女士",
    "学术", "讲座", "报告会", "工作坊", "论坛", "沙龙", "研讨会", "讲坛", "座谈会", "时间", "地点", "主题", "题目", "摘要", "内容", "来源", "发布", "承办", "协办", "主办", "科学",
    "中心", "实验室", "研究所", "团队", "课题", "项目", "委员会", "主任", "院长", "处长", "活动", "交流", "研讨", "开展", "举办", "举行",
    "专题", "提出", "入选", "互联", "学者讲坛", "计算机", "人工智能", "新一代", "智能", "运维", "数据", "网络", "系统", "模型", "算法",
    "平台", "技术", "课程", "教学", "教育", "创新", "发展", "研究", "应用", "探索", "实践", "分析", "设计", "构建", "开发", "升级", "优化", "融合", "赋能", "转型", "本科",
    "第一名", "硕士", "一等奖", "二等奖", "三等奖", "特等奖", "金奖", "银奖", "铜奖", "优胜奖", "优秀教师", "青年", "教师", "学生", "领导",
)
NO_NAME_PARTS = (
    "讲坛", "讲座", "论坛", "沙龙", "报告会", "系列", "学者", "讲席", "讲堂", "大讲堂", "学院", "大学", "研究所", "实验室", "中心", "团队", "课题", "项目组", "研究生",
    "本科生", "简介", "简历", "介绍", "摘要", "内容", "地点", "时间", "主题", "题目", "主办", "承办", "协办", "邀请", "嘉宾", "主持", "出席", "参加", "活动", "交流",
    "研讨", "开展", "举办", "举行", "教授", "研究员", "博士", "老师", "院士", "导师", "院长", "主任", "书记", "校长", "主席", "专题", "師范", "师范",
    "星期", "周一", "周二", "周三", "周四", "周五", "周六", "周日",
    "广州", "广东", "北京", "上海", "深圳", "中国", "香港", "美国", "广西", "杭州", "苏州", "成都", "武汉", "南京", "西安", "重庆", "天津", "厦门", "东莞", "佛山", "珠海", "中山",
    "的", "学报", "研究领域", "发表论文", "荣获", "巴洛克", "万人", "石牌", "大学城", "汕尾", "校区", "分享", "从事", "本次", "主要",
    "近年来", "发篇学术", "教育学博", "设儿建设", "台湾省桃", "华南師花", "研究问题",
)
NO_NAME_LATIN = ("professor", "dr", "mr", "ms", "presenter", "lecturer", "speaker", "university", "college", "institute", "research", "science", "chair")


def looks_like_name(name: Column, forbidden: tuple[str, ...] = NO_NAME_PARTS, words: tuple[str, ...] = NO_NAME_WORDS) -> Column:
    """a Latin name, two to five Chinese letters, or both; no forbidden part, no word
    or run of words of the list, no title cut short."""

    def test(n: Column) -> Column:
        cut = n.endswith("题") | (n.endswith("授") & ~n.endswith("教授")) | (n.endswith("士") & ~n.rlike("(博士|院士|硕士|学士)$"))
        latin = n.rlike(r"^[A-Za-z]+(?:[.'·]?\s?[A-Za-z]+)*$") & ~F.lower(F.rtrim(n, F.lit("."))).isin(*NO_NAME_LATIN)
        left = F.regexp_replace(n, "|".join(words), "") if words else n
        chinese = n.rlike(f"^{CJK}{{2,5}}$") & (left != "") & ~n.isin(*words)
        mixed = n.rlike(CJK) & n.rlike("[A-Za-z·]")
        return (F.length(n) >= 2) & ~cut & ~any_of(n, forbidden) & (latin | chinese | mixed)

    return let(strip(_text(name)), test)
