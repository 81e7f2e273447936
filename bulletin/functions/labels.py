"""The grammar of labelled fields. A text is cut once at every label and every other
stop, the longest first, so the work is linear in the text however many fields are wanted."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import SPACE, present, strip, where

# Labels of a notice's fields; where any of them stands, the field before it ends.
FIELD_LABELS = (
    "教学工作坊时间", "教学工作坊地点", "报告时间", "报告地点", "报告内容", "报告题目", "报告专家", "报告嘉宾", "讲座题目", "讲座时间", "讲座地点", "课程地点", "主办单位", "学术主持", "上一篇", "下一篇", "标签", "Tags",
    "地点", "题目", "主题", "讲座主题", "演讲题目", "报告主题", "时间", "主讲人", "主讲师", "讲座人", "主持人", "主讲", "主讲专家", "报告人", "主讲嘉宾", "演讲人", "邀请人", "专家姓名", "Speaker", "Presenter", "Lecturer",
    "摘要", "讲座内容提要", "内容提要", "讲座内容摘要", "内容摘要", "内容简介", "报告简介", "讲座内容", "讲座简介", "讲座主题简介", "报告内容", "讲座概要", "内容概要",
    "简历", "主讲人简介", "主讲人简历", "主讲人介绍", "主讲师简介", "主讲师简历", "主讲简介", "主讲简历", "报告人简介", "报告人简历", "简介", "专家介绍", "专家简介", "发布", "来源", "Topic", "Title", "Venue", "Location", "Abstract", "Bio", "Synopsis", "Inviter",
)
# What else ends a field: counters, a date, a bracket.
FIELD_STOPS = ("点击", "浏览", "评论", "供稿", r"[0-9]{4}[-/年][0-9]", "【", r"\[")
# Labels and stops inside the block of one session.
BLOCK_LABELS = ("主讲人", "主讲师", "报告人", "主持人", "时间", "地点", "题目", "主题", "摘要", "简介", "主办", "承办", "邀请人", "参与者")
BLOCK_STOPS = ("【", "第[一二三四五六七八九十百零0-9]+期", "[0-9]{4}年", "[0-9]{1,2}月[0-9]{1,2}日", "上午", "下午", "晚上")
# The labels of each field.
TOPIC = ("讲座题目", "题目", "主题", "讲座主题", "报告题目", "演讲题目", "报告主题", "Topic", "Title")
PLACE = ("课程地点", "讲座地点", "教学工作坊地点", "地点", "Venue", "Location")
SPEAKER = ("主讲嘉宾", "报告嘉宾", "主讲人", "主讲师", "主讲", "主讲专家", "报告人", "演讲人", "报告专家", "专家姓名", "Speaker", "Presenter", "Lecturer")
INVITER = ("邀请人", "Inviter")

#: Signs that no text holds: before a cut, and between a label and what follows it.
CUT, THEN = "\x01", "\x02"


def any_label(labels: tuple[str, ...]) -> str:
    """A pattern for any of the labels, the longest first. Labels that begin alike are one branch, so a letter is held
    against the first letters, not against every label."""
    heads: dict[str, list[str]] = {}
    for w in labels:
        heads.setdefault(w[:1], []).append(w[1:])
    end = heads.pop("", None)
    branches = [re.escape(ch) + any_label(tuple(rest)) for ch, rest in heads.items()]
    if not branches:
        return ""
    return branches[0] if len(branches) == 1 and end is None else f"(?:{'|'.join(branches)}){'' if end is None else '?'}"


def opening(patterns: tuple[str, ...]) -> str:
    """A look ahead at the first letter of patterns, each of which begins with a letter, an escaped one or a class."""
    first = (p[1 : p.index("]")] if p[0] == "[" else p[:2] if p[0] == "\\" else p[0] for p in patterns)
    return f"(?=[{''.join(dict.fromkeys(first))}])"


def flatten(text: Column) -> Column:
    """One line: runs of white space are one blank; the signs of cuts go."""
    return strip(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), CUT + THEN, ""), f"{SPACE}+", " "))


def scan(text: Column, labels: tuple[str, ...] = FIELD_LABELS, stops: tuple[str, ...] = FIELD_STOPS) -> Column:
    """array<struct<label, value>> of what follows each label with a colon, up to the next
    label or stop, in the order of the text. Labels without a colon only end values; a label
    followed by a book title in its marks is no label."""
    each, ends = any_label(labels), "|".join(stops)
    pattern = rf"{opening((*labels, *stops))}(?:({each})(?!《)\s*[：:]\s*|{each}{'|' + ends if stops else ''})"
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, f"{CUT}$1{THEN}"), CUT)
    cut = F.transform(parts, lambda p: F.struct(F.substring_index(p, THEN, 1).alias("label"), strip(F.substring_index(p, THEN, -1)).alias("value")))
    return F.filter(F.slice(cut, F.lit(2), F.size(cut)), lambda x: x["label"] != "")


def field(scanned: Column, labels: tuple[str, ...], most: int | None = None) -> Column:
    """The first value of any of the labels that isn't empty, or null; at most ``most`` letters."""
    found = F.get(F.filter(scanned, lambda x: x["label"].isin(*labels) & (x["value"] != "")), F.lit(0))["value"]
    return found if most is None else strip(F.substring(found, 1, most))


def block_value(block: Column, labels: tuple[str, ...], most: int = 40) -> Column:
    """C17: a field of one session's block. Blocks without any of its labels aren't cut."""
    short = tuple(w for w in labels if not any(v != w and v in w for v in labels))
    return where(block, short, present(field(scan(block, tuple(dict.fromkeys((*labels, *BLOCK_LABELS))), BLOCK_STOPS), labels, most)))
