"""Pages to links: P5, S4, F18. HTML needs a parser: flat patterns mistake what scripts hold."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.dates import absolute_url
from ..functions.predicates import is_lecture, is_list_item


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            for outer in self.open:
                outer[2] = True  # it wraps another link
            self.open.append([dict(attrs).get("href") or "", [], False])

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            href, words, wraps = self.open.pop()
            if not wraps and href and (text := "".join(w.strip() for w in words)):
                self.found.append((href, text))

    def handle_data(self, data):
        for link in self.open:
            link[1].append(data)


def links_of(html: str | None) -> list[tuple[str, str]]:
    """(href, text) of each link that has both and wraps no other."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return parser.found


def decode(raw: bytes, declared: str | None = None) -> str:
    """Bytes as text: by their declared charset, UTF-8, GB18030, or with marks for what
    can't be read."""
    import re

    found = declared or ((m := re.search(rb"charset=[\"']?([\w-]+)", raw[:2048], re.I)) and m[1].decode())
    for name in dict.fromkeys(x for x in ((found or "").lower().replace("gb2312", "gb18030").replace("gbk", "gb18030"), "utf-8", "gb18030") if x):
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page key, pos, href, text of every link, in the page's order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, h, t) for k, body in zip(pdf[key], pdf[html], strict=True) for i, (h, t) in enumerate(links_of(body))]
            yield pd.DataFrame(rows, columns=[key, "pos", "href", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} bigint, pos int, href string, text string")


def collect(pages: DataFrame, mode: str = "auto", key: str = "page_id", url: str = "url", html: str = "html", base: str = "base") -> DataFrame:
    """P5: the links of list pages that may be lectures: no scripts, anchors, wrappers or
    index pages, not the list itself; by title, or in lists of lectures only by the rest."""
    found = extract(pages, key, url, html).join(pages.select(key, F.rtrim(F.col(url), F.lit("/")).alias("__list"), F.col(base).alias("__base")), key)
    full = absolute_url(F.col("href"), F.col("__base"))
    path = F.lower(F.substring_index(F.rtrim(full, F.lit("/")), "?", 1))
    fair = ~F.col("href").startswith("javascript") & ~F.col("href").startswith("#") & (F.rtrim(full, F.lit("/")) != F.col("__list")) & ~path.rlike("/(content|index)\\.html$")
    wanted = is_list_item(F.col("text"), full) if mode == "all_items" else is_lecture(F.col("text"))
    return found.filter(fair & wanted).select(key, "pos", full.alias("url"), "text")
