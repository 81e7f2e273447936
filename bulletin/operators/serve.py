"""Faceted search, sorting and paging: F10-F12, O1-O3, O6, O7, W8, P1-P4, A17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import NO_DATE, day_key, year_of
from ..functions.text import present

PAGE = 25
LATEST, PREVIEW = 50, 220
# The fields that a search looks at.
FIELDS = {
    "": ("title", "topic", "speaker", "speakerAffiliation", "speakerBio", "listTitle", "college", "location", "campus", "organizer"),
    "location": ("location",),
    "topic": ("title", "topic", "listTitle"),
    "college": ("college",),
}


def matches(rows: DataFrame, query: str, field: str = "") -> Column:
    """the text, in lower case, in the fields of a search; of a place or a college also
    in those of the sources, where they have them."""
    q = query.strip().lower()
    parts = [present(F.col(f)) for f in FIELDS[field] if f in rows.columns]
    if field in ("location", "college") and "sources" in rows.columns and field in rows.schema["sources"].dataType.elementType.fieldNames():
        parts.append(F.array_join(F.filter(F.col(f"sources.{field}"), lambda x: present(x).isNotNull()), " "))
    return F.lower(F.concat_ws(" ", *parts)).contains(q) if q else F.lit(True)


def facet(rows: DataFrame, name: str, value: str | None) -> Column:
    """the record's own value or that of any of its sources."""
    if not value:
        return F.lit(True)
    own = F.coalesce(F.col(name) == value, F.lit(False))
    if "sources" not in rows.columns:
        return own
    return own | F.coalesce(F.exists("sources", lambda s: F.coalesce(s[name] == value, F.lit(False))), F.lit(False))


def search(rows: DataFrame, campus: str | None = None, college: str | None = None, year: str | None = None, query: str = "", field: str = "", liked: DataFrame | None = None) -> DataFrame:
    """All facets together."""
    keep = facet(rows, "campus", campus) & facet(rows, "college", college) & matches(rows, query, field)
    if year:
        keep = keep & (year_of(F.col("lectureStart"), F.col("publishTime"), F.col("title")) == year)
    out = rows.filter(keep)
    return out if liked is None else out.join(liked.select("sourceUrl").distinct(), "sourceUrl", "left_semi")


def newest_first(order: str = "ord") -> list[Column]:
    """O1: by start, the latest first, those without one last."""
    return [F.desc_nulls_last(present(F.col("lectureStart"))), F.asc(order)]


def timeline(order: str = "ord") -> list[Column]:
    """O3: by day; within a day by the number of a series, then by time. Rows without a
    number come after those with one, which makes the order total."""
    start = present(F.col("lectureStart"))
    no = F.regexp_extract(F.coalesce("title", F.lit("")), "第([0-9]+)(?:讲|场|期|届)", 1).try_cast("bigint")
    return [F.desc_nulls_last(F.substring(start, 1, 10)), F.desc_nulls_last(F.when(no > 0, no)), F.desc_nulls_last(start), F.asc(order)]


def latest(rows: DataFrame, n: int = LATEST, undated_first: bool = True, order: str = "ord") -> DataFrame:
    """The first rows of a page, long texts cut. Rows without a start lead, unless
    told otherwise. Spark keeps n rows of each task."""
    start = present(F.col("lectureStart"))
    top = rows.orderBy(F.desc_nulls_first(start) if undated_first else F.desc_nulls_last(start), F.asc(order)).limit(n)
    return preview(top)


def preview(rows: DataFrame, most: int = PREVIEW) -> DataFrame:
    """P2."""
    return rows.withColumns({c: F.substring(c, 1, most) for c in ("abstract", "speakerBio") if c in rows.columns})


def index(rows: DataFrame) -> DataFrame:
    """The least that a client needs to count by itself."""
    year = year_of(F.col("lectureStart"), F.col("publishTime"), F.col("title"))
    n = F.coalesce(F.col("sourceCount"), F.when(F.size(F.coalesce("sources", F.array())) > 0, F.size("sources")), F.lit(1))
    return rows.select(F.coalesce("sourceUrl", F.lit("")).alias("u"), year.alias("y"), F.coalesce(present(F.col("college")), F.lit("未分类")).alias("c"), n.cast("bigint").alias("s"))


def source_struct() -> Column:
    """P4."""
    return F.struct("sourceUrl", "college", "campus", "title")


def page(rows: DataFrame, number: int, order: list[Column], size: int = PAGE) -> DataFrame:
    """One page of a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def by_day(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Rows with their day's heading and their place in it; undated ones last. In
    long form, so no day is ever gathered into one value."""
    key = day_key(F.col("lectureStart"))
    place = Window.partitionBy("day").orderBy(*timeline(order))
    return rows.withColumn("day", key).withColumn("place", F.row_number().over(place)).orderBy((F.col("day") == NO_DATE).asc(), F.desc("day"), "place")


def page_window(current: int, total: int, around: int = 2) -> list[int | str]:
    """The page numbers to show, with gaps marked."""
    shown = sorted({1, total, *range(max(1, current - around), min(total, current + around) + 1)} & set(range(1, total + 1)))
    out: list[int | str] = []
    for n in shown:
        if out and n - shown[shown.index(n) - 1] > 1:
            out.append("…")
        out.append(n)
    return out
