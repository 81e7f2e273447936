"""Pages that announce several sessions: J12, J13, W2-W7, G2, G3, A16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def next_value(rows: DataFrame, key: str, pos: str, kind: str, anchor: str, wanted: str, value: str) -> DataFrame:
    """Each anchor of a page with the first wanted value at or after it: a forward
    as-of join as one window over the page's marks."""
    ahead = Window.partitionBy(key).orderBy(F.col(pos), F.col(kind) == wanted).rowsBetween(0, Window.unboundedFollowing)
    same = Window.partitionBy(key, pos)
    here = F.min(F.when(F.col(kind) == wanted, F.col(value))).over(same)
    following = F.first(F.when(F.col(kind) == wanted, F.col(value)), ignorenulls=True).over(ahead)
    return rows.withColumn("next_value", F.coalesce(here, following)).filter(F.col(kind) == anchor)


def block_ends(rows: DataFrame, key: str, pos: str, length: str) -> DataFrame:
    """A block ends where the next label of its page begins, or with the page."""
    return rows.withColumn("end", F.coalesce(F.lead(pos).over(Window.partitionBy(key).orderBy(pos)), F.col(length)))


def last_in_first_slot(rows: DataFrame, key: str, ordinal: str, pos: str, value: str) -> DataFrame:
    """Of each ordinal the last value, in the place of the first."""
    return rows.groupBy(key, ordinal).agg(F.max_by(value, pos).alias(value), F.min(pos).alias("slot"))


def inherit(rows: DataFrame, key: str, order: str, column: str, default: Column | None = None) -> DataFrame:
    """A missing value is the last one before it, or the page's."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last(F.when(F.col(column) != "", F.col(column)), ignorenulls=True).over(before)
    return rows.withColumn(column, filled if default is None else F.coalesce(filled, default))


def number(rows: DataFrame, key: str, order: str, first: Column | int = 1) -> DataFrame:
    """Sessions numbered from ``first``, with their number; the first stands for the
    page's notice, the others for none."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w)
    return rows.withColumns({"lectureIndex": n - 1 + first, "lectureCount": F.count("*").over(Window.partitionBy(key)).cast("int"), "sourceCount": F.when(n == 1, 1).otherwise(0)})


def first_number(title: Column) -> Column:
    """The first number of a range of numbers in a title that rises, or 1."""
    pair = [F.regexp_extract(F.coalesce(title, F.lit("")), r"第\s*([0-9]{1,3})\s*-\s*([0-9]{1,3})\s*期", k).try_cast("int") for k in (1, 2)]
    return F.when((pair[0] >= 1) & (pair[0] < pair[1]), pair[0]).otherwise(F.lit(1))


def richness(block: Column, weights: dict[str, float]) -> Column:
    """How much a block tells: weighted counts of its labels."""
    return sum((F.regexp_count(block, F.lit(p)) * w for p, w in weights.items()), F.lit(0.0))


def dedup_sessions(rows: DataFrame, key: str, topic: str, start: str, rich: str, pos: str) -> DataFrame:
    """Of sessions with one topic and start the richest, in the first one's place."""
    bare = F.regexp_replace(F.coalesce(F.col(topic), F.lit("")), r"\s+", "")
    # one window over one column, so that rows are dealt and sorted once
    best = Window.partitionBy(key, "__bare", F.col(start)).orderBy(F.desc(rich), F.asc(pos))
    slot = F.min(pos).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("__bare", bare).withColumns({"slot": slot, "__r": F.row_number().over(best)}).filter("__r = 1").drop("__r", "__bare")


def nearest(candidates: Column, at: Column) -> Column:
    """Of array<struct<pos, value>> the value nearest to a place, the first of equals."""
    ranked = F.transform(candidates, lambda c: F.struct(F.abs(c["pos"] - at).alias("d"), c["pos"].alias("pos"), c["value"].alias("value")))
    return F.array_min(ranked)["value"]


def meeting_of(index: Column, meetings: Column) -> Column:
    """The meeting of a session by its number; null where there is none."""
    return F.try_element_at(meetings, index)


def by_speaker(rows: DataFrame, speakers: str = "speakers") -> DataFrame:
    """A row for each speaker of a notice that has several, numbered; honours stand for
    the title, and the first row alone counts as the notice."""
    none = F.array().cast("array<string>")
    own = {
        "speaker": F.col("__s.speaker"),
        "speakerTitle": F.coalesce("__s.honour", F.lit("")),
        "speakerAffiliation": F.lit(""),
        "speakerSource": F.lit("label"),
        "isMultiLecture": F.lit(True),
        "lectureIndex": F.col("__i") + 1,
        "lectureCount": F.size(speakers),
        "sourceCount": F.when(F.col("__i") == 0, 1).otherwise(0),
        "notes": none,
    }
    return rows.select("*", F.posexplode(speakers).alias("__i", "__s")).withColumns(own).drop("__i", "__s")
