"""Upkeep of the record set: J1-J3, J8-J11, J14, U1, U2, U5, F16, A18."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bare_url(c: Column) -> Column:
    return F.rtrim(c, F.lit("/"))


def record_id() -> Column:
    """The address and, of one of several sessions, its number."""
    return F.concat(F.col("sourceUrl"), F.when(F.coalesce(F.col("lectureIndex"), F.lit(0)) != 0, F.concat(F.lit("#"), F.col("lectureIndex").cast("string"))).otherwise(""))


def known_urls(existing: DataFrame, with_sources: bool = True) -> DataFrame:
    """Addresses that needn't be fetched: of records that aren't one of several sessions,
    and of what was merged into others."""
    several = F.coalesce(F.col("isMultiLecture"), F.lit(False)) & (F.coalesce(F.col("lectureIndex"), F.lit(0)) != 0)
    own = existing.filter(~several).select(bare_url(F.col("sourceUrl")).alias("url"))
    if not with_sources:
        return own.distinct()
    merged = existing.select(F.explode("sources").alias("s")).select(bare_url(F.col("s.sourceUrl")).alias("url"))
    return own.unionByName(merged).distinct()


def unseen(links: DataFrame, known: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Links of (source, url) not known, not excluded, each once a source."""
    out = links.withColumn("url", bare_url(F.col("url")))
    for other in (known, excluded):
        if other is not None:
            out = out.join(other.select(bare_url(F.col("url")).alias("url")).distinct(), "url", "left_anti")
    return out.dropDuplicates(["source", "url"])


def upsert(existing: DataFrame, fresh: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """All rows by key, fresh ones winning, the last of fresh ones. One shuffle:
    a union and a window, whose rank limit runs before it, too."""
    both = existing.withColumn("__p", F.lit(0)).unionByName(fresh.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__p"), F.desc(order))
    return both.withColumn("__rank", F.row_number().over(last)).filter("__rank = 1").drop("__rank", "__p")


def overlay(rows: DataFrame, patches: DataFrame, dropped: DataFrame, added: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns patched by key, some keys dropped, rows added."""
    patch = patches.select(F.col(key), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = rows.join(patch, key, "left").withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns})
    return out.select(rows.columns).join(dropped.select(key).distinct(), key, "left_anti").unionByName(added, allowMissingColumns=True)


def difference(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local keys that are missing remotely."""
    return local.select(key).distinct().join(remote.select(key).distinct(), key, "left_anti")


def audit_missing(missing: DataFrame, remote: DataFrame, key: str = "sourceUrl", order: str = "ord") -> DataFrame:
    """Of missing addresses the record that swallowed them, the first, or none."""
    held = remote.select(F.col(key).alias("owner"), order, F.explode("sources").alias("s")).select(F.col("s.sourceUrl").alias(key), "owner", order)
    first = held.groupBy(key).agg(F.min_by("owner", order).alias("owner"))
    return missing.join(first, key, "left").withColumn("state", F.when(F.col("owner").isNull(), "orphan").otherwise("swallowed"))


def right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two keyed tables, whole rows of the right one winning."""
    values = [c for c in left.columns if c != key]
    a = left.select(key, F.struct(*values).alias("__a"))
    b = right.select(key, F.struct(*values).alias("__b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("__b", "__a").alias("v")).select(key, "v.*")


def greatest_merge(stats: DataFrame, local: DataFrame, key: str, value: str) -> DataFrame:
    """A counter raised to the local one where that is larger."""
    own = local.select(key, F.col(value).alias("__v"))
    return stats.join(own, key, "left").withColumn(value, F.greatest(F.coalesce(value, F.lit(0)), F.coalesce("__v", F.lit(0)))).drop("__v")


def copy_fields(rows: DataFrame, model: DataFrame, targets: list[str], fields: list[str], key: str = "sourceUrl") -> DataFrame:
    """Fields of the one model row given to the target rows."""
    one = model.select(*(F.col(f).alias(f"__{f}") for f in fields)).limit(1)
    hit = F.col(key).isin(targets)
    return rows.join(F.broadcast(one), how="left").withColumns({f: F.when(hit, F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}).select(rows.columns)


def guard(existing: int, result: int, least: float = 0.5) -> bool:
    """F16: whether a result is large enough to replace what exists."""
    return result >= existing * least


def merge_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many records came, stayed, and absorbed others."""
    b = before.agg(F.count("*").alias("n_before"))
    a = after.agg(F.count("*").alias("n_after"), F.count(F.when(F.col("merged"), 1)).alias("n_merged"))
    return b.join(a).select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_gone"), "n_merged")
