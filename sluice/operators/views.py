"""Scored views and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import ids
from sluice.functions import scoring as S

#: A registry with more models than this is joined without a hint.
REGISTRY_ROWS = 10_000


def small(df: DataFrame, rows: int = REGISTRY_ROWS) -> DataFrame:
    """Broadcasts a registry-like table after checking its size, up to ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def number_in_pieces(df: DataFrame, group: str, piece: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each group in the given order, of which ``piece`` must be a coarser, rising form.

    Rows are numbered inside their piece and the counts of the pieces before are added, so no task sorts a whole group. A
    null group, and a null piece (the first of its group), are like any other. ``df`` is read twice: hand in a written table.
    """
    rows = df.withColumn("_piece", piece)
    counts = rows.groupBy(F.col(group).alias("_g"), F.col("_piece").alias("_p")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_p")) - F.col("_n")  # one row per group and piece
    counts = counts.select("_g", "_p", before.alias("_before"))
    rows = rows.join(counts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_piece").eqNullSafe(F.col("_p")))
    place = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order))
    return rows.withColumn(name, (F.col("_before") + place).cast("long")).drop("_piece", "_g", "_p", "_before")


def unscored(items: DataFrame, scores: DataFrame, since: Column | None = None) -> DataFrame:
    """Items without a score under any version, newest first."""
    rows = items if since is None else items.where(F.col("discovered_at") >= since)
    return rows.join(scores.select("item_id"), "item_id", "left_anti").orderBy(F.desc("discovered_at"), "item_id")


def known_scores(scores: DataFrame, registry: DataFrame) -> DataFrame:
    """Scores of registered versions."""
    return scores.join(small(registry.select("model_version").distinct()), "model_version", "left_semi")


def with_scores(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Inner join on the item."""
    return items.join(scores.select("item_id", "score", "model_version"), "item_id")


def scored_since(items: DataFrame, scores: DataFrame, registry: DataFrame, cutoff: Column) -> DataFrame:
    """Scored items published since the cutoff (inclusive), registered versions only."""
    return with_scores(items.where(F.col("original_at") >= cutoff), known_scores(scores, registry))


def top_scored(items: DataFrame, scores: DataFrame, registry: DataFrame, limit: int, max_age_hours: int | None = None, now: Column | None = None) -> DataFrame:
    """The best scores first; more than 100 are refused. Items are fetched for the winners only."""
    if limit > 100:
        raise ValueError("at most 100 items can be asked for")
    chosen = known_scores(scores, registry)
    if max_age_hours is not None:
        recent = items.where(F.col("discovered_at") >= now - F.make_interval(hours=F.lit(max_age_hours))).select("item_id")
        chosen = chosen.join(recent, "item_id", "left_semi")
    best = chosen.join(items.select("item_id"), "item_id", "left_semi").orderBy(F.desc("score"), "item_id").limit(limit)
    return items.join(F.broadcast(best.select("item_id", "score", "model_version")), "item_id").orderBy(F.desc("score"), "item_id")  # 100 rows at most


def with_bands(scored: DataFrame, registry: DataFrame, item_reviews: DataFrame, group_reviews: DataFrame) -> DataFrame:
    """Adds threshold, normalized, item_rank and the group's override rank."""
    rows = scored.join(small(registry.select("model_version", "decision_threshold")), "model_version", "left")
    rows = rows.join(item_reviews.select("item_id", F.col("band").alias("item_override")), "item_id", "left")
    rows = rows.join(group_reviews.select("group_id", F.col("band").alias("group_override")), "group_id", "left")
    t = F.col("decision_threshold")
    return rows.withColumns({"normalized": S.normalize(F.col("score"), t), "item_rank": S.item_band(F.col("score"), t, F.col("item_override")), "group_rank": S.rank_of_band(F.col("group_override"))})


def group_bands(banded: DataFrame) -> DataFrame:
    """A10: the least of a group's item bands and its override; groups without items have none."""
    return banded.groupBy("group_id").agg(F.least(F.min("item_rank"), F.min("group_rank")).alias("rank"))


def visible_groups(banded: DataFrame) -> DataFrame:
    """A11."""
    return group_bands(banded).where(S.is_visible(F.col("rank"))).select("group_id")


def representatives(banded: DataFrame, keep: list[str]) -> DataFrame:
    """Each group's item of the highest raw score, ties by item; a partial minimum, so no group is hot."""
    order = F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))
    return banded.groupBy("group_id").agg(F.min_by(F.struct("item_id", *keep), order).alias("best")).select("group_id", "best.*")


def visible_representatives(banded: DataFrame, keep: list[str]) -> DataFrame:
    """The representatives of the visible groups, from one aggregate per group."""
    order = F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))
    rank = F.least(F.min("item_rank"), F.min("group_rank"))
    each = banded.groupBy("group_id").agg(F.min_by(F.struct("item_id", *keep), order).alias("best"), rank.alias("rank"))
    return each.where(S.is_visible(F.col("rank"))).select("group_id", "best.*")


def posts_only(df: DataFrame) -> DataFrame:
    """P16."""
    return df.where(ids.parse_group(F.col("group_id"))["collection"] == ids.POST_COLLECTION)


def with_existence(df: DataFrame, existence: DataFrame) -> DataFrame:
    """Flags default to true; ``live`` is both."""
    flags = {c: F.coalesce(F.col(c), F.lit(True)) for c in ("group_exists", "url_exists")}
    return df.join(existence, "item_id", "left").withColumns(flags).withColumn("live", F.col("group_exists") & F.col("url_exists"))
