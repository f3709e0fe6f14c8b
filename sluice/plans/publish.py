"""Published lists: orders, windows, statistics, fallback, gate (C1, C2, C11-C13; A20-A22, J12, J13, W2, W3, W7, W8, S14-S17, U1)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.functions import ids
from sluice.functions import scoring as S
from sluice.operators import store
from sluice.operators import views as V
from sluice.operators.shared import saved

LIST_COLUMNS = ["list", "position", "image_url", "item_id", "group_id", "group_exists", "url_exists", "live"]
#: Fixed value: the list that is shown if none is asked for, where it is published.
DEFAULT_LIST = ("quality", "4w")
#: Positions are numbered inside pieces of a list's order: steps of the normalized score in each band, hours of a recency list.
SCORE_STEPS, RECENCY_SECONDS, PLACES = 256, 3600, 10_000


def spec_table(spark: SparkSession, names: list[str], version: str = "v1") -> DataFrame:
    """(list, order, limit, seconds) of names like quality-48h; a bad name is an error."""
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("s", ids.parse_spec(F.col("name")))
    ok = F.when(F.col("s").isNull(), F.raise_error(F.concat(F.lit("bad list name: "), F.col("name"))).cast("string")).otherwise(F.col("s.order"))
    return df.select(ids.list_name(F.lit(version), ok, F.col("s.limit")).alias("list"), F.col("s.order").alias("order"), F.col("s.limit").alias("limit"), ids.parse_limit(F.col("s.limit")).alias("seconds"))


def ago(now: Column, seconds: Column) -> Column:
    return now - F.make_dt_interval(secs=seconds)


def publish_lists(items: DataFrame, scores: DataFrame, registry: DataFrame, item_reviews: DataFrame, group_reviews: DataFrame, existence: DataFrame, specs: DataFrame, now: DataFrame, resolver: Callable[[Column, Column], Column] = ids.image_url, checker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All lists in one plan: (list, position, image_url, item_id, group_id, flags[, dimensions]).

    ``resolver`` (X2) makes an address from group and item columns, null if there is none. ``existence`` is a table of
    what is known; with a ``checker`` (X3) it is what that makes of the lists' distinct (item_id, group_id), image_url.
    A column ``dimensions`` of the existence table comes along.

    ``now`` is a one-row table with column ``now``; its value becomes a literal, so cutoffs reach the scan. Visibility
    is judged over the widest window; representatives are chosen before each list's own window, both in one aggregate per
    group; items without an address go after that. ``specs`` has a row per list, so meeting each representative multiplies rows
    by the few lists that are kept. What is left is saved once and numbered by pieces of each list, so
    each table is read once.
    """
    moment = literal(now, "now")
    widest = specs.agg(F.max("seconds")).first()[0]  # one number
    recent = items.where(F.col("original_at") >= ago(moment, F.lit(widest)))
    banded = V.with_bands(V.with_scores(recent, V.known_scores(scores, registry)), registry, item_reviews, group_reviews)
    chosen = V.posts_only(V.visible_representatives(banded, ["original_at", "score", "normalized", "decision_threshold", "group_rank", "item_rank"]))
    rows = chosen.join(V.small(specs), F.col("original_at") >= ago(moment, F.col("seconds")))
    rows = rows.withColumn("image_url", resolver(F.col("group_id"), F.col("item_id"))).where("image_url is not null")
    band = F.coalesce(F.least("group_rank", "item_rank"), "item_rank")
    quality = F.col("order") == "quality"
    keys = {"k1": F.when(quality, band), "k2": F.when(quality, F.col("normalized")), "k3": F.when(~quality, F.col("original_at"))}
    order = [F.desc_nulls_last("k1"), F.desc_nulls_last("k2"), F.desc_nulls_last("k3"), F.asc("item_id"), F.asc("group_id")]
    best = F.coalesce(F.col("k1"), F.lit(-1)) * (SCORE_STEPS + 2) + F.coalesce(F.floor(F.col("k2").cast("double") * SCORE_STEPS), F.lit(-1))
    piece = -F.when(quality, best).otherwise(F.floor(F.unix_seconds(F.col("k3").cast("timestamp")) / RECENCY_SECONDS))
    rows = saved(rows.withColumns(keys).select("list", "order", "image_url", "item_id", "group_id", *keys), "listed")
    rows = V.number_in_pieces(rows, "list", piece, order, "position")
    if checker is not None:
        existence = checker(rows.select("item_id", "group_id", "image_url").distinct())
    return V.with_existence(rows, existence).select(*LIST_COLUMNS, *(["dimensions"] if "dimensions" in existence.columns else []))


def literal(one_row: DataFrame, name: str) -> Column:
    """The value in a one-row table, as a literal of its type."""
    value = one_row.select(F.col(name).cast("string")).first()
    return F.lit(value[0] if value else None).cast(one_row.schema[name].dataType)


def list_statistics(lists: DataFrame, stats: DataFrame, specs: DataFrame, now: DataFrame) -> DataFrame:
    """Per list examined, found, exists, match percent and the next match's prediction.

    Examined is summed once per distinct window length and shared by the orders that have it.
    """
    lengths = V.small(specs.select("limit", "seconds").distinct()).crossJoin(F.broadcast(now)).withColumn("start", ago(F.col("now"), F.col("seconds")))
    near = stats.join(F.broadcast(lengths), (F.col("interval_start") >= F.col("start")) & (F.col("interval_start") < F.col("now")))
    examined = near.groupBy("limit").agg(F.sum("examined").alias("examined"))
    counts = lists.groupBy("list").agg(F.count("*").alias("found"), F.count_if("live").alias("exists"))
    out = specs.join(lengths.select("limit", "start", "now"), "limit").join(examined, "limit", "left").join(counts, "list", "left")
    out = out.fillna(0, ["examined", "found", "exists"])
    return out.select("list", F.col("start").alias("interval_start"), F.col("now").alias("interval_end"), "examined", "found", "exists", S.match_percent(F.col("exists"), F.col("examined")).alias("match_percent"), S.predict_next(F.col("exists"), F.col("start").cast("timestamp"), F.col("now").cast("timestamp")).alias("prediction"))


def dropdown(catalog: DataFrame) -> DataFrame:
    """The catalog's lists in the order of a menu: quality before recency, then by window; ``is_default`` marks one."""
    once = catalog.groupBy("order", "seconds").agg(F.min_by(F.struct("list", "limit"), "list").alias("l")).select("l.list", "order", "l.limit", "seconds")
    rank = F.when(F.col("order") == "quality", 0).otherwise(1)
    preferred = (F.col("order") == DEFAULT_LIST[0]) & (F.col("limit") == DEFAULT_LIST[1])
    first = F.struct((~preferred).alias("p"), rank.alias("r"), "seconds")
    return once.withColumn("is_default", first == F.min(first).over(Window.partitionBy())).orderBy(rank, "seconds")  # one row per list


def resolve_list(catalog: DataFrame, requested: str | None = None) -> DataFrame:
    """The catalog row of the ``<order>-<limit>`` asked for, or the default one if none is; an unknown name, and a
    default without any list, is an error."""
    menu = dropdown(catalog)
    if requested is None:
        found, what = menu.where("is_default"), "no lists are published"
    else:
        found, what = menu.where(F.concat_ws("-", "order", "limit") == requested), f"unknown list: {requested}"
    one = found.agg(F.first(F.struct(*found.columns)).alias("r"))
    ok = F.when(F.col("r").isNull(), F.raise_error(F.lit(what)).cast("boolean")).otherwise(True)
    return one.where(ok).select("r.*")


def serve(lists: DataFrame, catalog: DataFrame, order: str, limit_seconds: int, first: int | None = None) -> DataFrame:
    """The first non-empty live list of the order whose window is at least the
    preferred one, else the widest, empty one; ``first`` cuts it after dedup by group."""
    chain = catalog.where((F.col("order") == order) & (F.col("seconds") >= limit_seconds))
    live = lists.where("live")
    sized = chain.join(live.groupBy("list").agg(F.count("*").alias("n")), "list", "left")
    pick = sized.where("n > 0").agg(F.min_by("list", "seconds").alias("list")).where("list is not null")
    rows = live.join(F.broadcast(pick), "list", "left_semi")  # one name
    once = rows.groupBy("list", "group_id").agg(F.min_by(F.struct("position", "item_id", "image_url"), "position").alias("r")).select("list", "group_id", "r.*")
    once = V.number_in_pieces(once, "list", F.floor(F.col("position") / PLACES), [F.asc("position")], "place")
    return once if first is None else once.where(F.col("place") <= first)


def review_rows(items: DataFrame, scores: DataFrame, registry: DataFrame, item_reviews: DataFrame, group_reviews: DataFrame) -> DataFrame:
    """Every item with its score, both reviews and its effective band."""
    return V.with_bands(items.join(scores, "item_id", "left"), registry, item_reviews, group_reviews).withColumn("band", S.band_name(F.when(F.col("score").isNotNull() | F.col("item_override").isNotNull(), F.col("item_rank"))))


def review_page(items: DataFrame, scores: DataFrame, registry: DataFrame, item_reviews: DataFrame, group_reviews: DataFrame, before: Column | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """C11: (rows, cursor): a page of items, newest first, each with score, reviews and band; scores and reviews are
    looked up for the page's items only."""
    shown, cursor = store.page(items, before, limit)
    rows = V.with_bands(F.broadcast(shown).join(scores, "item_id", "left"), registry, item_reviews, group_reviews)  # at most ``limit`` rows
    return rows.withColumn("band", S.band_name(F.when(F.col("score").isNotNull() | F.col("item_override").isNotNull(), F.col("item_rank")))).orderBy(F.desc("discovered_at"), "item_id"), cursor


def list_detail(lists: DataFrame, scores: DataFrame, item_reviews: DataFrame) -> DataFrame:
    """Published items with score and review; those without a score are dropped."""
    return lists.join(scores, "item_id").join(item_reviews.select("item_id", F.col("band").alias("override")), "item_id", "left").orderBy("list", "position")


def candidates(lists: DataFrame) -> DataFrame:
    """The (item, group) pairs of all lists, once, for one existence check."""
    return lists.select("item_id", "group_id").distinct()


def write_lists(lists: DataFrame, path: str, refreshed_at: Column, statistics: DataFrame | None = None, specs: DataFrame | None = None) -> str:
    """A new version of all lists, their statistics and the catalog of their names, then one pointer row
    that readers follow, last. An empty publish is a version like any other; the catalog names lists without rows, too.

    ``specs`` has the names of all lists as ``list``; without it the catalog has those of the rows.
    """
    version, spark = uuid.uuid4().hex, lists.sparkSession
    lists.write.partitionBy("list").parquet(f"{path}/versions/{version}/lists")
    if statistics is not None:
        statistics.write.parquet(f"{path}/versions/{version}/statistics")
    (lists if specs is None else specs).select("list").distinct().write.parquet(f"{path}/versions/{version}/catalog")
    row = [F.lit(version).alias("version"), refreshed_at.alias("refreshed_at"), F.current_timestamp().alias("at"), F.lit(lists.schema.json()).alias("schema"), F.lit(statistics.schema.json() if statistics is not None else None).cast("string").alias("statistics")]
    spark.range(1).select(*row).write.mode("append").parquet(f"{path}/pointer")
    return version


def _current(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/pointer").orderBy(F.desc("at")).first()  # one row of the pointer table


def read_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The current rows of a list in order, with refreshed_at; none if it is empty."""
    now = _current(spark, path)
    rows = spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(f"{path}/versions/{now['version']}/lists").where(F.col("list") == name)
    return rows.withColumn("refreshed_at", F.lit(now["refreshed_at"])).orderBy("position")


def read_all(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """(rows of all current lists, refreshed_at)."""
    now = _current(spark, path)
    return spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(f"{path}/versions/{now['version']}/lists"), now["refreshed_at"]


def read_statistics(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The current statistics of a list, no row if it has none; None if none were ever written."""
    now = _current(spark, path)
    if now["statistics"] is None:
        return None
    return spark.read.schema(StructType.fromJson(json.loads(now["statistics"]))).parquet(f"{path}/versions/{now['version']}/statistics").where(F.col("list") == name)


def published_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The current catalog, as ``read_catalog`` has it."""
    now = _current(spark, path)
    names = spark.read.schema("list string").parquet(f"{path}/versions/{now['version']}/catalog")
    return read_catalog(names.withColumnRenamed("list", "name"))


def read_catalog(names: DataFrame) -> DataFrame:
    """(list, order, limit, seconds) of the names that parse."""
    p = ids.parse_list_name(F.col("name"))
    return names.where(p.isNotNull()).select(F.col("name").alias("list"), p["order"].alias("order"), p["limit"].alias("limit"), ids.parse_limit(p["limit"]).alias("seconds"))


def publish_if_changed(old: DataFrame | None, inputs: dict[str, DataFrame], publish, has_lists: bool = True) -> DataFrame:
    """(table, n, token) of the inputs; calls ``publish`` if one changed or no list is there."""
    tokens = None
    for name, df in sorted(inputs.items()):
        one = store.snapshot_token(df).select(F.lit(name).alias("table"), "n", "token")
        tokens = one if tokens is None else tokens.unionAll(one)
    if old is None or not has_lists or not store.same_rows(old, tokens).first()["same"]:
        publish()
    return tokens
