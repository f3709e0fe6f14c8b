"""Pruning: events, labels, metadata verdicts, tallies (S1-S3, P5-P13, A7-A9, C3 batch form, C7, W13, W15, A28, A29, F20)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import geometry as G
from sluice.functions import ids
from sluice.functions import scoring as S
from sluice.operators.shared import saved

#: Labels that exclude a post.
EXCLUDED_LABELS = ("porn", "sexual", "nudity", "!no-unauthenticated")
EVENT_SCHEMA = """
    kind string, time_us bigint, did string,
    commit struct<operation:string, collection:string, rkey:string, record:struct<
        labels:struct<values:array<struct<val:string>>>, createdAt:string,
        embed:struct<images:array<struct<image:struct<ref:struct<`$link`:string>, cid:string>>>,
                     media:struct<images:array<struct<image:struct<ref:struct<`$link`:string>, cid:string>>>>>>>
"""
THREAD_LABELS = "struct<labels:array<struct<val:string>>, author:struct<labels:array<struct<val:string>>>, embed:struct<record:struct<record:struct<author:struct<labels:array<struct<val:string>>>>>>>"
#: Boxes of an item up to which it is judged in one row, at first and once rounds have left so few.
FEW_BOXES, LAST_BOXES = 64, 500
CID = "^[A-Za-z0-9]{4,}$"


def parse_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Events from JSON text, with event_time that every variant advances."""
    e = df.select(F.from_json(value, EVENT_SCHEMA).alias("e")).select("e.*")
    return e.withColumn("event_time", F.timestamp_micros("time_us"))


def resume(events: DataFrame, cursor_us: Column, now_us: Column | None = None, rewind_s: int = 5, cap_s: int = 30) -> DataFrame:
    """Events from 5 s before the cursor; if that is more than 30 s ago, the gap is skipped."""
    start = cursor_us - rewind_s * 1_000_000
    ok = F.lit(True) if now_us is None else now_us - start <= cap_s * 1_000_000
    return events.where(F.col("time_us") >= F.when(ok, start).otherwise(F.coalesce(now_us, start) if now_us is not None else start))


def self_labelled(labels: Column) -> Column:
    """P5."""
    return F.coalesce(F.exists(labels, lambda x: x["val"].isin(*EXCLUDED_LABELS)), F.lit(False))


def embedded_images(embed: Column) -> Column:
    """Direct images, else those of a record with media."""
    return F.coalesce(embed["images"], embed["media"]["images"])


def blob_ids(images: Column) -> Column:
    """Ids by typed or legacy reference; invalid ones are skipped."""
    one = lambda i: F.coalesce(i["image"]["ref"]["$link"], i["image"]["cid"])
    return F.filter(F.transform(images, one), lambda c: c.isNotNull() & c.rlike(CID))


def extract_candidates(events: DataFrame) -> DataFrame:
    """Created posts without an excluded label that have a valid image: (event_time, time_us, group_id, cids,
    original_at); original_at is the time that the post states, null if it is none."""
    record = F.col("commit.record")
    rows = events.where((F.col("kind") == "commit") & (F.col("commit.operation") == "create") & (F.col("commit.collection") == ids.POST_COLLECTION))
    rows = rows.where(~self_labelled(record["labels"]["values"])).withColumn("cids", blob_ids(embedded_images(record["embed"])))
    group = F.concat_ws("/", F.lit("at:/"), "did", "commit.collection", "commit.rkey")
    return rows.where(F.size("cids") > 0).select("event_time", "time_us", group.alias("group_id"), "cids", F.try_to_timestamp(record["createdAt"]).alias("original_at"))


def blocked_labels(thread_json: Column) -> Column:
    """Excluded labels of post, author and quoted author, each once, in that order."""
    post = F.from_json(F.get_json_object(thread_json, "$.thread.post"), THREAD_LABELS)
    paths = (post["labels"], post["author"]["labels"], post["embed"]["record"]["record"]["author"]["labels"])
    vals = [F.coalesce(F.transform(p, lambda x: x["val"]), F.array().cast("array<string>")) for p in paths]
    return F.array_distinct(F.filter(F.concat(*vals), lambda v: v.isin(*EXCLUDED_LABELS)))


def verdict(blocked: Column, fetched: Column) -> Column:
    """Pass or Blocked; what couldn't be fetched is blocked."""
    return F.when(~fetched, "Blocked:fetch failed").when(F.size(blocked) > 0, F.concat(F.lit("Blocked:"), F.array_join(blocked, ","))).otherwise("Pass")


def available(thread_json: Column) -> Column:
    """Unless the thread is of type notFound or blocked."""
    kind = F.get_json_object(thread_json, "$.thread.$type")
    return F.coalesce(~(kind.endswith("#notFoundPost") | kind.endswith("#blockedPost")), F.lit(True))


def viewable(thread_json: Column) -> Column:
    """P9."""
    return available(thread_json) & (F.size(blocked_labels(thread_json)) == 0)


def exists_by_status(status: Column, kind: str) -> Column:
    """P10: images are gone by 404 or 410, posts by any 4xx but 429; unknown counts as there."""
    gone = status.isin(404, 410) if kind == "image" else (status >= 400) & (status < 500) & (status != 429)
    return F.coalesce(~gone, F.lit(True))


def reason_rows(df: DataFrame) -> DataFrame:
    """Each item with categories and its only category, from the array ``reasons``."""
    return df.withColumn("categories", F.array_distinct(F.transform("reasons", G.category))).withColumn("sole", F.when(F.size("categories") == 1, F.col("categories")[0]))


def tally(df: DataFrame, by: tuple = ()) -> DataFrame:
    """Posts, images, saved and rejected; sums of per-row counts, so partial sums merge."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return df.groupBy(*by).agg(*[total(c) for c in ("posts", "images", "saved", "rejected")])


def judge_items(df: DataFrame, width: float, height: float, thresholds: dict, categories: set[str]) -> DataFrame:
    """Adds zone and reasons to (faces, text_pct, face_skin, outside_skin, ...); an accepted item has a zone and no reasons.

    Each step is a column of its own, so that none is worked out twice.
    """
    rows = df.withColumn("_frontal", F.filter("faces", G.is_frontal)).withColumn("_face", F.get("_frontal", F.lit(0)))
    rows = rows.withColumns({"_area": G.box_area_percent(F.col("_face"), width, height), "_zone": G.zone(F.col("_face"), width, height)})
    rows = rows.withColumn("_failed", G.failed_rules(F.col("_area"), F.col("text_pct"), F.col("face_skin"), F.col("outside_skin"), thresholds, categories))
    rows = rows.withColumn("reasons", G.reasons(F.size("faces"), F.size("_frontal"), F.col("_failed"), F.col("_zone")))
    return rows.withColumn("zone", F.when(F.size("reasons") == 0, F.col("_zone"))).drop("_frontal", "_face", "_area", "_zone", "_failed")


def rejection_breakdown(df: DataFrame) -> DataFrame:
    """(kind, name, n): each reason; each category once per item; sole category if it is the only one.

    One pass: an item gives a row for each of its names, and those are summed per name.
    """
    named = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    names = F.concat(named("reason", F.col("reasons")), named("category", F.col("categories")), named("sole", F.array_compact(F.array("sole"))))
    return reason_rows(df).select(F.explode(names).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def breakdown_shares(breakdown: DataFrame, rejected: int | Column) -> DataFrame:
    """Adds ``percent``: a reason's share of all reasons, a category's (or sole category's) of the rejected images."""
    every = F.sum(F.when(F.col("kind") == "reason", F.col("n"))).over(Window.partitionBy())  # one row per reason and category
    total = F.when(F.col("kind") == "reason", every).otherwise(rejected if isinstance(rejected, Column) else F.lit(rejected))
    return breakdown.withColumn("percent", F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0))


def status_summary(df: DataFrame, seconds: Column) -> DataFrame:
    """Hit rate and rates per second of a tally row."""
    return df.withColumns({"hit_percent": S.percentage(F.col("saved"), F.col("images")), "posts_per_s": F.col("posts") / seconds, "images_per_s": F.col("images") / seconds})


def counter_deltas(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Growth since the last snapshot of a counter, never negative, zeros left out."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(key).orderBy(ts))
    return df.withColumn("delta", F.greatest(F.col(value) - before, F.lit(0))).where("delta > 0").select(key, ts, "delta")


def suppress(boxes: DataFrame, key: str = "item_id", limit: float = 0.3, few: int = FEW_BOXES) -> DataFrame:
    """The boxes (key, x, y, width, height, score) without those that a better one of the same item overlaps by more than ``limit``.

    Better is: higher score, then smaller x, y, width, height; of boxes that are alike in all of these one stays. An item of at most ``few``
    boxes is judged in one row, best first. Items with more go through rounds over a grid (``suppress_by_rounds``), so no item is one task.
    """
    many = boxes.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(F.col(key).alias("_k"))
    many = saved(many, "crowded")  # seldom any
    same = F.col(key).eqNullSafe(F.col("_k"))
    small = boxes.join(many, same, "left_anti")
    out = judge_in_a_row(small, key, limit)
    if many.isEmpty():
        return out
    return out.unionByName(suppress_by_rounds(boxes.join(many, same, "left_semi"), key, limit))


def judge_in_a_row(boxes: DataFrame, key: str, limit: float) -> DataFrame:
    """W15 for items of few boxes: each is gone through best first, against those that stay."""
    cols = [c for c in boxes.columns if c != key]
    order = F.struct((-F.col("score")).alias("s"), "x", "y", "width", "height", F.struct(*cols).alias("box"))
    lists = boxes.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("all"))
    kept = F.aggregate(F.col("all")["box"], F.slice(F.col("all")["box"], 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: G.iou(k, b) > limit), kept).otherwise(F.concat(kept, F.array(b))))
    return lists.select(key, F.explode(kept).alias("box")).select(key, "box.*").select(*boxes.columns)


def suppress_by_rounds(boxes: DataFrame, key: str = "item_id", limit: float = 0.3) -> DataFrame:
    """W15 for items of any number of boxes, by rounds of dominance over a grid.

    Two boxes that overlap by more than ``limit`` differ in width, and in height, by a factor below 1 / limit, and their corners lie
    apart by less than (1 - limit) of the larger one. So sizes fall into classes of that factor, and such boxes into the same or
    neighbouring classes and, in a grid made for the larger class, into the same or neighbouring cells. In each round, boxes that are better than the best
    undecided ones of each class around them stay, and what they overlap goes. Nothing is compared but cells' best boxes with
    each other and those that stay with what is around them, however crowded a cell is. There are as many rounds as the longest chain of cells
    of which each has a better box than the next; items of which few boxes are left are judged in a row. Boxes without an area overlap nothing and stay.
    """
    cols, factor = boxes.columns, 1 / limit
    flat = (F.col("width") <= 0) | (F.col("height") <= 0)
    rank = F.struct((-F.col("score")).alias("s"), "x", "y", "width", "height", F.col("_id").alias("i"))
    size = lambda c: F.floor(F.log(F.col(c).cast("double")) / math.log(factor)).cast("int")
    cell = lambda c, k: F.floor(F.col(c) / (F.pow(F.lit(factor), F.col(k) + 1) * (1 - limit) * 1.01)).cast("long")  # noqa: E731  room for rounding
    state = boxes.where(~flat).withColumns({"_w": size("width"), "_h": size("height")})
    state = saved(state.withColumn("_id", F.monotonically_increasing_id()), "boxes")
    place = [key, "gw", "gh", "cx", "cy"]

    def homes(df: DataFrame) -> DataFrame:
        """A row for each of the four grids that a box takes part in (its own classes and the next larger ones), with its cell."""
        up = lambda c: F.explode(F.array(F.col(c), F.col(c) + 1))
        return df.withColumn("gw", up("_w")).withColumn("gh", up("_h")).withColumns({"cx": cell("x", "gw"), "cy": cell("y", "gh")})

    def around(df: DataFrame) -> DataFrame:
        """The same for each of the nine cells around."""
        step = lambda: F.explode(F.array(*map(F.lit, (-1, 0, 1))))
        return homes(df).withColumn("dx", step()).withColumn("dy", step()).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy")

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of the same item and cell in the grid of the larger of their classes; a null item is one as well."""
        b = b.withColumnsRenamed({c: f"b{c}" for c in (*place, "_w", "_h")})
        larger = (F.greatest("_w", "b_w") == F.col("gw")) & (F.greatest("_h", "b_h") == F.col("gh"))
        return a.join(b, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in place], larger))

    done = boxes.where(flat).select(*cols)
    while True:
        sizes = saved(state.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n")), "left")
        few = sizes.where(F.col("n") <= LAST_BOXES).select("_k")
        same = F.col(key).eqNullSafe(F.col("_k"))
        done = done.unionByName(judge_in_a_row(state.join(few, same, "left_semi").select(*cols), key, limit))
        if sizes.where(F.col("n") > LAST_BOXES).isEmpty():
            return done
        state = state.join(few, same, "left_anti")
        best = homes(state).withColumn("rank", rank).groupBy(*place, "_w", "_h").agg(F.min("rank").alias("top"))
        best = saved(best, "best")
        first = best.where("gw = _w and gh = _h").select(F.col("top.i").alias("_id"))  # the best of its class in its cell
        first = state.join(first, "_id").withColumn("rank", rank)
        least = meet(around(first), best).groupBy("_id").agg(F.first("rank").alias("rank"), F.min("top").alias("least"))
        new = saved(state.join(least.where("least = rank").select("_id"), "_id"), "staying")
        done = done.unionByName(new.select(*cols))
        near = around(new).select(*place, "_w", "_h", F.struct("x", "y", "width", "height").alias("kept"), F.col("_id").alias("kept_id"))
        hit = meet(homes(state), near).where((F.col("_id") == F.col("kept_id")) | (G.iou(F.struct("x", "y", "width", "height"), F.col("kept")) > limit))
        state = saved(state.join(hit.select("_id").distinct(), "_id", "left_anti"), "undecided")


def union_share(items: DataFrame, width: int, height: int, key: str = "item_id") -> DataFrame:
    """(key, percent): share of the image that the union of the boxes in ``lines`` covers, clipped."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def area(lines):
            if width <= 0 or height <= 0:
                return np.float32(0)
            cuts = sorted({min(max(v, 0), width) for b in lines for v in (b["x"], b["x"] + b["width"])})
            total = 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                spans = sorted((max(c["y"], 0), min(c["y"] + c["height"], height)) for c in lines if c["x"] <= a and c["x"] + c["width"] >= b)
                top, length = 0, 0
                for lo, hi in spans:
                    length += max(0, hi - max(lo, top))
                    top = max(top, hi)
                total += (b - a) * length
            return np.float32(100 * total / (width * height))

        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "percent": [area(x) if x is not None else np.float32(0) for x in pdf["lines"]]})

    src = items.select(F.col(key).alias("key"), "lines")
    return src.mapInPandas(run, f"key {src.schema['key'].dataType.simpleString()}, percent float").withColumnRenamed("key", key)


def skin_share(images: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, inside, outside) percent of skin pixels in and around ``box``.

    ``image`` is the struct of Spark's image source (bytes in BGR order). Box coordinates and sizes are cut to whole
    numbers, none below 0, and the box is clipped to the image; 0 without pixels, image or box. A pixel is skin by the usual RGB and YCbCr bounds together.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for key_value, img, box in zip(pdf["key"], pdf["image"], pdf["box"], strict=True):
                if img is None or not img["height"] or not img["width"]:
                    rows.append((key_value, np.float32(0), np.float32(0)))
                    continue
                px = np.frombuffer(img["data"], np.uint8).reshape(img["height"], img["width"], -1)[:, :, :3].astype(np.float32)
                b, g, r = px[:, :, 0], px[:, :, 1], px[:, :, 2]
                # fixed values: bounds and weights of the two rules
                cb, cr = 128 - 0.169 * r - 0.331 * g + 0.5 * b, 128 + 0.5 * r - 0.419 * g - 0.081 * b
                rgb = (r > 95) & (g > 40) & (b > 20) & (px.max(axis=2) - px.min(axis=2) > 15) & (np.abs(r - g) > 15) & (r > g) & (r > b)
                skin = rgb & (cb >= 77) & (cb <= 127) & (cr >= 133) & (cr <= 173)
                mask = np.zeros(skin.shape, bool)
                x, y, w, h = (max(0, int(box[c])) if box is not None else 0 for c in ("x", "y", "width", "height"))
                mask[y : y + h, x : x + w] = True
                share = lambda m: np.float32(100 * skin[m].mean()) if m.any() else np.float32(0)
                rows.append((key_value, share(mask), share(~mask)))
            yield pd.DataFrame(rows, columns=["key", "inside", "outside"])

    src = images.select(F.col(key).alias("key"), "image", "box")
    return src.mapInPandas(run, f"key {src.schema['key'].dataType.simpleString()}, inside float, outside float").withColumnRenamed("key", key)
