"""Billing, operations, usage, traces, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import ids
from sluice.operators.shared import saved

COSTS = "data array<struct<start_time:bigint,end_time:bigint,results:array<struct<line_item:string,project_id:string,amount:struct<value:string>>>>>"
OPERATIONS = "data struct<viewer:struct<accounts:array<struct<r2OperationsAdaptiveGroups:array<struct<dimensions:struct<actionType:string,bucketName:string>,sum:struct<requests:bigint>>>>>>>, errors array<struct<message:string>>"
USAGE = "result struct<payloadSize:string,objectCount:string>"
ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:string>>>"
EVENT = f"struct<name:string,attributes:{ATTRIBUTES}>"
TRACE = f"batches array<struct<scopeSpans:array<struct<spans:array<struct<spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},events:array<{EVENT}>>>>>>>"
#: Children of one parent up to which they are put in order as one group; pieces that a larger one is cut into.
RUN_ROWS, RUN_PIECES = 100_000, 64
#: Items that a sketch keeps per level; 400 give a rank error below 1 %.
SKETCH_K = 400


def flatten_costs(df: DataFrame, value: str = "value") -> DataFrame:
    """(start, end, line_item, project, amount); missing names are empty, a bad amount is an error."""
    bucket = df.select(F.explode(F.from_json(value, COSTS)["data"]).alias("b"))
    r = bucket.select(F.timestamp_seconds("b.start_time").alias("start"), F.timestamp_seconds("b.end_time").alias("end"), F.explode("b.results").alias("r"))
    amount = F.col("r.amount.value").try_cast("double")
    checked = F.when(amount.isNull(), F.raise_error(F.concat(F.lit("bad amount: "), F.coalesce("r.amount.value", F.lit("none")))).cast("double")).otherwise(amount)
    return r.select("start", "end", F.coalesce("r.line_item", F.lit("")).alias("line_item"), F.coalesce("r.project_id", F.lit("")).alias("project"), checked.alias("amount"))


def flatten_operations(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(action, bucket, requests) and the columns to keep; an empty bucket is null; errors end the job, joined."""
    j = df.select(*keep, F.from_json(value, OPERATIONS).alias("j"))
    failed = F.size(F.coalesce("j.errors", F.array())) > 0
    accounts = F.when(failed, F.raise_error(F.array_join(F.transform("j.errors", lambda e: e["message"]), "; ")).cast("boolean")).otherwise(True)
    rows = j.where(accounts).select(*keep, F.explode("j.data.viewer.accounts").alias("a")).select(*keep, F.explode("a.r2OperationsAdaptiveGroups").alias("g"))
    return rows.select(F.col("g.dimensions.actionType").alias("action"), F.nullif("g.dimensions.bucketName", F.lit("")).alias("bucket"), F.col("g.sum.requests").alias("requests"), *keep)


def flatten_usage(df: DataFrame, bucket: str, value: str = "value") -> DataFrame:
    """(bucket, bytes, objects) from numbers or strings of digits."""
    u = F.from_json(value, USAGE)["result"]
    return df.select(F.col(bucket).alias("bucket"), u["payloadSize"].cast("bigint").alias("bytes"), u["objectCount"].cast("bigint").alias("objects"))


def typed_attributes(pairs: Column) -> Column:
    """Key to struct(text, whole, flag), of which one is set: the text, else the whole number if it is one, else the flag. Of pairs
    with one key the last known one counts; values of other kinds are left out."""
    value = lambda a: F.struct(a["value"]["stringValue"].alias("text"), F.when(a["value"]["stringValue"].isNull(), a["value"]["intValue"].try_cast("bigint")).alias("whole"), a["value"]["boolValue"].try_cast("boolean").alias("flag"))
    flag = lambda v: F.when(v["text"].isNull() & v["whole"].isNull(), v["flag"])
    entry = lambda a, v: F.struct(a["key"].alias("key"), F.struct(v["text"].alias("text"), v["whole"].alias("whole"), flag(v).alias("flag")).alias("value"))
    all_ = F.transform(F.coalesce(pairs, F.array().cast(ATTRIBUTES)), lambda a: entry(a, value(a)))
    known = F.filter(all_, lambda e: F.coalesce(e["value"]["text"].isNotNull() | e["value"]["whole"].isNotNull() | e["value"]["flag"].isNotNull(), F.lit(False)) & e["key"].isNotNull())
    last = F.filter(known, lambda e, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def flatten_spans(df: DataFrame, trace: str = "trace_id", value: str = "value") -> DataFrame:
    """One row per span; no negative durations, a time that is no number is 0, an empty parent is null.

    ``attributes`` are text, ``typed`` are the same as texts, numbers and flags, ``events`` the span's (name, attributes).
    """
    s = df.select(F.col(trace).alias("trace_id"), F.explode(F.from_json(value, TRACE)["batches"]).alias("b"))
    s = s.select("trace_id", F.explode("b.scopeSpans").alias("s")).select("trace_id", F.explode("s.spans").alias("s"))
    start, end = (F.coalesce(F.col(f"s.{c}").try_cast("bigint"), F.lit(0)) for c in ("startTimeUnixNano", "endTimeUnixNano"))
    rows = s.select(
        "trace_id", F.col("s.spanId").alias("span_id"), F.nullif("s.parentSpanId", F.lit("")).alias("parent_id"), F.col("s.name").alias("name"), start.alias("start_ns"), F.greatest(end - start, F.lit(0)).alias("duration_ns"),
        typed_attributes(F.col("s.attributes")).alias("typed"), F.transform(F.coalesce("s.events", F.array().cast(f"array<{EVENT}>")), lambda e: F.struct(e["name"].alias("name"), typed_attributes(e["attributes"]).alias("attributes"))).alias("events"),
    )
    text = F.transform_values("typed", lambda _, v: F.coalesce(v["text"], v["whole"].cast("string"), v["flag"].cast("string")))
    return rows.withColumn("attributes", text)


def price_list(df: DataFrame, models: DataFrame, value: str = "value") -> DataFrame:
    """(model, price_in, price_out) per million tokens of the models asked for; an error if one is missing."""
    prices = df.select(F.explode(F.from_json(value, "map<string,struct<input_cost_per_token:double,output_cost_per_token:double>>")).alias("model", "p"))
    rows = models.join(prices, "model", "left")
    ok = F.when(F.col("p.input_cost_per_token").isNull() | F.col("p.output_cost_per_token").isNull(), F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("boolean")).otherwise(True)
    per = lambda c: (F.col(c) * 1_000_000).cast("decimal(12,6)")
    return rows.where(ok).select("model", per("p.input_cost_per_token").alias("price_in"), per("p.output_cost_per_token").alias("price_out"))


def to_samples(df: DataFrame, metrics: dict[str, str], labels: list[str], ts: Column) -> DataFrame:
    """Long rows (metric, labels map, ts, value), one per metric and input row."""
    label = F.map_filter(F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()]))
    return df.select(label.alias("labels"), ts.alias("ts"), each.alias("m")).select("m.metric", "labels", "ts", "m.value")


def sync_costs(pages: DataFrame) -> DataFrame:
    """C14: billing pages as samples of daily spending by line item and project, stamped with the day's start."""
    return to_samples(flatten_costs(pages), {"spending_usd": "amount"}, ["line_item", "project"], F.col("start"))


def sync_operations(responses: DataFrame, middle: Column) -> DataFrame:
    """C14: operation counts as samples by action and bucket, stamped with the window's middle; what has no bucket goes."""
    rows = flatten_operations(responses.withColumn("_at", middle), keep=("_at",)).where("bucket is not null")
    return to_samples(rows, {"operations": "requests"}, ["action", "bucket"], F.col("_at"))


def sync_storage(usages: DataFrame, bucket: str, at: Column) -> DataFrame:
    """C14: stored bytes and objects as samples by bucket."""
    return to_samples(flatten_usage(usages, bucket), {"stored_bytes": "bytes", "stored_objects": "objects"}, ["bucket"], at)


def minute_windows(df: DataFrame, start: str, end: str) -> DataFrame:
    """(start, end, middle) of the one-minute windows over [start, end) of each row, the last one clipped."""
    rows = df.where(F.col(start) < F.col(end)).withColumn("w", F.explode(F.sequence(F.col(start), F.col(end) - F.expr("INTERVAL 1 MICROSECOND"), F.expr("INTERVAL 1 MINUTE"))))
    stop = F.least(F.col("w") + F.expr("INTERVAL 1 MINUTE"), F.col(end))
    return rows.select(F.col("w").alias("start"), stop.alias("end")).withColumn("middle", ids.window_middle(F.col("start").cast("timestamp"), F.col("end").cast("timestamp")))


def roots(spans: DataFrame) -> DataFrame:
    """Spans without a parent in their trace."""
    own = spans.select("trace_id", F.col("span_id").alias("parent_id"))
    return spans.join(own, ["trace_id", "parent_id"], "left_anti").select(*spans.columns)


def trace_duration(spans: DataFrame) -> DataFrame:
    """A27."""
    return roots(spans).groupBy("trace_id").agg(F.max("duration_ns").alias("duration_ns"))


def collapse_runs(df: DataFrame, partition: list[str], order: list[str], name: str, value: str, most: int = RUN_ROWS) -> DataFrame:
    """Runs of neighbours with the same name: (partition, run, name, n, total).

    A group of more than ``most`` rows is cut into pieces of the first order column. Runs are made inside the pieces, and the last
    of a piece goes on in the next if the names are the same, so the runs of pieces merge like sums and no task holds such a group.
    """
    sizes = df.groupBy(*partition).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    crowded = saved(sizes.select(*[F.col(c).alias(f"_{c}") for c in partition]), "crowded")  # seldom any
    if crowded.isEmpty():
        rows = df.withColumn("_piece", F.lit(0))
    else:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition])
        own = [f"_{c}" for c in partition]
        cuts = df.join(crowded, same).groupBy(*own).agg(F.percentile_approx(order[0], [k / RUN_PIECES for k in range(1, RUN_PIECES)], 10_000).alias("_cuts"))
        cuts = saved(cuts, "cuts")
        rows = df.join(cuts, same, "left").withColumn("_piece", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order[0]))), F.lit(0))).drop("_cuts", *own)
        rows = rows.withColumn("_piece", F.greatest("_piece", F.lit(0)))
    w = Window.partitionBy(*partition, "_piece").orderBy(*order)
    change = F.when(F.lag(name).over(w).eqNullSafe(F.col(name)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = rows.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*partition, "_piece", "_run", name).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    if crowded.isEmpty():
        return runs.withColumnRenamed("_run", "run").drop("_piece")
    runs = saved(runs, "runs")
    ends = runs.groupBy(*partition, "_piece").agg(F.max("_run").alias("_k"), F.min_by(F.struct(name), "_run").alias("_first"), F.max_by(F.struct(name), "_run").alias("_last"))
    pieces = Window.partitionBy(*partition).orderBy("_piece")  # as many rows as pieces
    ends = ends.withColumn("_joined", F.when(F.lag("_last").over(pieces).eqNullSafe(F.col("_first")) & (F.row_number().over(pieces) > 1), 1).otherwise(0))
    before = F.sum(F.col("_k") - F.col("_joined")).over(pieces) - F.col("_k")
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in partition], F.col("_piece").alias("_p"), before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition])
    merged = runs.join(ends, same & (F.col("_piece") == F.col("_p"))).withColumn("run", F.col("_before") + F.col("_run"))
    return merged.groupBy(*[merged[c] for c in partition], "run", name).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """The runs of each parent's children, with the trace's duration."""
    runs = collapse_runs(spans, ["trace_id", "parent_id"], ["start_ns", "span_id"], "name", "duration_ns")
    return runs.join(trace_duration(spans).withColumnRenamed("duration_ns", "trace_ns"), "trace_id", "left")


def histogram(df: DataFrame, value: str, bounds: list[float], by: tuple = ()) -> DataFrame:
    """Rows per bucket; ``le`` is the bucket's upper bound, null for what lies above all."""
    le = F.lit(None).cast("double")
    for b in sorted(bounds, reverse=True):
        le = F.when(F.col(value).cast("double") <= b, F.lit(float(b))).otherwise(le)
    return df.where(F.col(value).isNotNull()).groupBy(*by, le.alias("le")).agg(F.count("*").alias("n"))


def access_rollup(log: DataFrame) -> DataFrame:
    """Operations, bytes and time by operation, class, client, table and kind."""
    rows = log.withColumns({"table": ids.object_table(F.col("path")), "kind": ids.object_kind(F.col("path")), "class": F.when(F.col("operation").isin("put", "list", "copy"), "A").otherwise("B")})
    return rows.groupBy("operation", "class", "client", "table", "kind").agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"), F.sum("millis").alias("millis"))


def table_health(files: DataFrame, small_bytes: int = 1_000_000) -> DataFrame:
    """One row per table from (table, file, rows, bytes, indexed): sizes, quantiles, shares and flags."""
    out = files.groupBy("table").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("files"), F.count_if(F.col("bytes") < small_bytes).alias("small_files"),
        F.min("rows").alias("least"), F.max("rows").alias("most"), F.avg("rows").alias("mean"), F.percentile("rows", 0.5).alias("p50"), F.percentile("rows", 0.99).alias("p99"),
        (F.sum(F.when(F.col("indexed"), 0).otherwise(F.col("rows"))) * 100.0 / F.sum("rows")).alias("unindexed_percent"),
    )
    return out.withColumns({"many_small": F.col("small_files") > 10, "stale_index": F.col("unindexed_percent") > 10})


def file_sizes(df: DataFrame, table: str) -> DataFrame:
    """(table, file, rows, bytes) of a DataFrame read from files."""
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows")).withColumn("table", F.lit(table))


def size_sketches(files: DataFrame, by: tuple[str, ...] = ("table",)) -> DataFrame:
    """(by, sketch, files, rows, least, most) of (table, file, rows): what can be stored and merged instead of all sizes."""
    return files.groupBy(*by).agg(F.kll_sketch_agg_bigint("rows", SKETCH_K).alias("sketch"), F.count("rows").alias("files"), F.sum("rows").alias("rows"), F.min("rows").alias("least"), F.max("rows").alias("most"))


def merge_sketches(sketches: DataFrame, by: tuple[str, ...] = ("table",)) -> DataFrame:
    """Sketches of parts (of files, days, tables) put together; the exact columns stay exact."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("sketch"), F.sum("files").alias("files"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))


def sketched_sizes(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """Sizes per table with the quantiles p50, p99, ... of its sketch; mean, least and most are exact.

    With 400 items a sketch's rank error is below 1 % in 99 of 100 cases, so p50 lies between the true p49 and p51.
    """
    cols = {f"p{round(100 * q)}": F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)) for q in quantiles}
    return sketches.withColumns(cols).withColumn("mean", F.col("rows") / F.col("files")).drop("sketch")


def running_totals(df: DataFrame, at: str, values: tuple[str, ...], by: tuple[str, ...] = (), span: int = 10_000) -> DataFrame:
    """Adds total_<value>: the running sum over ``at`` (a whole number) within ``by``.

    Sums are taken inside spans of ``at`` and the sums of the spans before are added, so no task holds a whole history. ``df`` is read twice.
    """
    rows = df.withColumn("_span", F.floor(F.col(at) / span))
    sums = rows.groupBy(*by, "_span").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    spans = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row per span
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_span").alias("_s"), *[F.coalesce(F.sum(f"_{v}").over(spans), F.lit(0)).alias(f"_before_{v}") for v in values])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_span").eqNullSafe(F.col("_s")))
    inside = Window.partitionBy(*by, "_span").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, same).withColumns({f"total_{v}": F.sum(v).over(inside) + F.col(f"_before_{v}") for v in values})
    return rows.select(*df.columns, *[f"total_{v}" for v in values])


def tick_totals(ticks: DataFrame) -> DataFrame:
    """Running totals of scored, unscored and errors over ticks (one row per tick, numbered)."""
    return running_totals(ticks, "tick", ("scored", "unscored", "errors"))


def errors_by_reason(outcomes: DataFrame) -> DataFrame:
    """(tick, reason, n, total_n) of (tick, error), where error is null for what was scored: how often each reason
    ended a call in each tick, and up to it."""
    per = outcomes.where(F.col("error").isNotNull()).groupBy("tick", F.col("error").alias("reason")).agg(F.count("*").alias("n"))
    return running_totals(saved(per, "errors"), "tick", ("n",), ("reason",))


def query_log_report(log: DataFrame, slow_ms: int = 100) -> DataFrame:
    """Per label and table: queries, slow ones, full scans (fragments and no filter)."""
    rows = log.withColumn("_plan", ids.parse_plan(F.col("plan")))
    rows = rows.withColumns({"table": F.coalesce("_plan.table", F.lit("unknown")), "slow": F.col("elapsed_ms") > slow_ms, "full": ids.is_full_scan(F.col("_plan"))})
    return rows.groupBy("label", "table").agg(F.count("*").alias("queries"), F.count_if("slow").alias("slow"), F.count_if("full").alias("full_scans"), F.max("elapsed_ms").alias("longest_ms"))
