"""Model evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import scoring as S
from sluice.operators.shared import saved
from sluice.operators.views import number_in_pieces, small


def confusion(df: DataFrame, score: str, label: str, threshold: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Tp, fp, tn, fn of score >= threshold against the boolean label."""
    hit = S.is_positive(F.col(score), threshold)
    return df.groupBy(*by).agg(F.count_if(hit & F.col(label)).alias("tp"), F.count_if(hit & ~F.col(label)).alias("fp"), F.count_if(~hit & ~F.col(label)).alias("tn"), F.count_if(~hit & F.col(label)).alias("fn"))


def prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of a confusion row; null when undefined, F1 0 when both are 0."""
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    p, r = ratio("tp", "fp"), ratio("tp", "fn")
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))
    return df.withColumns({"precision": p, "recall": r, "f1": f1})


def score_steps(df: DataFrame, score: str, label: str, pieces: int = 64) -> DataFrame:
    """(score, pos, neg, pos_above, neg_above, all_pos, all_neg): one row per distinct score, with the counts above it.

    Rows without a score or a label take no part; NaN is refused, as it has no place among scores. Rows are first summed
    per distinct score, and that table is saved, since running sums inside score ranges and the ranges' offsets both
    read it; no window holds all rows.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    value = F.when(F.isnan(F.col(score)), F.raise_error(F.lit("a score is NaN")).cast(df.schema[score].dataType)).otherwise(F.col(score))
    per = known.groupBy(value.alias("score")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    per = saved(per.withColumn("piece", F.floor(F.col("score").cast("double") * pieces).cast("int")), "score-steps")
    sums = per.groupBy("piece").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    every = Window.partitionBy()
    sums = sums.select("piece", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.sum("p").over(every).alias("all_pos"), F.sum("n").over(every).alias("all_neg"))
    inside = Window.partitionBy("piece").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    return per.withColumns({"p": run("pos"), "n": run("neg")}).join(F.broadcast(sums), "piece").select("score", "pos", "neg", (F.col("p") + F.col("p0")).alias("pos_above"), (F.col("n") + F.col("n0")).alias("neg_above"), "all_pos", "all_neg")


def auc_of_steps(steps: DataFrame) -> DataFrame:
    area = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return steps.agg((area / F.nullif(F.max(F.col("all_pos") * F.col("all_neg")), F.lit(0))).alias("roc_auc"))


def pin_of_steps(steps: DataFrame, target: float) -> DataFrame:
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    s = steps.select("score", (tp / (tp + fp)).alias("precision"), (tp / F.nullif("all_pos", F.lit(0))).alias("recall")).where(F.col("precision") >= target)
    best = F.max_by(F.struct(F.col("score").alias("threshold"), "recall", "precision"), F.struct("recall", -F.col("score")))
    return s.agg(best.alias("b")).where("b is not null").select("b.*")


def confusion_of_steps(steps: DataFrame, threshold: Column) -> DataFrame:
    hit = S.is_positive(F.col("score"), threshold)
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    return steps.agg(total("pos", hit).alias("tp"), total("neg", hit).alias("fp"), total("neg", ~hit).alias("tn"), total("pos", ~hit).alias("fn"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Probability that a positive outscores a negative, ties half; null with one class."""
    return auc_of_steps(score_steps(df, score, label))


def pin_at_precision(df: DataFrame, score: str, label: str, target: float) -> DataFrame:
    """The distinct score of best recall among those with precision >= target, ties to the lowest; no row if none."""
    return pin_of_steps(score_steps(df, score, label), target)


def first_by_hash(df: DataFrame, id_col: str, band: str, seed: int, quota: Column) -> DataFrame:
    """Adds _first: whether a row is among the first of its band in the order of md5(seed, id). ``quota`` says how many
    those are, from _n (rows of the band) and _total (all rows). Rows that repeat the last id taken are taken as well.

    The table is read three times: rows are counted per band and range of the hash (a 4096th), the rows of the one range of
    each band that holds its last row are put in order, and all are compared with the last rows, one per band.
    So no task holds a band and the rows aren't shuffled.
    """
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    rows = df.withColumn("_k", key).withColumn("_r", F.substring("_k", 1, 3))
    per = saved(rows.groupBy(F.col(band).alias("_b"), "_r").agg(F.count("*").alias("_c")), "hash-ranges")  # as many rows as bands times ranges
    sizes = per.groupBy("_b").agg(F.sum("_c").alias("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy()))  # one row per band
    sizes = saved(sizes.select("_b", quota.alias("_q")), "quotas")
    before = F.sum("_c").over(Window.partitionBy("_b").orderBy("_r")) - F.col("_c")
    ranges = per.withColumn("_before", before).join(sizes.withColumnRenamed("_b", "_s"), F.col("_b").eqNullSafe(F.col("_s")))
    ranges = ranges.where("_before < _q and _q <= _before + _c").select("_b", F.col("_r").alias("_at"), (F.col("_q") - F.col("_before")).alias("_left"))
    same = F.col(band).eqNullSafe(F.col("_b"))
    near = rows.join(ranges, same & F.col("_r").eqNullSafe(F.col("_at")))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_k", id_col))
    last = near.withColumn("_place", place).where("_place = _left").select(F.col("_b").alias("_s"), F.struct(F.col("_k"), F.col(id_col).alias("_i")).alias("_last"))
    cuts = saved(sizes.join(last, F.col("_b").eqNullSafe(F.col("_s")), "left").select("_b", "_last", (F.col("_q") > 0).alias("_some")), "cuts")
    rows = rows.drop("_r").join(small(cuts), same)  # counted in a written table of a row per band
    first = F.col("_some") & F.coalesce(F.struct(F.col("_k"), F.col(id_col).alias("_i")) <= F.col("_last"), F.lit(False))
    return rows.withColumn("_first", first).drop("_k", "_b", "_last", "_some")


def stratified_split(df: DataFrame, id_col: str, band: str, ratio: float, seed: int) -> DataFrame:
    """Adds side: floor((1 - ratio) * n) rows of each band are test, in the order of md5(seed, id).

    Integer floor and a hash order stand in for a random shuffle: same input, same split.
    """
    test = F.floor(F.col("_n") * round((1 - ratio) * 1000) / 1000)
    rows = first_by_hash(df, id_col, band, seed, test)
    return rows.withColumn("side", F.when(F.col("_first"), "test").otherwise("train")).drop("_first")


def stratified_sample(df: DataFrame, id_col: str, band: str, n: int, seed: int) -> DataFrame:
    """round(n * band / all) rows of each band, one at least and all at most, by hash order; none if n is 0."""
    if n <= 0:
        return df.limit(0)
    quota = F.least(F.greatest(F.round(F.lit(n) * F.col("_n") / F.col("_total")), F.lit(1)), F.col("_n"))
    return first_by_hash(df, id_col, band, seed, quota).where("_first").drop("_first")


def strict_join(ids_df: DataFrame, facts: DataFrame, on: str, flag: str) -> DataFrame:
    """Every id must have a row in ``facts``, else an error; ``ordinal`` keeps the input order."""
    rows = ids_df.join(facts, on, "left")
    ok = F.when(F.col(flag).isNull(), F.raise_error(F.concat(F.lit("nothing is known of "), F.col(on).cast("string"))).cast("boolean")).otherwise(True)
    return rows.where(ok)


def not_found(predictions: DataFrame, truth: DataFrame, on: str) -> DataFrame:
    """Number of predictions without ground truth."""
    return predictions.join(truth.select(on), on, "left_anti").agg(F.count("*").alias("not_found"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost; a model without a price is an error."""
    rows = usage.join(small(prices), "model", "left")
    price = F.when(F.col("price_in").isNull(), F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("decimal(12,6)")).otherwise(F.col("price_in"))
    return rows.withColumn("cost", S.cost(F.col("tokens_in"), F.col("tokens_out"), price, F.col("price_out"))).drop("price_in", "price_out")


def cost_by_model(costed: DataFrame) -> DataFrame:
    """Items, tokens, total, min, max and mean cost per model."""
    r = lambda c: S.round_cost(c).cast("decimal(20,4)")
    return costed.groupBy("model").agg(F.count("*").alias("items"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), r(F.sum("cost")).alias("total"), r(F.min("cost")).alias("least"), r(F.max("cost")).alias("most"), (F.sum("cost").cast("double") / F.count("*")).alias("mean"))


def best_run(runs: DataFrame, metric: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The run of the best metric; nulls are skipped, the first run wins ties."""
    rows = runs.withColumn("_m", metric).where("_m is not null")
    order = F.struct(F.col("_m"), (-F.unix_micros(F.col("run_at").cast("timestamp"))).alias("t"), F.col("run_id").alias("r"))
    cols = [c for c in runs.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*cols), order).alias("best")).where("best is not null").select(*by, "best.*")


def capture_split(reviews: DataFrame, id_col: str, band: str, ratio: float, seed: int, captured_at: Column) -> DataFrame:
    """(split_id, seed, captured_at, side, band, ordinal, id) in long form, without arrays over all ids; ordinal
    counts a side's items of a band in the order of the split's hash.

    The id of the split is an md5 over seed, time and an order-free digest of each side.
    """
    rows = saved(stratified_split(reviews.select(id_col, band), id_col, band, ratio, seed), "split")  # named and numbered from here
    digest = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.xxhash64(id_col).cast("decimal(20,0)"))), F.lit(0)).cast("string")
    name = rows.agg(F.md5(F.concat_ws("|", F.lit(str(seed)), F.unix_micros(captured_at).cast("string"), F.count_if(F.col("side") == "train").cast("string"), digest("train"), digest("test"))).alias("split_id"))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    rows = rows.withColumns({"_k": key, "_part": F.concat_ws("|", "side", F.col(band).cast("string"))})
    rows = number_in_pieces(rows, "_part", F.substring("_k", 1, 3), [F.asc("_k"), F.asc(id_col)], "ordinal")
    return rows.crossJoin(F.broadcast(name)).select("split_id", F.lit(seed).alias("seed"), captured_at.alias("captured_at"), "side", band, "ordinal", id_col)  # one row joined on


def score_items(df: DataFrame, scorer: Callable, retries: int = 3, id_col: str = "item_id", payload: str = "payload", calls: int = 1, tasks: int | None = None, wait: float = 0.0, longest: float = 30.0) -> DataFrame:
    """(id, score, outcome, tokens_in, tokens_out, error) by a callable payload -> (answer, in, out).

    Each task has up to ``calls`` calls in flight (the callable then runs in threads); with ``tasks`` the rows are dealt into that many
    tasks, so the whole job has at most ``tasks * calls``. A failed call is tried again after a wait that doubles
    each time, from ``wait`` up to ``longest`` seconds; after the last try the score is 0, the outcome ``fallback`` and ``error`` says why.
    Rows come out in the order they went in and carry ids, so a task that Spark repeats leads to the same merge.
    """

    def attempt(value):
        import time

        error = "no try was made"
        for k in range(retries):
            try:
                answer, given, got = scorer(value)
                return float(answer), "scored" if k == 0 else "retried", given, got, None
            except (OSError, TimeoutError, ValueError) as e:
                error = type(e).__name__
                if k + 1 < retries and wait > 0:
                    time.sleep(min(longest, wait * 2**k))
        return 0.0, "fallback", 0, 0, error

    def run(batches: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        with ThreadPoolExecutor(max(1, calls)) as pool:
            for pdf in batches:
                done = list(pool.map(attempt, pdf["payload"]))  # in the order of the rows, whichever call ends first
                rows = [(key, *one) for key, one in zip(pdf["id"], done, strict=True)]
                yield pd.DataFrame(rows, columns=["id", "score", "outcome", "tokens_in", "tokens_out", "error"])

    src = df.select(F.col(id_col).alias("id"), F.col(payload).alias("payload"))
    if tasks is not None:
        src = src.repartition(tasks)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, score float, outcome string, tokens_in long, tokens_out long, error string").withColumnRenamed("id", id_col)


def evaluate_run(scored: DataFrame, threshold: float, target: float = 0.8) -> DataFrame:
    """One row: confusion, precision, recall, F1, AUC and the pinned threshold, all from one table of score steps.

    Items without a score or a label don't count.
    """
    steps = saved(score_steps(scored, "score", "positive"), "steps")
    base = prf(confusion_of_steps(steps, F.lit(threshold)))
    pinned = pin_of_steps(steps, target).select(F.struct("threshold", "recall").alias("pinned"))
    one = pinned.agg(F.first("pinned").alias("pinned"))
    return base.crossJoin(auc_of_steps(steps)).crossJoin(one)  # one row each


def train_select(candidates: DataFrame, baseline_recall: float, tolerance: float = 0.01) -> DataFrame:
    """The candidate of best F1 (the first wins ties) and whether the gate accepts it.

    ``candidates`` has (candidate, iteration, f1, pinned_recall).
    """
    best = candidates.where("f1 is not null").agg(F.max_by(F.struct("candidate", "iteration", "f1", "pinned_recall"), F.struct("f1", (-F.col("iteration")).alias("i"), F.col("candidate"))).alias("b")).select("b.*")
    return best.withColumn("accepted", S.accept(F.col("pinned_recall"), F.lit(baseline_recall), tolerance))


def train_loop(pool: DataFrame, test: DataFrame, scorers: list[Callable], per_iteration: int, threshold: float, seed: int, baseline_recall: float, target: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(iterations, result) of trying scorers one after the other.

    Iteration k scores a stratified sample of the pool (item_id, band, payload, positive), drawn with seed + k, with the k-th
    scorer and takes its F1 at the threshold. The best (the first wins ties, no F1 loses) scores the test set (the same columns),
    and its recall pinned at the target precision must pass the gate. ``scorers`` is the caller's list, one per prompt tried, so
    the loop runs over scorers and not over rows.
    """
    tried = None
    for k, scorer in enumerate(scorers, 1):
        sample = stratified_sample(pool, "item_id", "band", per_iteration, seed + k)
        scored = score_items(sample, scorer).join(sample.select("item_id", "positive"), "item_id")
        one = prf(confusion(scored, "score", "positive", F.lit(threshold))).select(F.lit(str(k)).alias("candidate"), F.lit(k).alias("iteration"), "f1")
        usage = scored.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.count_if(F.col("outcome") == "fallback").alias("fallbacks"))
        one = one.crossJoin(usage)  # one row each
        tried = one if tried is None else tried.unionByName(one)
    best = tried.where("f1 is not null").agg(F.max_by("iteration", F.struct("f1", -F.col("iteration"))).alias("k")).first()["k"] or 1  # one number
    final = score_items(test, scorers[best - 1]).join(test.select("item_id", "positive"), "item_id")
    result = evaluate_run(final, threshold, target).withColumn("iteration", F.lit(best))
    return tried, result.withColumn("accepted", F.coalesce(S.accept(F.col("pinned.recall"), F.lit(baseline_recall)), F.lit(False)))


def runs_of_model(runs: DataFrame, version: str) -> DataFrame:
    """The runs of a model, with their cost including training."""
    total = F.col("evaluation_cost") + F.coalesce("training_cost", F.lit(0).cast("decimal(38,12)"))
    return runs.where(F.col("model_version") == version).withColumn("total_cost", total)


def evaluate_pruner(verdicts: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion of rejections against truth, where band Low is what should be rejected.

    ``verdicts`` has (item_id, reasons), ``truth`` (item_id, band); verdicts without truth are only counted.
    """
    rows = verdicts.join(truth, "item_id").select((F.size("reasons") > 0).cast("float").alias("score"), (F.col("band") == "Low").alias("positive"))
    return prf(confusion(rows, "score", "positive", F.lit(0.5))).crossJoin(not_found(verdicts, truth, "item_id"))  # one row each


def write_csv(one_row: DataFrame, path: str) -> None:
    """A confusion row as CSV with a header."""
    one_row.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def sample_costs(reviewed: DataFrame, usage: DataFrame, prices: DataFrame, n: int, seed: int) -> DataFrame:
    """Costs per model over a stratified sample of reviewed items; unreviewed ones don't count."""
    chosen = stratified_sample(reviewed, "item_id", "band", n, seed).select("item_id")
    return cost_by_model(usage_cost(usage.join(chosen, "item_id"), prices))


def promote(labels: DataFrame, registry: DataFrame, label: str, version: str) -> DataFrame:
    """(label, version) rows with one moved; a version that isn't registered is an error."""
    known = registry.where(F.col("model_version") == version).agg((F.count("*") > 0).alias("known"))
    ok = F.when(~F.col("known"), F.raise_error(F.lit(f"{version} isn't registered")).cast("string")).otherwise(F.lit(version))
    new = known.select(F.lit(label).alias("label"), ok.alias("version"))
    return labels.where(F.col("label") != label).select("label", "version").unionByName(new)
