"""Registries as tables: models and their labels, price snapshots, evaluation splits and runs, thresholds, the blocklist."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import ids
from sluice.operators.store import insert_unique

MODELS = "model_version string, provider string, name string, prompt string, decision_threshold double"
LABELS = "label string, version string"
SPLITS = "split_id string, seed bigint, captured_at timestamp, side string, item_id string"
RUNS = (
    "run_id string, run_at timestamp, model_version string, split_id string, price_snapshot_id string, purpose string, precision double, recall double, f1 double, roc_auc double, "
    "pinned_threshold double, pinned_recall double, tp bigint, fp bigint, tn bigint, fn bigint, tokens_in bigint, tokens_out bigint, evaluation_cost decimal(38,12), training_tokens_in bigint, training_tokens_out bigint, training_cost decimal(38,12)"
)
#: The thresholds of the pruning rules, percentages from 0 to 100.
THRESHOLDS = ("min_face_area_pct", "max_face_area_pct", "min_face_skin_pct", "max_outside_face_skin_pct", "max_text_area_pct")
PRICES = "snapshot_id timestamp, source_url string, note string, model string, price_in decimal(12,6), price_out decimal(12,6)"


def _documents(spark: SparkSession, path: str) -> list[dict]:
    """The TOML documents of a small, hand-kept file; none if there is no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return []
    return [tomllib.loads(r["value"]) for r in spark.read.text(path, wholetext=True).collect()]  # one file kept by hand


def model_registry(models: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models, labels) checked: a version that is there twice, a stored version that the fields don't give
    and a label of an unknown version are errors."""
    expected = ids.content_version(*[(c, F.col(c)) for c in ("provider", "name", "prompt", "decision_threshold")], scheme="v2:")
    wrong = F.col("model_version").startswith("v2:") & (F.col("model_version") != expected)
    ok = F.when(wrong, F.raise_error(F.concat(F.lit("version mismatch: "), F.col("model_version"))).cast("boolean")).otherwise(True)
    models = insert_unique(models.limit(0), models.where(ok), "model_version")
    known = models.select(F.col("model_version").alias("version"), F.lit(True).alias("known"))
    rows = labels.join(known, "version", "left")
    ok = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("label of an unknown version: "), F.col("version"))).cast("boolean")).otherwise(True)
    return models, rows.where(ok).select("label", "version")


def load_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The model registry of a TOML file, empty if there is none: tables ``models`` (a row each) and ``labels``."""
    docs = _documents(spark, path)
    columns = [c.split()[0] for c in MODELS.split(", ")]
    models = [tuple(m.get(c) for c in columns) for d in docs for m in d.get("models", [])]
    labels = [(k, v) for d in docs for k, v in d.get("labels", {}).items()]
    return model_registry(spark.createDataFrame(models, MODELS), spark.createDataFrame(labels, LABELS))


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation splits of a TOML file in long form, a row per item; a split id that is there twice is an error."""
    docs = [x for d in _documents(spark, path) for x in d.get("splits", [])]
    heads = spark.createDataFrame([(x["split_id"],) for x in docs], "split_id string")
    rows = [(x["split_id"], x["seed"], x["captured_at"], side, i) for x in docs for side in ("train", "test") for i in x.get(side, [])]
    return insert_unique(heads.limit(0), heads, "split_id").join(spark.createDataFrame(rows, SPLITS), "split_id")


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price snapshots of a TOML file, a row per snapshot and model."""
    from decimal import Decimal

    docs = [x for d in _documents(spark, path) for x in d.get("snapshots", [])]
    money = lambda v: Decimal(str(v))
    rows = [(x["snapshot_id"], x.get("source_url"), x.get("note"), m, money(p["input"]), money(p["output"])) for x in docs for m, p in x.get("prices", {}).items()]
    return spark.createDataFrame(rows, PRICES)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """The log of evaluation runs of a TOML file, a row per run, in the columns that ``best_run`` and ``runs_of_model`` take; empty if
    there is no file. A run id that is there twice is an error."""
    from datetime import datetime
    from decimal import Decimal

    def one(r: dict) -> tuple:
        e, c, used, trained = r["evaluation"], r["evaluation"]["confusion"], r["resources"], r.get("training", {})
        pinned, at = e.get("pinned_precision", {}), r["run_at"]
        money = lambda d: Decimal(str(d["cost_usd"])) if "cost_usd" in d else None
        return (
            r["run_id"], datetime.fromisoformat(at) if isinstance(at, str) else at, r["model_version"], r["split_id"], r["price_snapshot_id"], r.get("purpose"), e.get("precision"), e.get("recall"), e.get("f1"), e.get("roc_auc"),
            pinned.get("threshold"), pinned.get("recall"), c["true_pos"], c["false_pos"], c["true_neg"], c["false_neg"], used.get("input_tokens"), used.get("output_tokens"), money(used), trained.get("input_tokens"), trained.get("output_tokens"), money(trained),
        )

    runs = spark.createDataFrame([one(r) for d in _documents(spark, path) for r in d.get("runs", [])], RUNS)
    return insert_unique(runs.limit(0), runs, "run_id")


def write_runs(runs: DataFrame, path: str) -> None:
    """The log of runs as one Parquet file in the order of time, costs rounded to four places, for ``spark.read``; runs are few."""
    cost = lambda c: F.round(c, 4).cast("decimal(38,12)").alias(c)
    cols = [cost(c) if c.endswith("_cost") else F.col(c) for c in runs.columns]
    runs.select(*cols).orderBy("run_at", "run_id").coalesce(1).write.mode("overwrite").parquet(path)


def load_thresholds(spark: SparkSession, path: str) -> dict[str, float]:
    """The thresholds of the pruning rules from a TOML file; one that is missing, or no percentage, is an error."""
    found = {k: v for d in _documents(spark, path) for k, v in d.items()}
    for name in THRESHOLDS:
        if name not in found:
            raise ValueError(f"no threshold {name} in {path}")
        if not isinstance(found[name], (int, float)) or not 0 <= found[name] <= 100:
            raise ValueError(f"{name} is no percentage: {found[name]}")
    return {name: float(found[name]) for name in THRESHOLDS}


def load_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """(uri, reason) of a TOML file in the order of addresses; an address that isn't one of a record is an error."""
    rows = [(b["at_uri"], b["reason"]) for d in _documents(spark, path) for b in d.get("blocked", [])]
    df = spark.createDataFrame(rows, "uri string, reason string")
    ok = F.when(ids.parse_group(F.col("uri")).isNull(), F.raise_error(F.concat(F.lit("bad address: "), F.col("uri"))).cast("string")).otherwise(F.col("uri"))
    return df.select(ok.alias("uri"), "reason").orderBy("uri")
