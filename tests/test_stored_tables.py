"""Tables kept up in pieces: fingerprints by file, merges by bucket, pages by file bounds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.operators import buckets, fingerprints, pages, store

T0 = datetime(2024, 1, 1)
SCORES = "item_id string, score double, model_version string"


def scores(spark, ids, score=0.5, version="m"):
    return spark.createDataFrame([(f"i{k}", score, version) for k in ids], SCORES)


# ---- fingerprints --------------------------------------------------------
@pytest.mark.parametrize("hashed", [fingerprints.row_hash, fingerprints.portable_hash])
def test_token_follows_appends_and_deletes(spark, tmp_path, hashed):
    path, known = f"file://{tmp_path}/t", f"file://{tmp_path}/known"
    shape = StructType.fromDDL(SCORES)
    full = lambda: spark.read.schema(shape).parquet(path).agg(F.count("*"), F.sum(hashed(shape.names).cast("decimal(38,0)"))).first()
    scores(spark, range(40)).repartition(4).write.parquet(path)
    first = fingerprints.refresh(spark, path, shape, known, hashed)
    assert (first["n"], first["token"], first["added"], first["removed"]) == (*full(), 4, 0)
    assert fingerprints.refresh(spark, path, shape, known, hashed) == first | {"added": 0}
    scores(spark, range(40, 50)).coalesce(1).write.mode("append").parquet(path)
    again = fingerprints.refresh(spark, path, shape, known, hashed)
    assert (again["n"], again["token"], again["added"], again["removed"]) == (*full(), 1, 0)
    one = next(p for p in sorted((tmp_path / "t").glob("part-*")) if p.suffix == ".parquet")
    one.unlink()
    scores(spark, [7], 0.9).coalesce(1).write.mode("append").parquet(path)
    last = fingerprints.refresh(spark, path, shape, known, hashed)
    assert (last["n"], last["token"], last["added"], last["removed"]) == (*full(), 1, 1)


def test_only_new_files_are_scanned(spark, tmp_path, monkeypatch):
    path, known, shape = f"file://{tmp_path}/t", f"file://{tmp_path}/known", StructType.fromDDL(SCORES)
    scanned, tokens = [], fingerprints.file_tokens
    monkeypatch.setattr(fingerprints, "file_tokens", lambda df, h: scanned.append(sorted(df.inputFiles())) or tokens(df, h))
    scores(spark, range(9)).repartition(3).write.parquet(path)
    fingerprints.refresh(spark, path, shape, known)
    old = {p.name for p in (tmp_path / "t").glob("*.parquet")}
    scores(spark, range(9, 12)).coalesce(1).write.mode("append").parquet(path)
    fingerprints.refresh(spark, path, shape, known)
    fingerprints.refresh(spark, path, shape, known)
    assert [len(x) for x in scanned] == [3, 1] and scanned[1][0].rsplit("/", 1)[-1] not in old


def test_fingerprints_of_partitioned_and_null_rows(spark, tmp_path):
    path, shape = f"file://{tmp_path}/t", StructType.fromDDL("item_id string, score double, day int")
    spark.createDataFrame([("a", None, 1), (None, 0.5, 1), ("a", 0.25, 2), ("a", 0.25, 2)], shape).write.partitionBy("day").parquet(path)
    got = fingerprints.refresh(spark, path, shape, f"file://{tmp_path}/known")
    want = store.snapshot_token(spark.read.schema(shape).parquet(path)).first()
    assert (got["n"], got["token"]) == tuple(want)
    h = lambda *rows: [r[0] for r in spark.createDataFrame(list(rows), "a string, b string").select(fingerprints.portable_hash(["a", "b"])).collect()]
    assert len(set(h(("x", "y"), ("x1:y", ""), ("x", None), (None, "x"), ("", "x"), ("xy", "")))) == 6


def test_gate_publishes_when_an_input_changed(spark, tmp_path):
    shape, calls = StructType.fromDDL(SCORES), []
    for name in ("a", "b"):
        scores(spark, range(5)).write.parquet(f"file://{tmp_path}/{name}")
    tables = {n: (f"file://{tmp_path}/{n}", shape) for n in ("a", "b")}
    run = lambda publish=lambda: calls.append(1), **how: fingerprints.gate(spark, tables, f"file://{tmp_path}/gate", publish, **how)
    assert run() and not run() and run(has_lists=False)
    scores(spark, [99]).write.mode("append").parquet(f"file://{tmp_path}/b")

    def broken():
        raise OSError("no store")

    with pytest.raises(OSError):
        run(broken)
    assert run() and not run() and len(calls) == 3  # what failed to be published is tried again


# ---- buckets -------------------------------------------------------------
def rows(df):
    return {r.item_id: (r.score, r.model_version) for r in df.collect()}


def keys_in(spark, wanted, n=64):
    """Keys that fall into the wanted buckets."""
    found = scores(spark, range(3000)).withColumn("b", buckets.bucket_of("item_id", n)).where(F.col("b").isin(wanted)).collect()
    return [r.item_id for r in found]


def test_merge_rewrites_the_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    buckets.create(scores(spark, range(1000)), path, "item_id")
    keys = keys_in(spark, [3, 17, 40])
    old, new = [k for k in keys if int(k[1:]) < 1000], [k for k in keys if int(k[1:]) >= 1000]
    up = spark.createDataFrame([(k, 0.9, "n") for k in (*old[2:], *new[:5])], SCORES)
    gone = spark.createDataFrame([(k,) for k in old[:2]], "item_id string")
    before = buckets.read(spark, path)
    assert buckets.merge(spark, path, "b1", up, gone) == [3, 17, 40]
    made = sorted(p.name for p in (tmp_path / "t/data").glob("generation=1-*/*"))
    assert made == ["bucket=17", "bucket=3", "bucket=40"]
    want = {f"i{k}": (0.5, "m") for k in range(1000)} | {k: (0.9, "n") for k in (*old[2:], *new[:5])}
    want = {k: v for k, v in want.items() if k not in old[:2]}
    assert rows(buckets.read(spark, path)) == want
    assert rows(before) == rows(buckets.read(spark, path, 0)) == {f"i{k}": (0.5, "m") for k in range(1000)}
    assert buckets.merge(spark, path, "b1", up, gone) == [] and rows(buckets.read(spark, path)) == want  # replayed
    assert rows(buckets.lookup(spark, path, [old[0], old[3], new[0], "none"])) == {k: want[k] for k in (old[3], new[0])}
    plan = buckets.lookup(spark, path, [old[3]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_merge_that_breaks_off_leaves_the_old_rows_and_is_done_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    buckets.create(scores(spark, range(200)), path, "item_id", 8)
    up = scores(spark, range(100, 300), 0.7, "n")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "_point", broken)
        with pytest.raises(OSError):
            buckets.merge(spark, path, "b", up)
    assert rows(buckets.read(spark, path)) == rows(scores(spark, range(200)))
    assert buckets.merge(spark, path, "b", up) == list(range(8))
    want = rows(scores(spark, range(100))) | rows(up)
    assert rows(buckets.read(spark, path)) == want
    buckets.merge(spark, path, "c", None, scores(spark, range(5)))
    buckets.merge(spark, path, "d", scores(spark, [1]), None)
    assert buckets.vacuum(spark, path, 2) and rows(buckets.read(spark, path)) == {k: v for k, v in want.items() if k not in {"i0", "i2", "i3", "i4"}} | {"i1": (0.5, "m")}
    assert buckets.merge(spark, path, "empty", up.limit(0), None) == [] and buckets.vacuum(spark, path, 2) == []


# ---- pages ---------------------------------------------------------------
def walk(spark, path, limit):
    out, cursor, most = [], None, 0
    while True:
        shown, cursor, files = pages.page(spark, path, cursor, limit)
        out.append([(r.item_id, r.discovered_at) for r in shown.collect()])
        most = max(most, len(files))
        if cursor is None:
            return out, most


@pytest.mark.parametrize("limit", [1, 7, 60, 1000])
def test_pages_are_those_of_a_sorted_table(spark, tmp_path, limit):
    r, path = random.Random(limit), f"file://{tmp_path}/p"
    shape = "item_id string, discovered_at timestamp"
    made = [(f"i{k}", T0 + timedelta(minutes=r.randrange(60))) for k in range(300)]  # many share a time
    pages.append(spark.createDataFrame(made[:200], shape), path, rows_per_file=9)
    pages.append(spark.createDataFrame(made[200:], shape), path, rows_per_file=9)
    df, cursor, want = spark.createDataFrame(made, shape), None, []
    while True:
        shown, more = store.page(df, cursor, limit)
        want.append([tuple(x) for x in shown.collect()])
        more = more.collect()
        if not more:
            break
        cursor = F.lit(more[0][0])
    got, _ = walk(spark, path, limit)
    assert got == want
    assert [tuple(x) for x in pages.newest_ids(spark, path, int((T0 + timedelta(minutes=40)).timestamp() * 1e6)).collect()] == [tuple(x) for x in store.newest_ids(df, F.lit(T0 + timedelta(minutes=40))).collect()]


def test_a_page_reads_few_files(spark, tmp_path):
    path, shape = f"file://{tmp_path}/p", "item_id string, discovered_at timestamp"
    pages.append(spark.createDataFrame([(f"i{k}", T0 + timedelta(seconds=k)) for k in range(2000)], shape), path, rows_per_file=20)
    assert pages.bounds(spark, path).count() >= 100
    _, cursor, files = pages.page(spark, path, None, 30)
    assert len(files) <= 4
    shown, _, files = pages.page(spark, path, cursor, 30)
    assert len(files) <= 5 and shown.first().item_id == "i1969"
    assert pages.page(spark, path, int(T0.timestamp() * 1e6), 5)[0].count() == 0
    with pytest.raises(Exception, match="no discovered_at"):
        pages.append(spark.createDataFrame([("x", None)], shape), path)
