"""The pipeline's rows against brute force, stage by stage, and on nasty rows."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from sluice.llm.common import materialise, table  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [table(spark, sf_dir, "documents")]
    for _, stage in cp.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), "test-stage"))
    return out


def test_stages_keep_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["language ID", "MinHash near-dedup", "substring dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    assert all(set(s.columns) == set(cp.COLUMNS) for s in stages[:-1])


def test_stages_do_what_brute_force_says(stages):
    docs, judged, alone, cut, mixed, tokens = stages
    assert judged.count() >= 0.99 * docs.count()
    rows = [(r.doc_id, r.text) for r in judged.collect()]
    keep = {i for i, (_, c) in brute.components(rows).items() if c == i}
    assert {r.doc_id for r in alone.collect()} == keep
    rows = [(r.doc_id, r.text) for r in alone.collect()]
    got = sorted([(r.doc_id, brute.sha(" ".join(brute.words(r.text)))) for r in cut.collect()], key=repr)
    assert got == sorted([(i, s) for i, _, _, s in brute.substrings(rows)], key=repr)
    sizes = [(r.source, len(brute.words(r.text))) for r in cut.collect()]
    want, taken = brute.targets(sizes), {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    longest = max(n for _, n in sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= longest for s in want)
    assert tokens.count() == mixed.count() and tokens.where("not round_trip").count() == 0


def test_stages_on_nasty_and_empty_tables(spark, sf_dir):
    nasty = [(1, None, None, None, None), (None, "one two three", "en", "a", 13), (2, "", "en", "a", 0), (3, "one two three", "en", "b", 13), (3, "one two three", "en", "b", 13), (4, "und so weiter und so fort", None, None, 25)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (nasty, []):
        docs = spark.createDataFrame(rows, schema).withColumn("key", F.lit("clash")).withColumn("copies", F.lit(1))
        for _, stage in cp.STAGES:
            docs = materialise(stage(spark, docs, sf_dir), "test-nasty")
        assert docs.where("not round_trip").count() == 0


def test_repeated_rows_stay_once(spark, sf_dir):
    text = lambda a: " ".join(f"{a}{k}" for k in range(60))
    rows = [(1, text("a"), "en", "s", 1)] * 2 + [(None, text("b"), "en", "s", 1)] * 3 + [(2, text("c"), "en", "s", 1), (None, text("c"), "en", "s", 1)]
    rows += [(3, text("d"), "en", "s", 1), (3, text("e"), "en", "s", 1), (4, text("e") + " end", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    alone = materialise(cp.drop_near_duplicates(spark, docs, sf_dir), "test-alone")
    want = [(1, text("a")), (None, text("b")), (2, text("c")), (3, text("d")), (3, text("e"))]
    assert sorted([(r.doc_id, r.text) for r in alone.collect()], key=repr) == sorted(want, key=repr)
    cut = cp.remove_passages(spark, alone, sf_dir)
    assert sorted([(r.doc_id, r.text) for r in cut.collect()], key=repr) == sorted(want, key=repr)


def test_unlearned_languages_and_scripts_go(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null").withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    odd = [(-1, "το σπίτι και ο κήπος του βασιλιά " * 20, None, "s", 1), (-2, "漢字 仮名 文章 " * 20, None, "s", 1)]
    kept = cp.identify_language(spark, docs.select(*cp.COLUMNS).union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")), sf_dir)
    native = docs.where("lang is not null").count()
    assert kept.where("lang is not null and doc_id < 0").count() == 0
    ids = {r.doc_id for r in kept.collect()}
    foreign = {r.doc_id for r in docs.where("lang is null").collect()}
    assert foreign and not ids & foreign and len(ids - foreign) >= 0.99 * native


def test_very_long_texts_go_through(spark, sf_dir):
    some = [r.text for r in table(spark, sf_dir, "documents").where("lang = 'en' and length(text) > 500").limit(40).collect()]
    long = " ".join(f"{t} w{k}" for k, t in enumerate(some * 8))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + " more", "en", "t", 1), *[(10 + k, t, "en", "s", 1) for k, t in enumerate(some)]], schema)
    stages = [docs]
    for _, stage in cp.STAGES:
        stages.append(materialise(stage(spark, stages[-1], sf_dir), "test-long"))
    kept = {r.doc_id for r in stages[2].collect()}
    assert 1 in kept and 2 not in kept
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert sorted((r.doc_id, brute.sha(" ".join(brute.words(r.text)))) for r in stages[3].collect()) == sorted((i, s) for i, _, _, s in brute.substrings(rows))
    assert stages[5].where("not round_trip").count() == 0
