"""Scalar rules: known values and properties."""

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import geometry as G
from sluice.functions import ids
from sluice.functions import scoring as S


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_normalize_known_values(spark):
    n = lambda s, t: S.normalize(F.lit(s).cast("float"), F.lit(t))
    got = one(spark, n(0.3, 0.6), n(0.8, 0.6), n(0.37, 0.5), n(0.0, 0.0), n(1.0, 1.0), n(0.5, 0.0))
    assert [round(x, 6) for x in got] == [0.25, 0.75, 0.37, 0.5, 0.5, 0.75]


def test_float_scores_against_double_thresholds(spark):
    p = lambda x: S.is_positive(F.lit(x).cast("float"), F.lit(x))
    assert list(one(spark, p(0.7), p(0.6))) == [False, True]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1, width=32), min_size=2, max_size=30), st.floats(0, 1))
def test_normalize_is_monotone_and_half_at_the_threshold(spark, scores, t):
    df = spark.createDataFrame([(s,) for s in scores], "s float").select("s", S.normalize(F.col("s"), F.lit(t)).alias("n"), S.is_positive(F.col("s"), F.lit(t)).alias("p"))
    rows = sorted(df.collect())
    assert all(a.n <= b.n for a, b in zip(rows, rows[1:], strict=False))
    half = struct.unpack("f", struct.pack("f", 0.5))[0]
    assert all((r.n >= half) == r.p or math.isclose(r.n, 0.5, abs_tol=1e-6) for r in rows)


def test_bands(spark):
    got = one(spark, *[S.band_name(S.band_rank(F.lit(x).cast("float"))) for x in (0.0, 0.25, 0.5, 0.75)], S.band_rank(F.lit(None).cast("float")), S.item_band(F.lit(0.9), F.lit(None).cast("double"), F.lit(None).cast("string")))
    assert list(got) == ["Low", "MediumLow", "MediumHigh", "HighQuality", None, 1]


def test_prediction(spark):
    day = S.wait_quantile(F.lit(2), F.lit(86400), 0.025), S.wait_quantile(F.lit(2), F.lit(86400), 0.5), S.wait_quantile(F.lit(2), F.lit(86400), 0.975), S.wait_quantile(F.lit(0), F.lit(86400), 0.5)
    got = one(spark, *day)
    assert [x and x // 1000 for x in got] == [1093, 29943, 159359, None]


def test_limits_and_names(spark):
    got = one(spark, *[ids.parse_limit(F.lit(x)) for x in ("48h", "1w", "1y", "0d", "5m", "x")])
    assert list(got) == [172800, 604800, 31536000, None, None, None]
    name = ids.parse_list_name(F.lit("v1-quality-48h"))
    assert list(one(spark, name["order"], name["limit"], ids.parse_list_name(F.lit("v1-best-48h")))) == ["quality", "48h", None]


def test_ids(spark):
    s = lambda x: ids.parse_item_id(F.lit(x))["scheme"]
    assert list(one(spark, s("v3:bafyx"), s("v2:" + "a" * 32), s("01234567-89ab-cdef-0123-456789abcdef"), s("v2:zz"))) == ["V3", "V2", "V1", None]
    assert one(spark, ids.post_url(F.lit("at://did:x/c/r")))[0] == "https://bsky.app/profile/did:x/post/r"
    a, b = ("k1", F.lit(1)), ("k2", F.lit("x"))
    got = one(spark, ids.content_version(a, b), ids.content_version(b, a), ids.content_version(a, ("k2", F.lit("y"))))
    assert got[0] == got[1] != got[2] and len(got[0]) == 8


def test_costs(spark):
    c = S.cost(F.lit(1234), F.lit(567), F.lit(2.5).cast("decimal(12,6)"), F.lit(10).cast("decimal(12,6)"))
    got = one(spark, c, S.round_cost(F.lit("0.00005").cast("decimal(38,12)")), S.round_cost(F.lit("0.00015").cast("decimal(38,12)")))
    assert [float(x) for x in got] == [0.008755, 0.0, 0.0002]
    with pytest.raises(Exception, match="budget"):
        one(spark, S.sample_size(F.lit(1.0), F.lit(10), F.lit(5.0)))


def test_zone_prefers_the_last_of_equals(spark):
    box = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    got = one(spark, G.zone(box(0.0, 0.0, 10.0, 10.0), 400.0, 400.0), G.zone(box(0.0, 0.0, 400.0, 400.0), 400.0, 400.0), G.iou(box(0.0, 0.0, 2.0, 2.0), box(1.0, 0.0, 2.0, 2.0)), G.box_area_percent(box(-10.0, 0.0, 20.0, 10.0), 100.0, 100.0))
    assert list(got)[:2] == ["TOP_LEFT", "BOTTOM_RIGHT"] and abs(got[2] - 1 / 3) < 1e-12 and got[3] == 1.0


def test_model_answers(spark):
    p = lambda x: ids.parse_model_score(F.lit(x))
    got = one(spark, p('ok {"score": 0.5} end'), p(" 0.25 "), p("none"), p('{"score": 7}'), p(None))
    assert list(got) == [0.5, 0.25, None, None, None]


def test_plan_text(spark):
    f = ids.plan_fields(F.lit("Read: uri=a/images.lance, projection=[x, y], num_fragments=3, full_filter=--"))
    got = one(spark, f["projection"], f["num_fragments"], ids.object_table(f["uri"]), ids.object_kind(F.lit("a/t.lance/_versions/1")))
    assert list(got) == ["[x, y]", "3", "images.lance", "_versions"]


def test_plan_fields_of_odd_texts(spark):
    f = lambda t: ids.plan_fields(F.lit(t))
    got = one(spark, f("XRead: a=1, b=[x, y], a=2, c=p IN (1, 2)"), f(""), f("nothing here"), f(None))
    assert list(got) == [{"a": "2", "b": "[x, y]", "c": "p IN (1, 2)"}, {}, {}, None]
    plan = ids.parse_plan(F.lit("XRead: uri=s/t.lance/data, projection=[a, b], num_fragments=6, range_before=None, row_id=true, zz=1, full_filter=--\n  ScalarIndexQuery: query=[m = 1]@i\n"))
    p = one(spark, plan, ids.is_full_scan(plan))
    assert tuple(p.c0) == ("t.lance", "a, b", 6, None, None, None, None, True, False, "ScalarIndexQuery: query=[m = 1]@i", ["zz"]) and p.c1
    none = one(spark, ids.parse_plan(F.lit("x")), ids.is_full_scan(ids.parse_plan(F.lit("XRead: num_fragments=1, full_filter=a = 1"))))
    assert none.c0.table is None and none.c0.unknown_keys == [] and not none.c1


def test_a_plan_is_taken_apart_once(spark):
    """the split of a line stood in the expression of each field, of each key and thrice in that, so a row took a millisecond."""
    t = spark.range(3).select(F.concat(F.lit("XRead: num_fragments="), F.col("id").cast("string"), F.lit(", a=1, a=2")).alias("t"))
    df = t.select(ids.parse_plan(F.col("t")).alias("p")).select("p.num_fragments", "p.full_filter", "p.unknown_keys", ids.is_full_scan(F.col("p")).alias("full"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[A-Za-z_]") == 1
    assert [tuple(r) for r in df.orderBy("num_fragments").collect()] == [(n, None, ["a"], True) for n in range(3)]
    wide = "XRead: " + ", ".join(f"k{n % 700}={n}" for n in range(1000)) + ", uri=s/t.lance/data"
    got = one(spark, ids.plan_fields(F.lit(wide)), ids.parse_plan(F.lit(wide)))
    assert got.c0 == {f"k{n % 700}": str(n) for n in range(1000)} | {"uri": "s/t.lance/data"}
    assert got.c1.table == "t.lance" and got.c1.unknown_keys == sorted(f"k{n}" for n in range(700))


def test_reviewers(spark):
    names = ("github:ann", "github:", "local:admin", "local:other", "foo:bar", "github", None)
    assert list(one(spark, *[ids.is_reviewer(F.lit(n)) for n in names])) == [True, False, True, False, False, False, False]


def test_ids_in_upper_case_and_other_forms(spark):
    uuid, plain = "01234567-89ab-cdef-0123-456789abcdef", "0123456789abcdef0123456789abcdef"
    v = lambda x: ids.parse_item_id(F.lit(x))["value"]
    forms = (uuid, uuid.upper(), plain, "{" + uuid + "}", "urn:uuid:" + uuid)
    assert list(one(spark, *map(v, forms))) == [uuid] * 5
    assert list(one(spark, v("v2:" + plain.upper()), v("{" + uuid), v("v2:" + plain[:-1]), v(""))) == [plain, None, None, None]


def test_scores_given_as_text_are_refused(spark):
    p = lambda x: ids.parse_model_score(F.lit(x))
    assert list(one(spark, p('{"score": "0.5"}'), p('{"score": 1}'), p('{"score": null}'), p('{"score": -0.1}'))) == [None, 1.0, None, None]
