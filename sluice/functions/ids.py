"""Identifiers, list names, limits, versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
POST_COLLECTION = "app.bsky.feed.post"
UNIT_SECONDS = {"h": 3600, "d": 86400, "w": 604800, "y": 31536000}
_HYPHENED = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
_UUID = rf"^([0-9a-f]{{32}}|{_HYPHENED}|urn:uuid:{_HYPHENED}|\{{{_HYPHENED}\}})$"
_GROUP = r"^at://([^/]+)/([^/]+)/([^/]+)$"


def parse_group(uri: Column) -> Column:
    """struct(did, collection, rkey) of at://did/collection/rkey, null if it isn't one."""
    part = lambda k, n: F.regexp_extract(uri, _GROUP, k).alias(n)
    return F.when(uri.rlike(_GROUP), F.struct(part(1, "did"), part(2, "collection"), part(3, "rkey")))


def build_group(did: Column, collection: Column, rkey: Column) -> Column:
    return F.format_string("at://%s/%s/%s", did, collection, rkey)


def post_url(uri: Column) -> Column:
    """the public page of a post."""
    g = parse_group(uri)
    return F.format_string("https://bsky.app/profile/%s/post/%s", g["did"], g["rkey"])


def parse_item_id(item: Column) -> Column:
    """struct(scheme, value): V3 v3:<cid>, V2 v2:<md5>, V1 a uuid; null if invalid.

    Hexadecimal digits may be of either case, and a uuid plain, hyphenated, in braces or a URN;
    the value is in lower case, a uuid's with hyphens.
    """
    s = lambda name, v: F.struct(F.lit(name).alias("scheme"), v.alias("value"))
    low = F.lower(item)
    digits = F.translate(F.regexp_replace(low, "^urn:uuid:", ""), "{}-", "")
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(item.rlike("^v3:[A-Za-z0-9]+$"), s("V3", F.substring(item, 4, 1000))).when(item.rlike("^v2:[0-9A-Fa-f]{32}$"), s("V2", F.substring(low, 4, 32))).when(low.rlike(_UUID), s("V1", F.concat_ws("-", *parts)))


def content_id(payload: Column) -> Column:
    """F7."""
    return F.concat(F.lit("v2:"), F.md5(payload))


def model_scheme(version: Column) -> Column:
    """F8: the scheme that the prefix tells."""
    return F.when(version.startswith("v2:"), "V2").otherwise("V1")


def content_version(*pairs: tuple[str, Column], scheme: str = "") -> Column:
    """eight hexadecimal digits over keys and values in the order of the keys, each after its length, so that no two sets of
    pairs read the same; null isn't empty."""
    told = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    parts = [x for k, v in sorted(pairs, key=lambda p: p[0]) for x in (told(F.lit(k)), told(v.cast("string")))]
    return F.concat(F.lit(scheme), F.substring(F.md5(F.concat(*parts)), 1, 8))


def split_id(seed: Column, captured_at: Column, train: Column, test: Column) -> Column:
    """md5 over seed, time and both id lists, each preceded by its length."""
    whole = lambda a: F.concat(F.size(a).cast("string"), F.lit(":"), F.array_join(a, ","))
    return F.md5(F.concat_ws("|", seed.cast("string"), F.unix_micros(captured_at).cast("string"), whole(train), whole(test)))


def parse_limit(name: Column) -> Column:
    """seconds of <n>[hdwy] with n > 0, else null; a year has 365 days."""
    n = F.regexp_extract(name, "^([0-9]{1,9})[hdwy]$", 1)
    unit = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])[F.substring(name, -1, 1)]
    return F.when(name.rlike("^0*[1-9][0-9]{0,8}[hdwy]$"), n.cast("long") * unit)


def list_name(version: Column, order: Column, limit: Column) -> Column:
    """F12."""
    return F.concat_ws("-", version, order, limit)


def parse_list_name(name: Column) -> Column:
    """struct(version, order, limit), null if a part is missing or the limit is no limit."""
    p = F.split(name, "-")
    ok = (F.size(p) == 3) & p[1].isin("quality", "recency") & parse_limit(p[2]).isNotNull()
    return F.when(ok, F.struct(p[0].alias("version"), p[1].alias("order"), p[2].alias("limit")))


def parse_spec(name: Column) -> Column:
    """struct(order, limit) of <order>-<limit>."""
    full = parse_list_name(F.concat(F.lit("v0-"), name))
    return F.when(full.isNotNull(), F.struct(full["order"].alias("order"), full["limit"].alias("limit")))


def image_url(group: Column, item: Column, base: str = "https://cdn.bsky.app/img/feed_fullsize/plain") -> Column:
    """address of a V3 item's picture; null for other schemes."""
    i = parse_item_id(item)
    return F.when(i["scheme"] == "V3", F.format_string(f"{base}/%s/%s@jpeg", parse_group(group)["did"], i["value"]))


def is_valid_url(url: Column) -> Column:
    """https only."""
    return url.startswith("https://")


def parse_model_score(text: Column) -> Column:
    """the score in a model's answer: number ``score`` of the outermost braces, or a bare
    number; FLOAT in 0 to 1, else null. A score given as text is refused."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    number = F.coalesce(F.from_json(inner, "score double")["score"], F.trim(text).try_cast("double"))
    return F.when((number >= 0) & (number <= 1), number).cast("float")


def is_reviewer(name: Column) -> Column:
    """a named account of the one provider, or the local administrator."""
    return F.coalesce(name.rlike("(?s)^github:.") | (name == "local:admin"), F.lit(False))


#: The fields of a read's plan, and the texts that stand for nothing.
PLAN_FIELDS = ("uri", "projection", "num_fragments", "full_filter", "refine_filter", "range_before", "range_after", "row_id", "row_addr")
NO_FILTER, NO_RANGE = "--", "None"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once a row, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def plan_fields(text: Column) -> Column:
    """the fields of a plan line as a map. A field ends where a comma is followed by the next field's
    name, so commas in brackets and filters belong to the value; of a repeated key the last value counts."""
    body = F.regexp_replace(F.trim(text), r"^[A-Za-z]+:\s*", "")
    fields = F.filter(F.split(body, r",\s*(?=[A-Za-z_]\w*=)"), lambda f: f.contains("="))
    key = lambda f: F.trim(F.substring_index(f, "=", 1)).alias("key")
    value = lambda f: F.trim(F.substring(f, F.instr(f, "=") + 1, F.length(f))).alias("value")
    told = F.sort_array(F.transform(fields, lambda f, i: F.struct(key(f), i.alias("at"), value(f))))
    last = _once(told, lambda t: F.filter(t, lambda x, i: ~x["key"].eqNullSafe(F.get(t, i + 1)["key"])))
    return _once(last, lambda t: F.map_from_arrays(t["key"], t["value"]))


def parse_plan(text: Column) -> Column:
    """struct of a plan's typed fields: table, columns, num_fragments, filters, ranges, flags, the index line
    and the unknown keys, sorted. Absent fields, and those that stand for nothing, are null; flags are false."""
    return _once(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), _parse_lines)


def _parse_lines(lines: Column) -> Column:
    read = _once(F.filter(lines, lambda x: x.rlike("^[A-Za-z]*Read: ")), lambda reads: F.element_at(F.when(F.size(reads) > 0, reads), -1))
    index = F.array_max(F.filter(lines, lambda x: x.startswith("ScalarIndexQuery:")))
    return _once(plan_fields(F.coalesce(read, F.lit(""))), lambda fields: _typed(fields, index))


def _typed(fields: Column, index: Column) -> Column:
    given = lambda k, nothing: F.nullif(fields[k], F.lit(nothing))
    return F.struct(
        _once(object_table(fields["uri"]), lambda t: F.nullif(t, F.lit("unknown"))).alias("table"),
        F.regexp_replace(fields["projection"], r"^\[+|\]+$", "").alias("columns"),
        fields["num_fragments"].try_cast("bigint").alias("num_fragments"),
        given("full_filter", NO_FILTER).alias("full_filter"),
        given("refine_filter", NO_FILTER).alias("refine_filter"),
        given("range_before", NO_RANGE).alias("range_before"),
        given("range_after", NO_RANGE).alias("range_after"),
        F.coalesce(fields["row_id"] == "true", F.lit(False)).alias("row_id"),
        F.coalesce(fields["row_addr"] == "true", F.lit(False)).alias("row_addr"),
        index.alias("index"),
        F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, PLAN_FIELDS)))).alias("unknown_keys"),
    )


def is_full_scan(plan: Column) -> Column:
    """A read that tells its fragments and has no filter, by the struct of ``parse_plan``."""
    return plan["num_fragments"].isNotNull() & plan["full_filter"].isNull()


def object_table(path: Column) -> Column:
    """the path's segment that names a table, else ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?:^|/)([^/]+\.lance)(?:/|$)", 1), F.lit("")), F.lit("unknown"))


def object_kind(path: Column) -> Column:
    """what the segment after the table's holds."""
    after = F.regexp_extract(path, r"(?:^|/)[^/]+\.lance/([^/]+)", 1)
    return F.when(after.isin("data", "_indices", "_versions", "_transactions"), after).when(after.endswith(".manifest"), "manifest").otherwise("other")


def range_bytes(ranges: Column) -> Column:
    """F32: total length of an array of struct(start, end)."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])


def short_time(ts: Column) -> Column:
    """F34."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def window_middle(start: Column, end: Column) -> Column:
    """F34."""
    return F.timestamp_micros(((F.unix_micros(start) + F.unix_micros(end)) / 2).cast("long"))
