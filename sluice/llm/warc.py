"""WARC archives: writing, and reading with boundary-chain verification (operator 10).

Archives are plain WARC/1.1 files that Spark's text writer commits, so any file system that
Spark knows will do. Reading splits them anywhere: Spark's text reader cuts the bytes at each
occurrence of the record magic, be it a true boundary or bytes inside a payload. Every piece
is a candidate record; its header gives the offset of its successor. Pointer jumping from the
start of each file then keeps the candidates that the chain of successors reaches. What magic
inside a payload started is not on the chain, and its bytes go back to the record that
covers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import materialise, scratch, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(hexes: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal SHA-1: 20 bits are five digits of one and four of the other."""
    groups = [F.lpad(F.conv(F.substring(hexes, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, body, digest, type, refers_to): which rows are responses and which revisits.

    Of rows with equal payloads of at least ``min_bytes``, that with the smallest id is the
    response and the others revisit it; rows that repeat the smallest id too are all
    responses, and a null id comes after all others. A null payload is empty. Groups are
    found by SHA-256 on narrow rows with partial aggregates, and only groups of two or more
    are joined back (small ones by broadcast, as Spark sees from the written table), salted.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("key", F.unhex(F.sha2("body", 256)))
    sized = rows.where(F.octet_length("body") >= min_bytes)
    groups = sized.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialise(groups, "equal-payloads").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(16)).cast("int")).join(groups, ["key", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")) & (F.octet_length("body") >= min_bytes)
    return out.select("id", "url", "body", base32_sha1(F.sha1("body")).alias("digest"), F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(records: DataFrame, path: str) -> None:
    """One WARC record per row of ``plan_records``, one archive per partition, below ``path``."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.format_string("<urn:page:%s>", F.coalesce(c.cast("string"), F.lit("null")))
    revisit = F.col("type") == "revisit"
    payload = F.when(revisit, "").otherwise(F.col("body"))
    value = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("type")), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))), line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.format_string("Content-Length: %d", F.octet_length(payload)), F.lit(END), payload,
    )
    records.select(value.alias("value")).write.option("lineSep", END).text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path)


def _content(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def bytes_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(content, bytes) of the wanted pieces, by another pass over the archives; equal pieces come once.

    ``wanted`` is read from a written table, so Spark knows whether it is small enough to broadcast.
    """
    data = _scan(spark, path).select(F.col("value").cast("binary").alias("bytes")).withColumn("content", _content(F.col("bytes")))
    return data.join(wanted.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.first("bytes").alias("bytes"))


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece between two magics: file, block and seq (its place), lengths, header fields,
    SHA-1 of the payload if the piece holds all of it, and a hash by which its bytes can be found again.

    Only these narrow rows are written to the shared folder, since later stages read them again and again.
    """
    raw = _scan(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    head = F.substring_index("value", END, 1)
    raw = raw.withColumns({"len": F.octet_length("value").cast("long"), "head": head}).withColumn("head_len", F.octet_length("head").cast("long"))
    declared = F.expr("try_cast(nullif(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]{1,15})[ \\\\t]*$', 1), '') as bigint)")
    sound = F.col("head_len") < F.col("len")
    raw = raw.withColumns({"bytes": F.col("value").cast("binary"), "body_len": F.when(sound, declared)})
    whole = F.col("body_len") + F.col("head_len") + 2 * len(END) == F.col("len")
    body = F.substring(F.col("bytes"), (F.col("head_len") + len(END) + 1).cast("int"), F.col("body_len").cast("int"))
    raw = raw.withColumn("body_sha1", F.when(whole, F.sha1(body)))
    fields = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
    raw = raw.select("file", "file_size", "block", "seq", "len", "head_len", "body_len", "body_sha1", *[_header(v).alias(k) for k, v in fields.items()], _content(F.col("bytes")).alias("content"))
    return materialise(raw, "warc-pieces")


def chain(pieces: DataFrame) -> DataFrame:
    """(file, off, succ) of the records that the boundary chain of each file reaches.

    Each round of pointer jumping doubles the reach: reached records mark the targets of
    their pointers, and every pointer is replaced by its target's pointer. So a file of n
    records takes about log2(n) rounds over narrow rows.
    """
    state = pieces.select("file", "off", "succ").where("off >= 0 and succ is not null and succ <= file_size")
    state = materialise(state.select("file", "off", F.col("succ").alias("nxt"), "succ", (F.col("off") == 0).alias("reached")), "chain")
    while True:
        targets = state.where("reached").select("file", F.col("nxt").alias("off")).distinct().withColumn("hit", F.lit(True))
        ahead = state.select("file", F.col("off").alias("nxt"), F.col("nxt").alias("beyond"))
        after = state.join(ahead, ["file", "nxt"], "left").join(targets, ["file", "off"], "left")
        # a pointer past the last candidate stays where it is: it has no target to mark
        new = after.select("file", "off", F.coalesce("beyond", "nxt").alias("nxt"), "succ", (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"), F.col("hit").isNotNull().alias("hit"), (F.col("hit") & ~F.col("reached")).alias("fresh"))
        new = materialise(new, "chain")
        if not new.where("fresh").limit(1).count():
            return new.where("reached").select("file", "off", "succ")
        state = new.drop("hit", "fresh")


def place(pieces: DataFrame) -> DataFrame:
    """Adds off and succ, from running sums of lengths: per split, then over the splits of a file."""
    narrow = pieces.select("file", "file_size", "block", "seq", "len", "head_len", "body_len")
    step = F.col("len") + len(MAGIC)
    splits = narrow.groupBy("file", "block").agg(F.sum(step).alias("total"))
    base = F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")
    splits = splits.select("file", "block", base.alias("base"))
    inner = F.sum(step).over(Window.partitionBy("file", "block").orderBy("seq")) - step
    out = narrow.withColumn("inner", inner).join(splits, ["file", "block"])
    out = out.withColumn("off", F.col("base") + F.col("inner") - len(MAGIC))
    return out.select("file", "file_size", "block", "seq", "off", (F.col("off") + len(MAGIC) + F.col("head_len") + F.col("body_len") + 2 * len(END)).alias("succ"))


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(file, off, type, record_id, uri, digest, refers_to, body_len, body_sha1[, payload]) of every record on the chain.

    ``body_sha1`` is the hexadecimal SHA-1 of the payload as read. With ``payloads`` the
    bytes come too. An empty folder gives no rows; a damaged file gives the records before the damage.
    """
    pieces = read_pieces(spark, path)
    placed = materialise(place(pieces), "warc-places")
    kept = chain(placed)
    at = Window.partitionBy("file").orderBy("off")
    owner = placed.where("off >= 0").join(kept.select("file", "off", F.lit(True).alias("kept")), ["file", "off"], "left")
    owner = owner.withColumn("record", F.last(F.when(F.col("kept"), F.col("off")), ignorenulls=True).over(at))
    owner = owner.withColumns({"n": F.count("*").over(Window.partitionBy("file", "record"))}).where("record is not null")
    owner = materialise(owner.select("file", "block", "seq", "off", "record", "n", F.coalesce("kept", F.lit(False)).alias("kept")), "warc-owners")
    key = ["file", "block", "seq"]
    # a payload with magic inside: its record's pieces are put together again
    torn = owner.where("n > 1").drop("n", "kept").join(pieces.select(*key, "content"), key)
    torn = materialise(torn.select("file", "record", "off", "content"), "warc-torn")
    torn = torn.join(bytes_of(spark, path, torn), "content")
    whole = torn.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("off", "bytes"))).alias("parts"))
    gap = F.encode(F.lit(MAGIC), "UTF-8")
    glued = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["bytes"], lambda a, p: F.concat(a, gap, p["bytes"]))
    glued = whole.select("file", F.col("record").alias("off"), glued.alias("glued"))
    records = owner.where("kept").select(*key, "off", "n").join(pieces.drop("file_size", "len"), key)
    records = records.join(glued, ["file", "off"], "left")
    if payloads:
        records = records.join(bytes_of(spark, path, records), "content")
    cut = lambda c: F.substring(F.col(c), (F.col("head_len") + len(END) + 1).cast("int"), F.col("body_len").cast("int"))
    out = ["file", "off", "type", "record_id", "uri", "digest", "refers_to", "body_len", F.coalesce(F.sha1(cut("glued")), "body_sha1").alias("body_sha1")]
    return records.select(*out, *([F.coalesce(cut("glued"), cut("bytes")).alias("payload")] if payloads else []))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record per page, reads the archives back and reports every page from them."""
    path = scratch(spark, "warc")
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    found = read_records(spark, path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    found = found.select(page("record_id").alias("page_id"), F.col("body_len").alias("own_bytes"), F.when(F.col("type") == "revisit", F.regexp_replace("digest", "^sha1:", "")).otherwise(base32_sha1(F.col("body_sha1"))).alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
    found = materialise(found, "warc-records")
    again = found.where("record_type = 'revisit'")
    read = found.where("record_type = 'response'")
    seen = read.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own_bytes").alias("payload_bytes"))
    seen = seen.join(again.select("refers_to").distinct(), "refers_to", "left_semi")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    full = again.join(seen, ["refers_to", "payload_digest"], "left").select(*cols)
    return read.withColumn("payload_bytes", F.col("own_bytes")).select(*cols).unionByName(full)
