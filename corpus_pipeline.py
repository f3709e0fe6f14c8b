"""A corpus from raw documents to token ids: language ID, near-duplicates, repeated passages,
mixing, byte-level BPE. Each stage works on all that its predecessor kept, and all but the last
return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, langid, minhash, mixing, substrings
from sluice.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if the learned languages have no more than this share of its letters, all together.
LEAST_SHARE = 0.34


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or in no learned language; fills in missing languages. A text that mixes
    learned languages stays, however even the mix.

    The model learns from the documents that have a language. Without any, nothing is judged.
    """
    model = langid.learn(docs)
    if not model.langs:
        return docs.select(*COLUMNS)
    found = langid.identify(docs, model, carry=("lang", "source", "n_chars"))
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("learned") > LEAST_SHARE))
    return found.select("doc_id", "text", F.coalesce("carried.lang", "lang_pred").alias("lang"), "carried.source", "carried.n_chars").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the one with the smallest id (null last, ties by content).

    Where ids repeat or are null, each row is a document of its own under a made-up key, so
    that repeated rows are linked by their texts as other duplicates are. Rows without words stay.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    rows = materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "keyed-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("h"), "source", "lang", "n_chars", "row")
    found = minhash.near_duplicates(rows, id_col="row").select("row", "component_id")
    first = rows.select("row", order.alias("order")).join(found, "row").groupBy("component_id").agg(F.min("order")["row"].alias("row"))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a text without any stays as it is (null: empty)."""
    rest = ("lang", "source")
    cut = substrings.remove_repeats(docs, carry=rest, verbatim=True)
    cut = cut.select("doc_id", F.col("kept").alias("text"), *[F.col(f"carried.{c}") for c in rest])
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those with no copy go.

    Rows that are alike in every column are as good as one: they share the copies that the mix gives them.
    """
    key = F.struct("doc_id", "source", "lang", "n_chars", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    copies = mixing.mix(docs.withColumn("key", key), id_col="key").where("copies > 0")
    copies = copies.groupBy("key").agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.select(*COLUMNS).withColumn("key", key).dropDuplicates(["key"]).join(copies, "key")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): ids joined by spaces, and whether they decode to the text."""
    tokens = bpe.round_trip(docs.select(F.struct("doc_id", F.sha2("text", 256).alias("sha")).alias("row"), "text"), "row")
    same = F.sha2("decoded", 256) == F.coalesce("row.sha", F.sha2(F.lit(""), 256))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids"), same.alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", remove_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_documents),
]

#: Learnt language scores, MinHash and BPE are beyond SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
