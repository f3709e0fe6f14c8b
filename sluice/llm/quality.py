"""Quality rules with a distribution-divergence verdict (operator 2, built-in functions only).

Base counts come from each whole text alone. The verdict compares two histograms of a
document, its character classes and its language's most common words, with references
that are learnt from all documents of the language, by Jensen-Shannon distance (base 2,
so between 0 and 1). Documents too short for a stable histogram are not judged by it.
Those whose language is null are compared with a reference pooled over all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import SPACES, materialise, table, words

SYMBOLS = "#*$%&|<>"
UPPER, DIGITS, PUNCTUATION = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-"
#: Character classes; what is left over (mostly letters beyond ASCII) comes last.
CLASSES = ("lower", "space", "upper", "digit", "punctuation", "symbol", "other")
#: More languages than this and the references are joined by a shuffle, not broadcast.
BROADCAST_LANGUAGES = 2000


@dataclass(frozen=True)
class DivergenceRules:
    """min_words: a shorter text isn't judged. max_class: the largest distance of classes allowed.
    max_words: the largest divergence of words (the square of the distance) allowed, as a part of
    what a text without a common word has, beside what chance explains at the text's length:
    ``chance`` standard deviations. expected: where so many common words are expected, a text
    must have one. top_words: words of a language's reference histogram (the rest is one bin)."""

    min_words: int = 40
    max_class: float = 0.30
    max_words: float = 0.35
    chance: float = 3.0
    expected: float = 8.0
    top_words: int = 20


def _measured(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """The id columns, text, rest (the text without a-z and blanks), word_chars and class counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(*id_cols, text.alias("text")).withColumn("rest", F.regexp_replace("text", "[a-z ]+", ""))
    base = base.withColumn("blanks", F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))))
    left, counts = F.translate("rest", SPACES, ""), []
    spaces = F.col("blanks") + F.length("rest") - F.length(left)
    lower = F.length("text") - F.length("rest") - F.col("blanks")
    base = base.withColumn("word_chars", (F.length("text") - spaces).cast("long"))
    for chars in (UPPER, DIGITS, PUNCTUATION, SYMBOLS):
        less = F.translate(left, chars, "")
        counts.append(F.length(left) - F.length(less))
        left = less
    return base.withColumn("class_counts", F.array(*[c.cast("double") for c in (lower, spaces, *counts, F.length(left))]))


def _windows(hashes: str, window: int) -> Column:
    """A hash of each ``window`` words in a row, from the words' hashes: by doubling, so few passes over the array."""
    h, n = F.col(hashes), F.size(hashes)
    level, size, total, done = h, 1, None, 0
    shifted = lambda a, k: F.slice(a, F.lit(k + 1), n)
    while done < window:
        if window & size:
            total = level if total is None else F.zip_with(total, shifted(level, done), lambda a, b: F.xxhash64(a, b))
            done += size
        level, size = F.zip_with(level, shifted(level, size), lambda a, b: F.xxhash64(a, b)), size * 2
    return F.when(n > window, F.slice(total, F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: str, marks: str, starts: str, window: int) -> tuple[Column, Column, Column]:
    """(hash, start) of every window of a text that repeats any, sorted so that equal windows are neighbours; the starts
    of windows found twice or more; and from those, the number of words they cover."""
    every = F.transform(windows, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))
    sort = F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(every)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    twin = lambda m, k: F.coalesce(F.get(F.col(marks), k)["h"] == m["h"], F.lit(False))
    found = F.sort_array(F.transform(F.filter(marks, lambda m, k: twin(m, k + 1) | twin(m, k - 1)), lambda m: m["i"]))
    steps = F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(F.col(starts), k + 1) - s, F.lit(window)), F.lit(window)))
    return sort, found, F.aggregate(steps, F.lit(0), lambda a, s: a + s).cast("long")


def base_counts(df: DataFrame, id_cols: list[str], text_col: str = "text", window: int = 5) -> DataFrame:
    """The base counts of every whole text, with lower_hashes (of its words in lower case) and class_counts for the verdict.

    A null or empty text has no words; repeated rows are counted each on its own.
    Words are hashed once (64 bits); windows are compared by hashes of hashes, and only texts that
    repeat a window have its places looked up.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = _measured(df, id_cols, text_col).withColumns({"lines": lines, "ws": words(F.col("text"))})
    out = out.withColumns({"hashes": F.transform("ws", lambda w: F.xxhash64(w)), "lower_hashes": F.transform("ws", lambda w: F.xxhash64(F.lower(w)))})
    out = out.withColumn("windows", _windows("hashes", window))
    marks, starts, covered = _covered("windows", "marks", "starts", window)
    out = out.withColumn("marks", marks).withColumn("starts", starts)
    return out.select(
        *id_cols,
        F.size("hashes").cast("long").alias("n_words"),
        "word_chars",
        (F.length("rest") - F.length(F.translate("rest", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        "class_counts",
        "lower_hashes",
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either has no counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    share = lambda a, t: F.transform(a, lambda x: x / t)
    tp, tq = total(p), total(q)
    terms = F.zip_with(share(p, tp), share(q, tq), lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0))))


def language_references(df: DataFrame, rules: DivergenceRules = DivergenceRules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, ref_classes, common, ref_common): one row per language, from all its documents.

    ``common`` has the language's ``top_words`` most frequent words (ties by word) and
    ``ref_common`` their counts, then the count of all other words. Partial sums and a
    partial top-k on the map side keep a language with most of the rows from being hot.

    The row with a null language is pooled over all documents: its ``common`` words are those
    of every language (and of the documents without one), and ``ref_common`` counts them in one bin.
    """
    src = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
    sums = F.array(*[F.sum(F.col("class_counts")[k]) for k in range(len(CLASSES))])
    counts = src.select("lang", F.explode(words(F.lower("body"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    all_words = counts.groupBy("lang").agg(F.sum("n").alias("all_words")).withColumnRenamed("lang", "of")
    classes = _measured(src, ["lang"], "body").groupBy("lang").agg(sums.alias("ref_classes"))
    classes = classes.join(all_words, F.col("lang").eqNullSafe(F.col("of")), "left").select("lang", "ref_classes", F.coalesce("all_words", F.lit(0)).alias("all_words"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rules.top_words)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))).alias("top"))
    known = F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s - x["m"])
    both = classes.join(top.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<m:bigint,word:string>>")))
    both = both.select("lang", "ref_classes", F.transform("top", lambda x: x["word"]).alias("common"), F.concat(F.transform("top", lambda x: (-x["m"]).cast("double")), F.array((F.col("all_words") - known).cast("double"))).alias("ref_common"))
    both = materialise(both, "group-references")
    share = F.sum(F.aggregate(F.slice("ref_common", 1, F.size("common")), F.lit(0.0), lambda a, x: a + x))
    sums = F.array(*[F.sum(F.col("ref_classes")[k]) for k in range(len(CLASSES))])
    pooled = both.agg(sums.alias("ref_classes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("common")))).alias("common"), F.array(share, F.sum(F.element_at("ref_common", -1))).alias("ref_common"), F.count("*").alias("n")).where("n > 0")
    return both.where("lang is not null").union(pooled.select(F.lit(None).cast(both.schema["lang"].dataType).alias("lang"), "ref_classes", "common", "ref_common"))


def _words_too_far(rules: DivergenceRules) -> Column:
    """Whether a text's common words are too far from the reference's, for its length.

    A sample of n words from the reference itself has a divergence of about chi-square / (8 n ln 2),
    with one degree of freedom less than there are bins.
    """
    free = F.size("ref_common") - 1
    none = F.transform("ref_common", lambda x, k: F.when(k < free, 0.0).otherwise(1.0))
    chance = (free + rules.chance * F.sqrt(2 * free)) / (8 * math.log(2) * F.col("n_words"))
    far = F.pow("word_distance", F.lit(2)) > rules.max_words * F.pow(js_distance(none, F.col("ref_common")), F.lit(2)) + chance
    total = F.aggregate("ref_common", F.lit(0.0), lambda a, x: a + x)
    lacking = (F.col("n_common") == 0) & (F.col("n_words") * (1 - F.element_at("ref_common", -1) / total) >= rules.expected)
    return F.coalesce(far | lacking, F.lit(False))


def judge(df: DataFrame, references: DataFrame | None = None, rules: DivergenceRules = DivergenceRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, distances and verdict of every document.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance (null where there is no reference) and kept. Only the
    three named columns are read, so others may have any names.
    """
    refs = materialise(language_references(df, rules, text_col, lang_col) if references is None else references, "language-references")
    small = refs.count() <= BROADCAST_LANGUAGES
    src = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
    out = base_counts(src, ["id", "lang"], "body")
    refs = refs.withColumnRenamed("lang", "of").withColumn("common_hashes", F.transform("common", lambda w: F.xxhash64(w)))
    out = out.join(F.broadcast(refs) if small else refs, F.col("lang").eqNullSafe(F.col("of")), "left")
    of = lambda k: F.size("lower_hashes") - F.size(F.array_remove("lower_hashes", F.get("common_hashes", F.lit(k))))
    each = F.slice(F.array(*[of(k).cast("double") for k in range(rules.top_words)]), F.lit(1), F.size("common"))
    pooled = F.array(F.size(F.filter("lower_hashes", lambda h: F.array_contains("common_hashes", h))).cast("double"))
    out = out.withColumn("counts", F.when(F.col("lang").isNull(), pooled).otherwise(each))
    out = out.withColumn("n_common", F.aggregate("counts", F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("counts", F.concat("counts", F.array(F.col("n_words") - F.col("n_common"))))
    long_enough = F.col("n_words") >= rules.min_words
    far = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumns({"class_distance": js_distance(F.col("class_counts"), F.col("ref_classes")), "word_distance": js_distance(F.col("counts"), F.col("ref_common")), "base_failed": base_failed})
    odd = long_enough & (far("class_distance", rules.max_class) | _words_too_far(rules))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~odd).alias("kept"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and divergence verdict."""
    return judge(table(spark, sf_dir, "documents"))
