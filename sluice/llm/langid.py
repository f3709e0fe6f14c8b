"""Language identification of mixed-language text (operator 6).

A model has, per language, log probabilities of the character trigrams of words with their
borders, and the scripts that the language is written in. In a text, the scripts of a word's letters
narrow its candidate languages, each candidate scores the word, and a Viterbi pass over the
words with a fixed switching penalty labels spans. A text's language is the one with the most
letters in its spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, table, without_gc, words

#: First code points of script ranges and the scripts that begin there.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
    (0x30000, "other"),
)
_STARTS = [a for a, _ in SCRIPT_RANGES]
#: Entries that a worker keeps for repeated words before it starts afresh.
CACHE_ENTRIES = 300_000
UNKNOWN = "und"
#: Means of n-gram log probabilities, as parts of the way from an unseen n-gram up to the
#: language's typical text, at which a text counts as wholly foreign and as wholly native.
FOREIGN, NATIVE = 0.4, 0.8


def script(char: str) -> str:
    return SCRIPT_RANGES[bisect_right(_STARTS, ord(char)) - 1][1]


@dataclass(frozen=True)
class LanguageModel:
    """langs in code point order; grams: n-gram to its log probability per language; scripts: script to candidates;
    typical: the mean log probability of the n-grams of the texts that each language is learnt from."""

    langs: tuple[str, ...]
    grams: dict[str, tuple[float, ...]]
    floor: tuple[float, ...]
    scripts: dict[str, tuple[bool, ...]] = field(default_factory=dict)
    typical: tuple[float, ...] = ()


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 2_000, max_grams: int = 60_000, min_share: float = 0.001) -> LanguageModel:
    """Fits a model to labelled rows; rows with a null text or label are ignored.

    The fit uses a sample of about ``max_docs`` rows of each language, drawn by a hash of the
    text, so equal inputs give equal models. Counting runs in Spark; the driver gets the
    ``max_grams`` most frequent letters and trigrams, ties by gram: a fixed bound. A script
    admits a language that has at least ``min_share`` of its letters in that script.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = tuple(sorted(sizes))
    if not langs:
        return LanguageModel((), {}, ())
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs / sizes[k]))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    clean = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")
    counted = sample.select("lang", F.explode(words(clean)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    counted = counted.withColumn("b", F.concat(F.lit("^"), "w", F.lit("$")))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("b") - (n - 1)), lambda i: F.substr("b", i, F.lit(n)))
    grams = counted.select("lang", "n", F.explode(F.concat(cut(1), cut(3))).alias("g")).groupBy("g", "lang").agg(F.sum("n").alias("n"))
    per = grams.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    top = per.orderBy(F.desc("n"), "g").limit(max_grams).collect()
    totals = [[0.0] * len(langs) for _ in range(4)]
    script_n: dict[str, list[float]] = {}
    for r in top:
        for k, lang in enumerate(langs):
            n = r["by"].get(lang, 0)
            totals[len(r["g"])][k] += n
            if len(r["g"]) == 1 and r["g"] not in "^$":
                script_n.setdefault(script(r["g"]), [0.0] * len(langs))[k] += n
    kinds = [1 + sum(len(r["g"]) == n for r in top) for n in range(4)]
    value = lambda n, k, c: math.log((c + 0.5) / (totals[n][k] + 0.5 * kinds[n]))
    out = {r["g"]: tuple(value(len(r["g"]), k, r["by"].get(lang, 0)) for k, lang in enumerate(langs)) for r in top if len(r["g"]) == 3}
    floor = tuple(value(3, k, 0) for k in range(len(langs)))
    worth = [sum(r["by"].get(lang, 0) * out[r["g"]][k] for r in top if len(r["g"]) == 3) for k, lang in enumerate(langs)]
    typical = tuple(worth[k] / totals[3][k] if totals[3][k] else floor[k] for k in range(len(langs)))
    letters = [sum(v[k] for v in script_n.values()) or 1.0 for k in range(len(langs))]
    scripts = {s: tuple(v[k] >= min_share * letters[k] and v[k] > 0 for k in range(len(langs))) for s, v in script_n.items()}
    return LanguageModel(langs, out, floor, {s: v for s, v in scripts.items() if any(v)}, typical)


class Labeller:
    """Labels spans of texts with one model; keeps the scores of words that it has seen."""

    BARRED = -1e6

    def __init__(self, model: LanguageModel, penalty: float):
        import numpy as np

        self.model, self.penalty, self.np = model, penalty, np
        self.find = re.compile(r"[^\W\d_]+").findall
        self.open_to: dict[frozenset[str], tuple[bool, ...] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = self.np.zeros((4096, len(self.model.langs)))
        self.letters = self.np.zeros(4096, self.np.int64)
        self.known = self.np.zeros(4096, self.np.int64)

    def candidates(self, word: str) -> tuple[bool, ...] | None:
        """The languages that use all scripts of a word, else those that use one of them; None if no language uses any."""
        found = frozenset(("latin",)) if word.isascii() else frozenset(script(c) for c in word if c.isalpha())
        if found not in self.open_to:
            scripts = self.model.scripts
            known = [scripts[x] for x in sorted(found) if x in scripts]
            every, some = [all(x) for x in zip(*known, strict=True)], [any(x) for x in zip(*known, strict=True)]
            self.open_to[found] = None if not known else tuple(every if any(every) else some)
        return self.open_to[found]

    def score(self, word: str) -> int:
        """The row of a word: its log likelihood per candidate language; none if no language uses its script."""
        np, model = self.np, self.model
        at = self.index[word] = len(self.index)
        if at >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        n = len(word) if word.isalpha() else sum(c.isalpha() for c in word)
        self.letters[at] = n
        if n:
            padded, get, floor = f"^{word}$", model.grams.get, model.floor
            total = list(map(sum, zip(*[get(padded[i : i + 3], floor) for i in range(len(padded) - 2)], strict=True)))
            open_to = self.candidates(word)
            if open_to is not None:
                self.scores[at], self.known[at] = [x if ok else self.BARRED for x, ok in zip(total, open_to, strict=True)], n
            elif not model.scripts:
                self.scores[at], self.known[at] = total, n
        return at

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]], float]:
        """(language, its share of the letters times its likeness, spans as (first word, words, language))."""
        np = self.np
        if len(self.index) > CACHE_ENTRIES:
            self.clear()
        found, index = self.find(text.lower()) if text else (), self.index
        rows = np.array([index[w] if w in index else self.score(w) for w in found], np.int64)
        letters = self.letters[rows] if len(rows) else rows
        if not len(rows) or not letters.sum() or not self.model.langs:
            return UNKNOWN, 0.0, [], 0.0
        path = self.viterbi(self.scores[rows])
        known = self.known[rows]
        per = np.bincount(path, weights=known, minlength=len(self.model.langs))
        best = int(per.argmax())
        edges = np.flatnonzero(np.diff(path)) + 1
        starts = [0, *edges.tolist(), len(path)]
        spans = [(a, b - a, self.model.langs[path[a]]) for a, b in zip(starts, starts[1:], strict=False)]
        share = [float(per[k] / letters.sum()) * self.likeness(rows[(path == k) & (known > 0)], k) if per[k] else 0.0 for k in range(len(per))]
        return self.model.langs[best], share[best], spans, min(1.0, sum(share))

    def likeness(self, rows, k: int) -> float:
        """From 0 to 1, how far the n-grams of words in language k lie above the level of a foreign language."""
        model = self.model
        if not model.typical or not len(rows) or model.typical[k] <= model.floor[k]:
            return 1.0
        mean = self.scores[rows, k].sum() / self.known[rows].sum()
        part = (mean - model.floor[k]) / (model.typical[k] - model.floor[k])
        return float(min(1.0, max(0.0, (part - FOREIGN) / (NATIVE - FOREIGN))))

    def viterbi(self, s):
        """Best path of states; each change of language costs the penalty.

        If one language throughout is the best path, no stretch of other languages can gain
        more than a penalty over it. A running sum shows that at once, for most texts.
        """
        np, n, k = self.np, *s.shape
        main = int(s.sum(axis=0).argmax())
        if k == 1:
            return np.zeros(n, np.int64)
        rival = np.delete(s, main, axis=1).max(axis=1) - s[:, main]
        sums = np.concatenate([[0.0], np.cumsum(rival)])
        if (sums - np.minimum.accumulate(sums)).max() <= self.penalty:
            return np.full(n, main, np.int64)
        back, penalty = [], self.penalty
        best = s[0].tolist()
        for row in s[1:].tolist():
            top = max(best)
            come = best.index(top)
            change = top - penalty
            back.append([j if b >= change else come for j, b in enumerate(best)])
            best = [(b if b >= change else change) + x for b, x in zip(best, row, strict=True)]
        j = best.index(max(best))
        path = [j]
        for step in reversed(back):
            j = step[j]
            path.append(j)
        return np.array(path[::-1], np.int64)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, learned, spans) of every row, from its whole text alone. ``score`` is the share of letters of
    the language that has most, ``learned`` that of all languages together, each times how like the language its words are.

    A null text, or one without a letter, is ``und`` with score 0 and no spans. Repeated rows
    and null ids come back as they are; other columns aren't read, but those in ``carry`` come
    along in a struct ``carried``, and the text with them, as ``text``. ``spans`` count the words
    (runs of letters) of the text. No shuffle; the model is of bounded size.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labeller = Labeller(model, penalty)
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
        with without_gc():
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    found = [labeller.label(t) for t in batch.column(1).to_pylist()]
                    spans = pa.array([[{"first_word": a, "n_words": n, "lang": x} for a, n, x in f[2]] for f in found], kind)
                    out = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()), spans]
                    if carry:
                        out += batch.columns[1:]
                    yield pa.RecordBatch.from_arrays(out, names=["id", "lang_pred", "score", "learned", "spans", "text", "carried"][: len(out)])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    kind = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = f"id {kind['id']}, lang_pred string, score double, learned double, spans array<struct<first_word:int,n_words:int,lang:string>>"
    schema += f", text string, carried {kind['carried']}" if carry else ""
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
