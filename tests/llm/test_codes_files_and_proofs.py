"""Operators 11 to 13 against brute force, and on nasty rows."""

import os
import random
import struct
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from sluice.llm import codes, manifest, tokenfile  # noqa: E402
from sluice.llm.queries import QUERIES  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NASTY = ["", " ", "   ", "a  b", "a   b c", " \n x", "x \n  y \n", "tab\t z", "don't 's 'll x", "é ü  w 　z", "\x85 a \x1c b", "<|endoftext|> is text", "word " * 400, "ab" * 3000, "\n\n\n", "emoji 😀 👩‍👩‍👧 done ", "1234 56 789", "end "]


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


# ---- op11 ---------------------------------------------------------------
def vectors(n, dims, seed, draw):
    r = random.Random(seed)
    return [(3 * k + 1, [f32(draw(r)) for _ in range(dims)], r.choice([None, 0, 1, 1, 1])) for k in range(n)]


def compressed(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("v", "code", "error", "of", "own", "salt", "part", "id")])
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df, **how).collect()}


def test_codes_are_those_of_brute_force(spark):
    rows = vectors(500, 32, 1, lambda r: r.gauss(0, 0.3))
    bad = [(0, None, 1), (2, [float("nan")] * 32, 1), (3, [None] + [0.1] * 31, 1), (5, [float("-inf")] + [0.0] * 31, 0)]
    assert compressed(spark, rows + bad) == brute.codes(rows)


def test_codes_with_ties_few_rows_and_odd_widths(spark):
    ties = vectors(300, 34, 2, lambda r: r.choice([-0.01, 0.0, 0.01]))  # many equal entries, many equal distances; 34 isn't a multiple of 16
    assert compressed(spark, ties) == brute.codes(ties)
    assert compressed(spark, ties, entries=20, parts=5, rounds=3) == brute.codes(ties, 5, 20, 3)
    few = [(1, [0.5] * 16, None), (2, [0.25] * 16, None), (9, [0.5] * 10, 4)]
    assert compressed(spark, few) == brute.codes(few)
    assert compressed(spark, [], entries=4) == {}


def test_codes_of_huge_components_are_exact(spark):
    r = random.Random(3)
    rows = [(k, [float(r.choice([-1, 1]) * r.randrange(2**21)) for _ in range(16)], 1) for k in range(120)]
    assert compressed(spark, rows, "double", entries=40) == brute.codes(rows, 16, 40)


def test_gnat_leaves_out_subtrees_and_finds_the_nearest(monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    entries = np.concatenate([r.normal(c, 4, (40, 4)).astype(np.int64) for c in (-300, 0, 250, 700)])
    trees, kind = codes.plant(codes.Codebooks([entries.tolist()], 4), 1024)
    x = np.concatenate([r.integers(-400, 800, (2000, 4)), entries, np.full((5, 4), 10_000)]).astype(kind)
    measured, squares = [], codes._squares
    monkeypatch.setattr(codes, "_squares", lambda a, b: measured.append(len(a) * len(b)) or squares(a, b))
    found, best = codes.assign(trees, x[:, None])
    every = squares(x, entries)
    assert (found[:, 0] == every.argmin(axis=1)).all() and (best[:, 0] == every.min(axis=1)).all()
    assert sum(measured) < 0.6 * every.size


def test_codes_decode_to_entries(spark):
    rows = vectors(90, 32, 5, lambda r: r.gauss(0, 0.3))
    whole = codes.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "embedding")
    books = codes.fit(whole, "vec_id", entries=16)
    found = {r.vec_id: r for r in codes.decode(codes.encode(whole, books, ("vec_id",)), books).collect()}
    for r in whole.collect():
        assert sum((a - b) ** 2 for a, b in zip(r.v, found[r.vec_id].v, strict=True)) == found[r.vec_id].error


def test_codes_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in QUERIES["op11_gnat_codes"](spark, sf_dir).collect()}
    assert got == brute.codes(rows)


# ---- op12 ---------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_rows(found):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in found.collect()}


def test_pieces_are_encoded_as_whole_texts(vocabulary):
    import numpy as np

    r = random.Random(6)
    made = ["".join(r.choice([" ", " ", "\n", "a", "b1", "'s", "é", " ", "\t", "  ", "!?", "\x1d"]) for _ in range(60)) for _ in range(300)]
    signs = ["a", "s", "t", "'", ".", "$", "_", "Z", "9", "²", "é", "ª", "ж", "中", "\u1c89", "\r", "\n", " "]  # words with signs at their ends, after letters of many kinds
    made += ["x " + "".join(r.choice(signs) for _ in range(r.randrange(1, 40))) for _ in range(3_000)]
    encoder, library = tokenfile.Encoder(vocabulary), tokenfile.tokenizer(vocabulary)
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder.batch(NASTY + made)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in NASTY + made]


def test_words_are_encoded_once_whatever_is_around_them(vocabulary):
    """Words with a line break went to the library as they were, each pair of them anew."""
    import numpy as np

    class Counted:
        def __init__(self, of):
            self.of, self.chars = of, 0

        def encode_batch_fast(self, texts, **more):
            self.chars += sum(map(len, texts))
            return self.of.encode_batch_fast(texts, **more)

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeéñü") for _ in range(8))
    some, library, encoder = [word() for _ in range(60)], tokenfile.tokenizer(vocabulary), tokenfile.Encoder(vocabulary)
    names = [n for n in ("t", "model") if hasattr(encoder, n)]
    for n in names:
        setattr(encoder, n, Counted(getattr(encoder, n)))
    # every word after every other one; a line break after a space, which isn't the same, beside one after a word
    texts = ["x " + " ".join(f"{a}{r.choice(['.', '', '!?'])}\n{b}" for b in some) + f" {a},\n{a}... {a}'\n\n{a}\n" for a in some] + [f"x \n{a} {a}\n{a}" for a in some[:2]]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.batch(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(getattr(encoder, n).chars for n in names) < sum(map(len, texts)) / 10
    for t in ("x ж\nж жa\naж aж.\nDe a×\nb a\n×", "x a \nDe b\nDe", "x a.\r\nb a.\n b a'\ns a\n's a's\nt"):
        assert np.frombuffer(encoder.batch([t])[0], "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_file_of_nasty_rows(spark, tmp_path, vocabulary, monkeypatch):
    rows = [(7 * k - 20, t) for k, t in enumerate(NASTY)] + [(None, "no id"), (900, None), (901, "long text here. " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("*", *[F.lit("clash").alias(c) for c in ("part", "block", "at", "counts", "ids", "start")])
    want = brute.token_file(rows, tokenfile.tokenizer(vocabulary))
    for n, size in enumerate((tokenfile.BLOCK_IDS, 50)):  # one block, blocks of about one document
        monkeypatch.setattr(tokenfile, "BLOCK_IDS", size)
        tokenfile.write(df, f"file://{tmp_path}/{n}", vocabulary)
        assert token_rows(tokenfile.read(spark, f"file://{tmp_path}/{n}", ids=True)) == want
        some = [-20, 8, 901, 4_000]
        assert token_rows(tokenfile.read(spark, f"file://{tmp_path}/{n}", some, ids=True)) == {k: want[k] for k in some if k in want}
    tokenfile.write(df.limit(0), f"file://{tmp_path}/none", vocabulary)
    assert tokenfile.read(spark, f"file://{tmp_path}/none").count() == 0
    twice = df.where("doc_id in (1, 8)").unionByName(df.where("doc_id = 8"))
    tokenfile.write(twice, f"file://{tmp_path}/twice", vocabulary)
    assert sorted(r.doc_id for r in tokenfile.read(spark, f"file://{tmp_path}/twice").collect()) == [1, 8, 8]


def test_grammar_gives_back_its_ids_and_any_range():
    import numpy as np

    r = random.Random(7)
    common = [r.randrange(60) for _ in range(30)]
    for ids in ([], [5], [1] * 999, [1, 2] * 500, [r.randrange(4) for _ in range(5000)], [x for _ in range(400) for x in (common if r.random() < 0.6 else [r.randrange(60) for _ in range(9)])]):
        rules, seq = tokenfile.compress(ids, 60)
        assert tokenfile.expand(seq, rules, 60).tolist() == ids
        assert all(a < 60 + k and b < 60 + k for k, (a, b) in enumerate(rules.tolist()))
        lengths = tokenfile.rule_lengths(rules, 60)
        assert [len(tokenfile.expand([60 + k], rules, 60)) for k in range(len(rules))] == lengths.tolist()
        for _ in range(40 if ids else 0):
            at = r.randrange(len(ids))
            n = r.randrange(1, len(ids) - at + 1)
            assert tokenfile.decode_range(seq, rules, lengths, 60, at, n).tolist() == ids[at : at + n]
        if len(ids) > 900:
            assert len(seq) + 2 * len(rules) < 0.8 * len(ids)
    assert len(np.unique(tokenfile.compress([1, 2] * 500, 60)[1])) <= 3


def test_token_file_of_the_table(spark, sf_dir, vocabulary):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {k: v[:3] for k, v in brute.token_file(rows, tokenfile.tokenizer(vocabulary)).items()}
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op12_repair_tokens"](spark, sf_dir).collect()} == want


# ---- op13 ---------------------------------------------------------------
def third(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 0


def proven(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in manifest.prove(df, manifest.every_third()).collect()), key=repr)


def made(n, seed=8):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "lower only", "Größe UPPER", "É only", "A" * r.randrange(1, 9)])
    return [(k * 3, text(), r.choice(["en"] * 12 + ["fr", "de", "", "Z", "é"] + [None] * 3), r.choice([None, "web", ""]), r.choice([None, k])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_proofs_are_those_of_brute_force(spark, n):
    rows = made(n)
    df = spark.createDataFrame(rows, DOCS).repartition(3).select("*", *[F.lit("clash").alias(c) for c in ("tree", "pos", "size", "leaf", "seen", "run", "level", "path", "subroot", "of", "at", "copy")])
    assert proven(df) == brute.manifest(rows, third)


def test_proofs_of_many_languages_repeated_and_null_ids(spark):
    rows = [(k, f"Text {k}", f"lang{k % 75:02d}", "s", 1) for k in range(150)]
    rows += [(5, "Text 5", "lang05", "s", 1)] * 9 + [(None, "No id", "lang07", None, None), (None, None, None, None, None), (None, None, None, None, None)]
    assert proven(spark.createDataFrame(rows, DOCS)) == brute.manifest(rows, third)
    assert proven(spark.createDataFrame([], DOCS)) == []


def test_proofs_of_the_table(spark, sf_dir):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, sf_dir).collect()), key=repr)
    assert got == brute.manifest(rows, third)
    assert {r[-1] for r in got} == {True, False}
