"""Token-id files compressed by Re-Pair (operator 12).

Documents are sorted by id over range partitions; each task encodes its range and writes blocks
of whole documents. A block is a grammar: again and again the frequent pairs of neighbouring
ids become new ids (nonterminals), the more frequent pair first where two overlap, until no pair is
frequent. It stores the rules, the number of ids that each rule stands for, and what is left of the
sequence; the sums of those numbers say where any id is, so that a range is decoded without
the rest. Blocks are rows of Parquet, which Spark commits task by task on any file system.

Encoding asks the library for words that a task hasn't met lately: a text may be cut before every
space that a non-space follows, since no pretoken of a byte-level tokenizer with this pattern
reaches over such a place, and none looks past it.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import scratch, table, without_gc

#: Ids of a block (one longer document is a block of its own), least uses of a rule, rounds of pairs.
BLOCK_IDS, LEAST_USES, ROUNDS = 1 << 18, 8, 4
#: Bits of the hash that finds pairs which may be frequent.
HASH_BITS = 18
#: Words of a generation of a task's memory, characters up to which a word is kept, words encoded by one call.
MEMO_WORDS, MEMO_CHARS, JOINED_WORDS = 600_000, 40, 2_000
#: Texts and characters that are encoded at once.
BATCH_TEXTS, BATCH_CHARS = 2_048, 8_000_000
#: What a space can be cut off before: neither white space nor a control character.
CUT = re.compile(r"[^\s\x00-\x20\x7f-\xa0]")
#: Latin letters, up to which character they go, and signs. All are so in every version of Unicode.
LETTERS, LATIN_END = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", 0x250
#: A word's parts that no pretoken reaches over: letters and digits, signs, a line break with letters after it, signs.
PARTS = rf"^(?P<stem>[0-9{LETTERS}]+)(?P<tail>[[:punct:]]{{0,3}})(?:(?P<line>\n[{LETTERS}]+)(?P<end>[[:punct:]]{{0,3}}))?$"
BLOCK = "part int, block int, at long, n_ids long, first_doc long, last_doc long, doc_ids array<long>, counts array<int>, base int, width int, rules binary, lengths binary, sequence binary"


def tokenizer(path: str):
    """The tokenizer of a file; strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Encoder:
    """Ids of texts by the library, as bytes of little-endian numbers of ``width`` bytes, with a bounded memory of words.

    A word is what lies between two places to cut, without its space. Words that a batch doesn't know are encoded by
    one call for many, joined as they would be in a text; the bytes that each id stands for tell where a word ends.
    Signs and further lines in a word are cut off and looked up apart. Latin letters are a pretoken as they are, so
    they go to the library's model without its splitting.
    Words live in two generations: one that is met again moves to the young one, and when that is full the old one goes.
    """

    def __init__(self, path: str):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        self.t = tokenizer(path)
        vocab = self.t.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # in a byte-level vocabulary each character is a byte
        for token, k in vocab.items():
            self.sizes[k] = len(token)
        self.model = self._model_alone(vocab)
        self.words: list[dict[str, bytes]] = [{}, {}]  # the young generation, the old one
        self.lines: list[dict[str, bytes]] = [{}, {}]
        self.tails: dict[str, bytes] = {}  # of up to three signs

    def _bytes(self, ids: list[int]) -> bytes:
        import numpy as np

        return np.array(ids, f"<u{self.width}").tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_alone(self, vocab: dict[str, int]):
        """The library's model, which takes words in its byte-level characters as pretokens, parted by spaces; None
        where the tokenizer does more to a word of letters than to write its bytes so."""
        import numpy as np
        from tokenizers import Tokenizer, models, pre_tokenizers

        way, added = self.t.pre_tokenizer, self.t.get_added_tokens_decoder().values()
        plain = isinstance(way, pre_tokenizers.ByteLevel) and way.use_regex and isinstance(self.t.model, models.BPE) and self.t.normalizer is None
        if not plain or self.t.truncation or self.t.padding or any(a.content.strip().isalpha() for a in added):
            return None
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = sorted(set(range(256)).difference(kept))
        self.signs = np.arange(256, dtype="<u2")
        self.signs[others] = 256 + np.arange(len(others))
        self.signs[[0, 32]] = self.signs[32], 32  # in a list of words: the space before one, and what parts them
        alone = Tokenizer(self.t.model)
        alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return alone

    def _cut(self, tokenizer, text: str, ends) -> list[bytes]:
        """The ids of a text, cut where so many bytes are told."""
        import numpy as np

        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends = (self.width * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _signed(self, data) -> str:
        return self.signs[data].tobytes().decode("utf-16-le")

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of each word after a space; those of Latin letters alone by the model."""
        import numpy as np

        text = " ".join(words) + " "
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.flatnonzero(data == 32) + 1
        if not self.model or not "".join(words).isalpha() or np.frombuffer(text.encode("utf-16-le"), "<u2").max() >= LATIN_END:
            return self._cut(self.t, " " + text[:-1], ends)
        return self._cut(self.model, self._signed(np.insert(data[:-1], np.concatenate([[0], ends[:-1]]), 0)), ends)

    def _lines(self, lines: list[str]) -> list[bytes]:
        """The ids of each line break with letters after it."""
        import numpy as np

        if not self.model:
            return self._each(lines)
        data = np.frombuffer("".join(lines).encode(), np.uint8)
        at = np.flatnonzero(data == 10)
        return self._cut(self.model, self._signed(np.insert(data, np.concatenate([at + 1, at[1:]]), 32)), [*at[1:], len(data)])

    @staticmethod
    def _kinds(words: list[str]) -> list[list[str]]:
        """Words of Latin letters and other words, without those that a space can't be cut off before."""
        letters = list(filter(str.isalpha, words))
        latin = [w for w in letters if w.isascii() or ord(max(w)) < LATIN_END]
        return [latin, list(filter(CUT.match, set(words).difference(latin)))]

    def _recall(self, words: list[str], memory: list[dict[str, bytes]], encode, kinds=lambda words: [words]):
        """An Arrow array of the words' ids: from memory, or as ``encode`` says for each of ``kinds``; null for words of no kind."""
        import pyarrow as pa

        if len(memory[0]) > MEMO_WORDS:
            memory[:] = {}, memory[0]
        young, old = memory
        found = list(map(young.get, words))
        places = [k for k, ids in enumerate(found) if ids is None]
        new = [words[k] for k in places]
        again = list(map(old.get, new))
        young.update((w, ids) for w, ids in zip(new, again, strict=True) if ids is not None)
        for group in kinds([w for w, ids in zip(new, again, strict=True) if ids is None]):
            for k in range(0, len(group), JOINED_WORDS):
                young.update(zip(group[k : k + JOINED_WORDS], encode(group[k : k + JOINED_WORDS]), strict=True))
        for k, w in zip(places, new, strict=True):
            found[k] = young.get(w)
        for w in new:
            if len(w) > MEMO_CHARS:  # hardly comes again
                young.pop(w, None)
        return pa.array(found, pa.large_binary())

    def _words(self, words):
        """Arrow arrays of different words and of the ids of each after a space, null where it can't be cut off."""
        import pyarrow as pa
        import pyarrow.compute as pc

        listed = lambda a: a.to_numpy(zero_copy_only=False).tolist()
        found = pc.extract_regex(words, PARTS)
        part = lambda n: pc.fill_null(pc.struct_field(found, n), "").dictionary_encode()
        stem, line = pc.coalesce(pc.struct_field(found, "stem"), words).dictionary_encode(), part("line")
        of_lines = listed(line.dictionary)
        ids = [self._recall(listed(stem.dictionary), self.words, self._joined, self._kinds).take(stem.indices)]
        for signs in (part("tail"), part("end")):
            told = listed(signs.dictionary)
            unknown = [x for x in told if x not in self.tails]
            self.tails.update(zip(unknown, self._each(unknown), strict=True))
            ids.append(pa.array([self.tails[x] for x in told], pa.large_binary()).take(signs.indices))
        ids.insert(2, self._recall([x for x in of_lines if x], self.lines, self._lines))
        blank = of_lines.index("") if "" in of_lines else len(of_lines)
        ids[2] = pa.concat_arrays([ids[2][:blank], pa.array([b""], pa.large_binary()), ids[2][blank:]]).take(line.indices)
        return pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))

    def batch(self, texts) -> list[bytes]:
        """The ids of each text of a list or an Arrow array of strings, without nulls.

        Words are numbered by their dictionary in Arrow, so that Python meets each different word of the batch once;
        the ids of a text are then picked from those of the words.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return []
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        parts = pc.split_pattern(texts, " ")
        starts = parts.offsets.to_numpy().astype(np.int64)
        starts, ends = starts[:-1] - starts[0], starts[1:] - starts[0]
        words = parts.flatten()
        coded, heads = words.dictionary_encode(), words.take(starts).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[starts] = len(coded.dictionary) + heads.indices.to_numpy()
        listed = lambda a: a.to_numpy(zero_copy_only=False).tolist()
        known, first = self._words(coded.dictionary), pa.array(self._each(listed(heads.dictionary)), pa.large_binary())
        pieces, odd = [known, first], np.zeros(len(known) + len(first), bool)
        odd[: len(known)] = known.is_null().to_numpy(zero_copy_only=False)
        if odd.any() and (bad := np.logical_or.reduceat(odd[codes], starts)).any():
            # texts with a space that isn't a place to cut are encoded whole: one piece each, in their first word's place
            whole = np.flatnonzero(bad)
            codes[starts[whole]] = len(odd) + np.arange(len(whole))
            pieces.append(pa.array(self._each(listed(texts.take(whole))), pa.large_binary()))
            keep = ~np.repeat(bad, ends - starts)
            keep[starts] = True
            codes, ends = codes[keep], np.cumsum(keep)[ends - 1]
        taken = pa.concat_arrays(pieces).take(pa.array(codes))
        _, bounds, data = taken.buffers()
        until = np.frombuffer(bounds, np.int64)[ends].tolist()
        out = data.to_pybytes() if data else b""
        return [out[a:b] for a, b in zip([0, *until[:-1]], until, strict=True)]


def compress(ids, base: int, least: int = LEAST_USES, rounds: int = ROUNDS):
    """(rules, sequence): rules[k] is the pair that base + k stands for; pairs hold smaller ids only.

    Every round names all pairs that occur ``least`` times or more. Where two of them overlap the more
    frequent is replaced, and of a run of one pair every other; the rest wait for the next round.
    """
    import numpy as np

    seq, rules, n_rules = np.asarray(ids, np.uint64), [], 0
    for _ in range(rounds):
        if len(seq) < 2 * least:
            break
        key = (seq[:-1] << np.uint64(32)) | seq[1:]
        # counts by hash are never too small, so pairs that may be frequent are found without sorting all
        hashed = lambda k: ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).view(np.int64)
        bucket = hashed(key)
        places = np.flatnonzero(np.bincount(bucket, minlength=1 << HASH_BITS)[bucket] >= least)
        found = key[places]
        pairs, counts = np.unique(found, return_counts=True)
        often = counts >= least
        pairs, counts = pairs[often], counts[often]
        if not len(pairs):
            break
        rank_of = np.empty(len(pairs), np.int64)
        rank_of[np.lexsort((pairs, -counts))] = np.arange(len(pairs))
        last = np.zeros(1 << HASH_BITS, np.int64)
        last[hashed(pairs)] = np.arange(len(pairs))
        at = last[bucket[places]]
        hit = pairs[at] == found
        other = np.flatnonzero(~hit)  # rare pairs, and frequent ones that share their hash with another
        at[other] = np.minimum(np.searchsorted(pairs, found[other]), len(pairs) - 1)
        hit[other] = pairs[at[other]] == found[other]
        rank = np.full(len(key) + 2, len(pairs), np.int64)  # one place more on either side
        rank[places[hit] + 1] = rank_of[at[hit]]
        places = places[hit]
        own = rank[places + 1]
        left = rank[places]
        starts = np.maximum.accumulate(np.where(left == own, 0, places))  # where a run of one pair begins
        take = (own <= left) & (own <= rank[places + 2]) & ((places - starts) % 2 == 0)
        places, own = places[take], own[take]
        uses = np.bincount(own, minlength=len(pairs))
        named = uses >= least
        if not named.any():
            break
        by_rank = np.empty(len(pairs), np.uint64)
        by_rank[rank_of] = pairs
        name = (base + n_rules + np.cumsum(named) - 1).astype(np.uint64)
        rules.append(by_rank[named])
        n_rules += len(rules[-1])
        take = named[own]
        places, own = places[take], own[take]
        seq = seq.copy()
        seq[places] = name[own]
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq = seq[keep]
    pairs = np.concatenate([np.empty(0, np.uint64), *rules])
    return np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64), seq.astype(np.int64)


def rule_lengths(rules, base: int):
    """How many ids each rule stands for."""
    import numpy as np

    rules = np.asarray(rules, np.int64)
    named, lengths = rules >= base, np.full(len(rules), 2, np.int64)
    below = np.where(named, rules - base, 0)
    while len(rules):  # as often as rules lie within rules
        more = np.where(named, lengths[below], 1).sum(axis=1)
        if (more == lengths).all():
            break
        lengths = more
    return lengths


def expand(sequence, rules, base: int):
    """The ids that a sequence stands for.

    What each rule stands for is written out once, from the rules before it; the symbols of the sequence then pick their stretches.
    """
    import numpy as np
    import pyarrow as pa

    seq = np.asarray(sequence, np.int64)
    rules = np.asarray(rules, np.int64)[: max(0, int(seq.max(initial=0)) - base + 1)]
    texts: list[bytes] = []
    for a, b in rules.tolist():
        texts.append((texts[a - base] if a >= base else a.to_bytes(4, "little")) + (texts[b - base] if b >= base else b.to_bytes(4, "little")))
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), base, [None, pa.py_buffer(np.arange(0, 4 * base + 1, 4, dtype=np.int64)), pa.py_buffer(np.arange(base, dtype="<u4"))])
    found = pa.concat_arrays([plain, pa.array(texts, pa.large_binary())]).take(pa.array(seq))
    return np.frombuffer(found.buffers()[2] or b"", "<u4").astype(np.int64)


def decode_range(sequence, rules, lengths, base: int, start: int, n: int):
    """ids[start : start + n]; only the symbols that cover them are expanded."""
    import numpy as np

    sequence = np.asarray(sequence, np.int64)
    named = sequence >= base
    sizes = np.ones(len(sequence), np.int64)
    sizes[named] = lengths[sequence[named] - base]
    ends = np.cumsum(sizes)
    first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + n, "left"))
    skip = start - (int(ends[first - 1]) if first else 0)
    return expand(sequence[first : last + 1], rules, base)[skip : skip + n]


def _numbers(data: bytes, width: int):
    import numpy as np

    return np.frombuffer(data, f"<u{width}").astype(np.int64)


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that words stay known from task to task."""
    return Encoder(path)


def _texts(batches: Iterator) -> Iterator:
    """(ids, Arrow array of texts) of a bounded size from Arrow batches of both."""
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        at, n, chars = 0, 0, 0
        for k in range(batch.num_rows):
            chars += len(texts[k].as_buffer())
            n += 1
            if n >= BATCH_TEXTS or chars >= BATCH_CHARS or k == batch.num_rows - 1:
                yield docs[at : k + 1], texts.slice(at, n)
                at, n, chars = k + 1, 0, 0


def write(docs: DataFrame, path: str, tokens: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token-id file of ``docs`` below ``path``: blocks in ascending order of ids over (part, block).

    A null text is empty (its only id is the end); a null id comes first; rows that repeat an id are ordered by text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.hash("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = encoder_of(tokens), TaskContext.get().partitionId()
        base = max(encoder.t.get_vocab_size(), end_id + 1)
        shape = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}[k]) for n, k in (c.split(" ") for c in BLOCK.split(", "))])
        size = 4 if end_id >= 1 << 16 else encoder.width
        end, held, total, block, at = np.array([end_id], f"<u{size}").tobytes(), [], 0, 0, 0

        def flush():
            nonlocal held, total, block, at
            ids = np.frombuffer(b"".join(x for _, x in held), f"<u{size}")
            rules, sequence = compress(ids, base)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            as_bytes = lambda a: a.astype(f"<u{width}").tobytes()
            known = [d for d, _ in held if d is not None]
            row = {
                "part": part, "block": block, "at": at, "n_ids": len(ids), "first_doc": min(known, default=None), "last_doc": max(known, default=None), "doc_ids": [d for d, _ in held], "counts": [len(x) // size for _, x in held],
                "base": base, "width": width, "rules": as_bytes(rules.ravel()), "lengths": rule_lengths(rules, base).astype("<u4").tobytes(), "sequence": as_bytes(sequence),
            }
            held, total, block, at = [], 0, block + 1, at + len(ids)
            return pa.RecordBatch.from_pylist([row], shape)

        for docs, texts in _texts(batches):
            with without_gc():
                found = encoder.batch(texts)
            for doc, ids in zip(docs, found, strict=True):
                if size > encoder.width:
                    ids = np.frombuffer(ids, f"<u{encoder.width}").astype("<u4").tobytes()
                n = len(ids) // size + 1
                if held and total + n > BLOCK_IDS:
                    yield flush()
                held.append((doc, ids + end))
                total += n
        if held:
            yield flush()

    rows.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids of all parts before each. One row per written part, so the window is short."""
    parts = spark.read.schema(BLOCK).parquet(path).groupBy("part").agg(F.max(F.col("at") + F.col("n_ids")).alias("n"))
    return parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def read(spark: SparkSession, path: str, wanted: list[int] | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents of a file.

    With ``wanted`` (a short list) only blocks whose range of ids can hold one are read, and only the wanted documents
    are decoded from them. An empty file gives no rows.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    if wanted is not None:
        from functools import reduce

        blocks = blocks.where(reduce(lambda a, b: a | b, [F.lit(w).between(F.col("first_doc"), F.col("last_doc")) for w in wanted], F.lit(False)))
    asked = None if wanted is None else set(wanted)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for b in range(batch.num_rows):
                row = {n: batch.column(k)[b] for k, n in enumerate(batch.schema.names)}
                part, first, base, width = (row[n].as_py() for n in ("part", "at", "base", "width"))
                rules, sequence = _numbers(row["rules"].as_py(), width).reshape(-1, 2), _numbers(row["sequence"].as_py(), width)
                docs, counts = row["doc_ids"].values, row["counts"].values.to_numpy().astype(np.int64)
                at = np.cumsum(counts) - counts
                if asked is None:
                    chosen = np.arange(len(counts))
                    flat = memoryview(expand(sequence, rules, base).astype("<u4").tobytes())
                    found = [flat[4 * s : 4 * (s + n)] for s, n in zip(at.tolist(), counts.tolist(), strict=True)]
                else:
                    chosen = np.array([k for k, d in enumerate(docs.to_pylist()) if d in asked], np.int64)
                    lengths = _numbers(row["lengths"].as_py(), 4)
                    found = [decode_range(sequence, rules, lengths, base, int(at[k]), int(counts[k])).astype("<u4").tobytes() for k in chosen]
                cols = {"part": pa.array([part] * len(chosen), pa.int32()), "doc_id": docs.take(pa.array(chosen)), "own": pa.array(first + at[chosen]), "n_tokens": pa.array(counts[chosen]), "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64())}
                if ids:
                    cols["ids"] = pa.array([np.frombuffer(x, "<u4").tolist() for x in found], pa.list_(pa.int32()))
                yield pa.record_batch(cols)

    more = ["ids"] if ids else []
    found = blocks.mapInArrow(run, "part int, doc_id long, own long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    return found.join(starts(spark, path), "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", *more)


def op12_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document to a token file and reports each document from what it reads back."""
    import public_tokenizers

    path = scratch(spark, "token-file")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
