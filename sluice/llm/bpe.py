"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 5).

A text is halved until the halves are small, the leaves are encoded, and neighbours
are joined up the tree. Two levels use the same scheme:

* Text level. The elements are lists of pretokens. Halves are cut anywhere, so only
  the pretokens near a seam can be wrong. A seam window is split again and grows until
  both its edges lie between a non-space and a space. No match of the pattern spans
  such a place and none looks across it, so pretokens outside provably stay.
* Pretoken level. The elements are token lists. A seam window is merged again and grows
  until the tokens on both sides of each window edge are *compatible*: merging the bytes
  of the two alone gives back the same two. A list of tokens whose neighbours are all
  compatible is the BPE encoding of its bytes, so tokens outside provably stay.

Decoding is a homomorphism into bytes: halves are decoded and concatenated up the tree.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, table, text_or_empty, without_gc

#: Leaf sizes of the two trees, and of the decoding tree.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 1024, 12, 1024
#: Entries that a worker keeps for repeated pretokens before it starts afresh.
CACHE_ENTRIES = 400_000
#: Up to this length a plain list beats a heap for merging.
SHORT_BYTES, NO_RANK = 48, 1 << 60

class BytePairMonoid:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, rank_file: str, pattern: str):
        import sys
        import unicodedata

        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = {b: a for a, b in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.is_space = regex.compile(r"\s").match
        # The same pattern for the faster standard module, whose \w and \s hold a few
        # characters more; texts with one of those are split by the exact pattern.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        if r"\p" not in plain:
            letter, number, space = (regex.compile(x).match for x in (r"\p{L}", r"\p{N}", r"\s"))
            like, digit, blank = (re.compile(x).match for x in (r"[^\W\d_]", r"\d", r"\s"))
            every = (chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) != "Cn" or like(chr(c)))
            odd = [c for c in every if bool(letter(c)) != bool(like(c)) or bool(number(c)) != bool(digit(c)) or bool(space(c)) != bool(blank(c))]
            usual, exact, fast = frozenset(odd).isdisjoint, self.split, re.compile(plain).findall
            self.split = lambda text: fast(text) if usual(text) else exact(text)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # ---- pretoken level -------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: the lowest-ranked neighbours first, leftmost among equals."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, ranks = len(data), self.ranks
        if n <= SHORT_BYTES:
            parts = [data[i : i + 1] for i in range(n)]
            order = [ranks.get(data[i : i + 2], NO_RANK) for i in range(n - 1)]
            while order and (r := min(order)) != NO_RANK:
                i = order.index(r)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del order[i]
                if i:
                    order[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
                if i < len(order):
                    order[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
            return [ranks[x] for x in parts]
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        prev = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop or mid >= stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                r = ranks.get(data[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            before = prev[i]
            if before >= 0:
                r = ranks.get(data[before:stop])
                if r is not None:
                    heapq.heappush(heap, (r, before, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.table[a] + self.table[b]) == [a, b]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            mid = self.merge(b"".join(map(self.table.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.compatible(left[a - 1], mid[0])) and (b == len(right) or self.compatible(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            k *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES or data in self.ranks:
            return self.merge(data) if data else []
        mid = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:mid]), self.encode_bytes(data[mid:]))

    def encode_pretoken(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = tuple(self.encode_bytes(piece.encode()))
            if len(piece) < 64:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    # ---- text level -----------------------------------------------------
    def _stable(self, before: str, after: str) -> bool:
        return not self.is_space(before[-1]) and bool(self.is_space(after[0]))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            if (a == 0 or self._stable(left[a - 1], left[a])) and (b == len(right) or self._stable(right[b - 1], right[b])):
                mid = self.split("".join(left[a:] + right[:b]))
                del left[a:]
                left += mid
                left += right[b:]
                return left
            k *= 2

    def pretokens(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.split(text)
        mid = len(text) // 2
        return self.join_pieces(self.pretokens(text[:mid]), self.pretokens(text[mid:]))

    def encode(self, text: str) -> list[int]:
        pieces, cache = self.pretokens(text), self.cache
        try:
            return list(chain.from_iterable([cache[p] for p in pieces]))
        except KeyError:
            return list(chain.from_iterable(map(self.encode_pretoken, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.table.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def _monoid(rank_file: str, pattern: str) -> BytePairMonoid:
    """One per Python worker and vocabulary."""
    return BytePairMonoid(rank_file, pattern)


def default_vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Rows that are encoded or decoded together.
BATCH_DOCS = 500


def _id_lists(lists: list[list[int]]):
    """Lists of token ids as an Arrow column."""
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _pass(df: DataFrame, columns: list, schema: str, rank_file: str | None, pattern: str | None, id_col: str, work) -> DataFrame:
    """One pass of Arrow batches over (id, column): ``work(monoid, column)`` gives the other output columns."""
    path, pat = default_vocabulary()
    path, pat = rank_file or path, pattern or pat

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = _monoid(path, pat)
        with without_gc():
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH_DOCS):
                    batch = whole.slice(at, BATCH_DOCS)
                    out = [batch.column(0), *work(bpe, batch.column(1))]
                    yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])

    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), *columns).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>) for every row: the token ids of the whole text.

    A null or empty text has no tokens. Rows are independent, so repeated rows and null
    ids simply come back as they are; other columns are ignored, whatever their names.
    No shuffle: one pass over the two columns.
    """

    def work(bpe, texts):
        return [_id_lists([bpe.encode(t) for t in texts.to_pylist()])]

    return _pass(df, [text_or_empty(text_col).alias("text")], "ids array<int>", rank_file, pattern, id_col, work)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str | None = None) -> DataFrame:
    """(id, ids, decoded binary) for every row; null ids or an id outside the vocabulary give null."""

    def work(bpe, ids):
        import pyarrow as pa

        def one(k, a, n):
            try:
                return bpe.decode(flat[a : a + n]) if valid[k] else None
            except KeyError:
                return None

        valid = ids.is_valid().to_pylist()
        flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
        sizes = [n or 0 for n in ids.value_lengths().to_pylist()]
        return [ids, pa.array([one(k, a - n, n) for k, (a, n) in enumerate(zip(accumulate(sizes), sizes, strict=True))], pa.binary())]

    return _pass(df, [F.col(ids_col).alias("ids")], "ids array<int>, decoded binary", rank_file, None, id_col, work)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids, decoded binary): what ``decode(encode(df))`` gives, in one pass, so the ids needn't come back to be decoded."""

    def work(bpe, texts):
        import pyarrow as pa

        lists = [bpe.encode(t) for t in texts.to_pylist()]
        return [_id_lists(lists), pa.array([bpe.decode(x) for x in lists], pa.binary())]

    return _pass(df, [text_or_empty(text_col).alias("text")], "ids array<int>, decoded binary", rank_file, pattern, id_col, work)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole document."""
    out = round_trip(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
