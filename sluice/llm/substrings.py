"""Exact substring dedup by recompression (operator 4).

Rounds of recompression turn a text, seen as a string of word hashes, into ever fewer symbols.
A round names pairs of neighbours: the symbols are parted into left and right ones by
a hash bit, and each left one followed by a right one becomes one new symbol. The first round
also names maximal runs of a repeated word. A name is a hash of what it replaces, so all tasks
give the same name to the same thing without a dictionary to pass around.

Whether two neighbours merge depends on the two alone, so equal substrings get the same symbols
but for their ends. For every window of 35 words, each level has a stretch of blocks that the
window alone determines, whatever stands around it. Its *anchor* is the first such block of
the highest level that has one. Equal windows have equal anchors, at the same place.

Two shuffles settle everything exactly:

1. Each range of windows with one anchor is sent once, under the anchor's name and a 64-bit hash of all words
   that its windows cover. An anchor found only once in the corpus rules all its windows out. Equal
   anchors with equal words settle all windows of the range at once, so long repeats are
   verified by the symbols that they share, not window by window.
2. The windows left over, where texts agree around an anchor only in part, are compared by 128-bit hashes of their words.
   Of settled ranges whose anchor is also found with other words, one place tells its windows to these.

A key that a batch of documents holds twice needs no answer from other tasks; the batch sends one row to
tell them. So a passage that a third of all documents share is one row per batch under
its key, and the rows that carry its places are spread by document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Workspace, bounded_batches, table, without_gc

#: Rounds of pair naming: the mean block of the last level has about seven words.
ROUNDS = 7
#: Words of a batch that are settled together within a task.
BATCH_WORDS = 600_000
CACHE_WORDS = 250_000
SEED = 20_240_607


def _mix(x):
    """A 64-bit finaliser for numpy arrays of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a, b):
    import numpy as np

    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + _mix(b + np.uint64(0xD6E8FEB86659FD93)))


class WordHashes(dict):
    """64-bit hashes of words (bytes); each is computed once."""

    def __missing__(self, w):
        import xxhash

        h = self[w] = xxhash.xxh64_intdigest(w, SEED)
        return h

    def of(self, text: str | None):
        import numpy as np

        if len(self) > CACHE_WORDS:
            self.clear()
        found = text.encode().split() if text else []
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def anchors(h, ends, width: int):
    """For every position, the name of the anchor of the window that starts there, and where it starts.

    h: word hashes of several documents in a row. ends: the end of the document that each
    position belongs to. Positions whose window would leave their document get anchor 0, place -1.

    ``first[p]`` and ``last[p]`` delimit, as block numbers of the current level, the blocks
    that window p determines: [first, last).
    """
    import numpy as np

    n = len(h)
    at = np.arange(n)
    full = at + width <= ends
    name, place = np.zeros(n, np.uint64), np.full(n, -1)
    if not full.any():
        return name, place
    # level 0: runs of a word. A window's first and last run may go on outside, so they are left out.
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (ends[1:] != ends[:-1])
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, n))
    symbols = np.where(lengths > 1, _pair(h[starts], lengths.astype(np.uint64)), h[starts])
    owner = ends[starts]
    block_of = np.cumsum(fresh) - 1
    stop = np.minimum(at + width, n) - 1
    first, last = block_of + 1, block_of[stop]  # blocks wholly inside and neither at an edge
    # a window within one run is its own kind of anchor: the word itself
    name = np.where(full, _mix(h + np.uint64(1)), name)
    place = np.where(full, at, place)
    for level in range(ROUNDS + 1):
        has = full & (first < last)
        block = np.where(has, first, 0)
        name = np.where(has, symbols[block] + np.uint64(level + 2), name)
        place = np.where(has, starts[block], place)
        if level == ROUNDS or not has.any():
            break
        right = (_mix(symbols + np.uint64(0xA5A5 + 977 * level)) >> np.uint64(63)).astype(bool)
        taken = np.zeros(len(symbols), bool)  # by the block before it
        taken[1:] = ~right[:-1] & right[1:] & (owner[1:] == owner[:-1])
        number, head = np.cumsum(~taken) - 1, np.flatnonzero(~taken)
        takes = np.append(taken[1:], False)[head]
        after = np.minimum(head + 1, len(symbols) - 1)
        # A right block at the start may be taken by what stands before the window, a left block
        # at the end may take what comes after it: neither is determined by the window.
        end = np.where(has, last - 1, 0)
        first = block + right[block]
        last = end + right[end]
        has &= first < last
        first, last = np.where(has, number[np.where(has, first, 0)], 1), np.where(has, number[np.where(has, last - 1, 0)] + 1, 0)
        symbols, starts, owner = np.where(takes, _pair(symbols[head] + np.uint64(level + 1), symbols[after]), symbols[head]), starts[head], owner[head]
    return name, place


def window_hashes(h, at, width: int, count: int = 2):
    """``count`` 64-bit hashes of the ``width`` words from each position in ``at``: all words by doubling."""
    import numpy as np

    lanes = []
    for lane in range(1, count + 1):
        level = _mix(h + np.uint64(lane))
        size, done, total = 1, 0, np.zeros(len(at), np.uint64)
        while True:
            if width & size:
                total = _pair(total, level[np.minimum(at + done, len(level) - 1)])
                done += size
            if done == width:
                break
            level = np.append(_pair(level[:-size], level[size:]), np.zeros(min(size, len(level)), np.uint64))
            size *= 2
        lanes.append(total.view(np.int64))
    return lanes


def batches_of_words(batches: Iterator, text_col: int, hashes: WordHashes):
    """(slice, h, ends, starts): word hashes of the documents of a slice of bounded size."""
    import numpy as np

    def give(batch, a, b, lists):
        sizes = np.array([len(x) for x in lists], np.int64)
        stops = np.cumsum(sizes)
        h = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        return batch.slice(a, b - a), h, np.repeat(stops, sizes), stops - sizes

    for batch in batches:
        lists, a, held = [], 0, 0
        for k, text in enumerate(batch.column(text_col)):
            lists.append(hashes.of(text.as_py()))
            held += len(lists[-1])
            if held >= BATCH_WORDS:
                yield give(batch, a, k + 1, lists)
                lists, a, held = [], k + 1, 0
        if lists:
            yield give(batch, a, batch.num_rows, lists)


#: Rows that say where a key is: k1, k2 (the key), u, v (the document; null: it only informs),
#: place: window start, number of windows and weight, packed. Weights: 1 is one place of the key, 2 are two or more;
#: SETTLED is a place whose windows need no answer, under a key of its own.
PLACES, SETTLED = "k1 long, k2 long, u long, v int, place long", 3
#: What is known of a range: to be compared; repeated; repeated, and others must hear of its windows.
OPEN, DONE, TELL = 0, 1, 2


def _rows(k1, k2, u, v, at, n, weight, nowhere=None):
    import numpy as np
    import pyarrow as pa

    none = np.zeros(len(k1), bool) if nowhere is None else nowhere
    place = (at.astype(np.int64) << 33) | (n.astype(np.int64) << 2) | weight
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(u, mask=none), pa.array(v, mask=none), pa.array(place)], names=["k1", "k2", "u", "v", "place"])


def _inform(k1, k2):
    """One row per key that says that it has two places or more, and no more."""
    import numpy as np

    zero = np.zeros(len(k1), np.int64)
    return _rows(k1, k2, zero, zero.astype(np.int32), zero, zero, 2, np.ones(len(k1), bool))


def _own_key(u, v, at, n, weight):
    """Rows for ranges under keys of their own; neighbouring ranges of one document travel as one row."""
    import numpy as np

    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (at[1:] != at[:-1] + n[:-1])
    heads = np.flatnonzero(new)
    n = np.add.reduceat(n, heads)
    u, v, at = u[heads], v[heads], at[heads]
    spread = _mix(u.view(np.uint64) + _mix(at.astype(np.uint64))).view(np.int64)
    return _rows(spread, spread, u, v, at, n, weight)


def _many(*keys):
    """For each key (one or more columns), whether it is here twice or more, and whether it is here for the first time."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    twice, first = np.zeros(len(order), bool), np.ones(len(order), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    first[order[1:]] = ~same  # lexsort is stable
    return twice, first


def _unpacked(col: str = "place"):
    return F.shiftright(col, 33).cast("int").alias("at"), F.shiftright(col, 2).bitwiseAND(2**31 - 1).cast("int").alias("n")


def remove_repeats(df: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept, removed array<struct<at,n>>) of every row.

    A word goes if a window of ``width`` words that covers it starts anywhere else too, in this
    or another document; windows are judged on the input. ``kept`` has the other words,
    joined by one space (``verbatim``: the text as it is, if none goes); ``removed`` the ranges taken out.
    A null or empty text has no words.
    Repeated rows are documents of their own, so each loses what it shares with the other.
    Null ids are fine; only the two named columns are read, but those in ``carry`` come along in
    a struct ``carried``.
    """
    bounded_batches(df.sparkSession)
    work = Workspace(df.sparkSession, "repeats")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    docs = docs.withColumns({"u": F.xxhash64("id", "text"), "v": F.hash("text")})

    def find_anchors(batches: Iterator) -> Iterator:
        import numpy as np

        hashes = WordHashes()
        with without_gc():
            for part, h, ends, starts in batches_of_words(batches, 1, hashes):
                name, place = anchors(h, ends, width)
                p = np.flatnonzero(place >= 0)
                if not len(p):
                    continue
                new = np.ones(len(p), bool)
                new[1:] = (place[p[1:]] != place[p[:-1]]) | (name[p[1:]] != name[p[:-1]]) | (ends[p[1:]] != ends[p[:-1]])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(p)))
                at = p[head]
                k1 = name[at].view(np.int64)
                # a range has at most ``width`` windows, so its first and its last one cover all its words
                (w,) = window_hashes(h, p, width, 1)
                k2 = _pair(w[head].view(np.uint64), w[head + n - 1].view(np.uint64) + n.astype(np.uint64)).view(np.int64)
                which = np.searchsorted(starts, at, side="right") - 1
                # empty documents share a start with the next one: the last of those has the words
                u, v, at = part.column(2).to_numpy()[which], part.column(3).to_numpy()[which], at - starts[which]
                same, first = _many(k1, k2)
                other = _many(k1)[0] & ~same
                rest = same & ~first
                if rest.any():
                    yield _own_key(u[rest], v[rest], at[rest], n[rest], SETTLED)
                if other.any():  # an anchor with several words around it here: its windows will be compared
                    yield _own_key(u[other], v[other], at[other], n[other], 2)
                    key = np.unique(k1[other])
                    yield _inform(key, np.zeros_like(key))
                yield _rows(k1[~rest & ~other], k2[~rest & ~other], *(x[~rest & ~other] for x in (u, v, at, n)), np.where(same, 2, 1)[~rest & ~other])

    def compare_windows(batches: Iterator) -> Iterator:
        import numpy as np

        hashes = WordHashes()
        with without_gc():
            for part, h, _, starts in batches_of_words(batches, 1, hashes):
                flat = part.column(4).flatten()
                counts = part.column(4).value_lengths().to_numpy(zero_copy_only=False)
                at, n, kind = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                # every window start, once; what is only told counts as told
                which = np.repeat(np.repeat(np.arange(part.num_rows), counts), n)
                p = np.repeat(at - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) + starts[which]
                order = np.lexsort((np.repeat(kind, n), p))
                p, which, tell = p[order], which[order], (np.repeat(kind, n) == TELL)[order]
                one = np.append(True, p[1:] != p[:-1])[: len(p)]
                p, which, tell = p[one], which[one], tell[one]
                if not len(p):
                    continue
                k1, k2 = window_hashes(h, p, width)
                u, v, at = part.column(2).to_numpy()[which], part.column(3).to_numpy()[which], p - starts[which]
                twice, first = _many(k1, k2)
                known = (twice | tell) & first  # keys that others must hear of
                if known.any():
                    yield _inform(k1[known], k2[known])
                mine = twice & ~tell
                if mine.any():
                    yield _own_key(u[mine], v[mine], at[mine], np.ones(mine.sum(), np.int64), SETTLED)
                mine = ~twice & ~tell
                yield _rows(k1[mine], k2[mine], u[mine], v[mine], at[mine], np.ones(mine.sum(), np.int64), 1)

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        spans = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                totals, gone, kept, removed = [], [], [], []
                for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    found = text.encode().split()
                    mark = np.zeros(len(found) + 1, np.int64)
                    for r in ranges or ():
                        mark[r["at"]] += 1
                        mark[r["at"] + r["n"] - 1 + width] -= 1
                    out = np.cumsum(mark)[:-1] > 0
                    totals.append(len(found))
                    gone.append(int(out.sum()))
                    kept.append((b" ".join([w for w, x in zip(found, out.tolist(), strict=True) if not x]) if gone[-1] else text.encode() if verbatim else b" ".join(found)).decode())
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                    removed.append([{"at": int(x), "n": int(y - x)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, spans), *batch.columns[3:]], names=["id", "n_words", "n_removed", "kept", "removed", *["carried"][: bool(carry)]])

    extra = ["carried"] if carry else []
    weight = F.col("place").bitwiseAND(3)
    anchor, span = Window.partitionBy("k1"), Window.partitionBy("k1", "k2")
    rows = docs.select("id", "text", "u", "v").mapInArrow(find_anchors, PLACES)
    rows = rows.select("*", F.sum(weight).over(anchor).alias("total"), F.sum(weight).over(span).alias("same"), F.max("u").over(span).alias("voice"), F.min("k2").over(anchor).alias("low"), F.max("k2").over(anchor).alias("high"))
    repeated = (weight == SETTLED) | (F.col("same") > 1) & ((weight == 1) | (F.col("k1") != F.col("k2")))
    kind = F.when(~repeated, OPEN).when((weight != SETTLED) & (F.col("low") != F.col("high")) & (F.col("u") == F.col("voice")), TELL).otherwise(DONE)
    rows = rows.where("total > 1 and u is not null").select("u", "v", *_unpacked(), kind.alias("kind"))
    ranges = work.save(rows.groupBy("u", "v").agg(F.collect_list(F.struct("at", "n", "kind")).alias("ranges")), "ranges")
    listen = F.filter("ranges", lambda r: r["kind"] != DONE)
    told = docs.join(ranges.select("u", "v", listen.alias("ranges")).where("size(ranges) > 0"), ["u", "v"]).select("id", "text", "u", "v", "ranges")
    rows = told.mapInArrow(compare_windows, PLACES).withColumn("total", F.sum(weight).over(Window.partitionBy("k1", "k2")))
    found = rows.where("total > 1 and u is not null").select("u", "v", *_unpacked())
    done = ranges.select("u", "v", F.explode(F.filter("ranges", lambda r: r["kind"] != OPEN)).alias("r")).select("u", "v", "r.at", "r.n")
    marks = found.union(done).groupBy("u", "v").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))
    final = docs.join(marks, ["u", "v"], "left").select("id", "text", "ranges", *extra)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"id {kinds['id']}, n_words long, n_removed long, kept string, removed array<struct<at:int,n:int>>"
    schema += f", carried {kinds['carried']}" if carry else ""
    return final.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated windows of 35 words."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) t(i)
), r AS (
  SELECT h FROM x GROUP BY h HAVING count(*) > 1
), s AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM x JOIN r ON x.h = r.h, range(35) g(k)
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM s GROUP BY doc_id
), words AS (
  SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) t(j)
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM words
  LEFT JOIN s ON s.doc_id = words.doc_id AND s.pos = words.j WHERE s.pos IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
