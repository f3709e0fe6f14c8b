"""Near-duplicates by MinHash with tensored banding (operator 7).

A document's set is its distinct 5-word shingles. Two small collections of hashes, A and B,
have m tuples of r minima each. Tables are keyed by pairs (A_i, B_j), so m * m tables of
2 * r minima come from only 2 * m * r hash functions, about the square root of what as many
independent tables would need. A pair with Jaccard similarity s meets in some table with
probability (1 - (1 - s^r)^m)^2; with r = 3 and m = 18 a pair right at 0.75 is missed with
a probability of 1e-4, one at 0.8 with 5e-6. Nothing else can lose a link.

Two documents share a table if they share a tuple of A and a tuple of B. So the m * m table keys
needn't be written out: rows are dealt by the tuples of A and carry those of B.

From candidates to components:

1. Documents with equal sets form one class, represented by its smallest id.
2. Only documents with a tuple of A and one of B that another class has, too, go on (``colliding``).
3. A shingle that no other open document has can't be in a link, so a document with too many of those is
   out (``reach``), exactly and without looking at pairs.
4. In every bucket all members are compared with a pivot: a number of pairs linear in the bucket. Pairs
   are verified on the full sets; links give components. The first pivots are the documents that
   share most of their set with others, such as the origin of a group of near copies.
5. Shingles that only one component has can't be in a new link: what is left of each set is its *kernel*.
   Members of different components that share a table are compared in full at the end, if their sizes,
   their kernels and what these have in common with the bucket's pivot allow a link. So copies
   never make all pairs of a group, and no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Workspace, bounded_batches, table, without_gc

#: Fixed seed of all hash functions, so that reruns agree.
SEED = 20_240_607
#: Rounds of pivots. In the first, all buckets prefer the same pivots; later, buckets whose keys agree
#: modulo the spread do. They only save work: what is open after the last is compared in full.
SPREADS = (1, 8, 64)
#: Rounds go on while the last one ruled out, or linked, more than this share of the open documents.
WORTH = 0.05
#: Shingles that are hashed at a time, and documents of a batch.
BLOCK_SHINGLES, BATCH_DOCS = 4096, 500


@dataclass(frozen=True)
class Banding:
    """tuple_size r and tuples m of each collection; percent: the least similarity to link."""

    tuple_size: int = 3
    tuples: int = 18
    words: int = 5
    percent: int = 75


def _mix(x):
    """A 64-bit finaliser for numpy arrays of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of texts; words are hashed once per worker and then looked up."""

    CACHE = 250_000

    def __init__(self, words: int):
        import numpy as np
        import xxhash

        class Words(dict):
            def __missing__(self, w):
                h = self[w] = xxhash.xxh64_intdigest(w, SEED)
                return h

        self.np, self.words, self.hashes = np, words, Words()
        self.weights = _mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def set_of(self, text: str | None):
        """Sorted distinct 64-bit shingle hashes; empty without words.

        Words are the runs of anything but space and 0x09-0x0D, with A-Z in lower case, as bytes.lower and bytes.split have it.
        """
        np = self.np
        if len(self.hashes) > self.CACHE:
            self.hashes.clear()
        found = text.encode().lower().split() if text else []
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        if not len(h):
            return h
        if len(h) < self.words:  # the whole sequence is one shingle, unlike any of full length
            total = np.full(1, len(h), np.uint64)
            for k in range(len(h)):
                total = _mix(total + h[k : k + 1] * self.weights[k : k + 1] + np.uint64(0xD6E8FEB86659FD93))
            return total
        n = len(h) - self.words + 1
        total = np.zeros(n, np.uint64)
        for k in range(self.words):
            total += h[k : k + n] * self.weights[k]
        return np.unique(_mix(total))


def signatures(df: DataFrame, rules: Banding) -> DataFrame:
    """(id, n_shingles, set_key binary, keys array<long>) of every row (id, text).

    ``set_key`` is a 128-bit digest of the whole set, ``keys`` are the m tuples of A, then those of B;
    both are null for an empty set.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        shingler, r, m = Shingler(rules.words), rules.tuple_size, rules.tuples
        rng = np.random.Generator(np.random.PCG64(SEED))
        mul = rng.integers(1, 2**63, 2 * r * m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, 2 * r * m, dtype=np.uint64)
        number = _mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        def tuples(s):
            low = None
            for at in range(0, len(s), BLOCK_SHINGLES):
                part = (s[at : at + BLOCK_SHINGLES, None] * mul + add).min(axis=0)
                low = part if low is None else np.minimum(low, part)
            low, out = low.reshape(2 * m, r), number
            for k in range(r):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + low[:, k])
            return out.view(np.int64)

        with without_gc():
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH_DOCS):
                    batch = whole.slice(at, BATCH_DOCS)
                    sets = [shingler.set_of(t) for t in batch.column(1).to_pylist()]
                    keys = [tuples(s) if len(s) else None for s in sets]
                    set_key = [xxhash.xxh128_digest(s.tobytes(), SEED) if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_key, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                        names=["id", "n_shingles", "set_key", "keys"],
                    )

    return df.select("id", "text").mapInArrow(run, "id long, n_shingles long, set_key binary, keys array<long>")


def colliding(named: DataFrame, rules: Banding) -> DataFrame:
    """(id, a, b): documents with tuples of A and of B that a document with another set has, too: those tuples.

    Whether sets differ is judged by partial minima and maxima, so a tuple of many copies isn't hot.
    """
    rows = named.select("id", F.xxhash64("set_key").alias("s"), F.posexplode("keys").alias("pos", "key"))
    shared = rows.groupBy("key").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("key")
    rows = rows.select("id", "pos", "key").join(shared, "key", "left_semi")
    side = lambda c: F.collect_list(F.when(c, F.col("key")))  # noqa: E731  at most m keys
    out = rows.groupBy("id").agg(side(F.col("pos") < rules.tuples).alias("a"), side(F.col("pos") >= rules.tuples).alias("b"))
    return out.where("size(a) > 0 and size(b) > 0")


def shingle_sets(docs: DataFrame, wanted: DataFrame, rules: Banding) -> DataFrame:
    """(id, hashes): the sets of the wanted documents as bytes of sorted 64-bit hashes, made anew from the texts."""

    def sets_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler(rules.words)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                sets = [shingler.set_of(t).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return docs.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(sets_of, "id long, hashes binary")


def _single(sets: DataFrame) -> DataFrame:
    """(id, root, h): one row for each shingle of the sets (id, root, hashes)."""

    def split(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
                n = [len(x) for x in sets]
                ids, roots = (np.repeat(part.column(k).to_numpy(), n) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots), pa.array(np.concatenate(sets))], names=["id", "root", "h"])

    return sets.select("id", "root", "hashes").mapInArrow(split, "id long, root long, h long")


def _can_link(rules: Banding) -> str:
    """Whether a document can have a partner at all, by its size and the shingles that it shares with any.

    A partner has at least ``percent`` of its size, and size + partner's size is at most
    (100 + percent) / percent of what they have in common.
    """
    p = rules.percent
    return f"100 * shared >= {p} * size and {100 + p} * shared >= {p} * (size + ceil({p} * size / 100))"


def reach(sets: DataFrame, rules: Banding) -> DataFrame:
    """(id, size, shared): the documents that can still be linked; shared: shingles that another one of ``sets`` has, too.

    So documents that have only one passage in common with others and little else are ruled out
    one by one, without looking at pairs.
    """
    sizes = sets.select("id", (F.octet_length("hashes") / 8).cast("long").alias("size"))
    rows = _single(sets.withColumn("root", F.col("id")))
    owners = rows.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    own = owners.where("id = last").groupBy("id").agg(F.count("*").alias("own"))
    out = sizes.join(own, "id", "left").select("id", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))
    return out.where(_can_link(rules))


def kernels(sets: DataFrame, roots: DataFrame, rules: Banding) -> DataFrame:
    """(id, root, size, shared, hashes): what is left of each set without the shingles of one component only,
    for the documents that can be linked with another component."""
    rows = sets.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "hashes")
    sizes = rows.select("id", "root", (F.octet_length("hashes") / 8).cast("long").alias("size"))
    rows = _single(rows)
    cross = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    left = rows.join(cross, "h", "left_semi").groupBy("id").agg(F.collect_list("h").alias("hashes"))  # at most a document's size
    out = sizes.join(left, "id").select("id", "root", "size", F.size("hashes").cast("long").alias("shared"), "hashes")
    return out.where(_can_link(rules))


def in_common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, nx, ny, common): sizes and common shingles of the pairs (x, y); hashes as bytes or as arrays."""
    as_bytes = sets.schema["hashes"].dataType.typeName() == "binary"
    both = pairs.join(sets.selectExpr("id as x", "hashes as sx"), "x").join(sets.selectExpr("id as y", "hashes as sy"), "y")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        of = (lambda s: np.frombuffer(s.as_buffer(), np.int64)) if as_bytes else (lambda s: s.values.to_numpy())
        for t in batches:
            n = []
            for sx, sy in zip(t.column(2), t.column(3), strict=True):
                p, q = of(sx), of(sy)
                n.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            counts = np.array(n, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *(pa.array(counts[:, k]) for k in range(3))], names=["x", "y", "nx", "ny", "common"])

    return both.select("x", "y", "sx", "sy").mapInArrow(compare, "x long, y long, nx long, ny long, common long")


def verify(pairs: DataFrame, sets: DataFrame, rules: Banding) -> DataFrame:
    """The pairs (x, y) that reach the threshold on their full sets."""
    return in_common(pairs, sets).where(f"100 * common >= {rules.percent} * (nx + ny - common)").select("x", "y")


def pivot_pairs(members: DataFrame, roots: DataFrame | None, spread: int, rules: Banding) -> DataFrame:
    """(x, y): in every bucket with two components or more, each member x with the pivot y, if
    they are in different components, share a table and have sizes and shared shingles that allow a link.

    Ranks are the same in all buckets whose keys agree modulo ``spread``, so a group of copies gets at most so
    many pivots, and the number of pairs is linear in its size. Pivots are partial minima joined back.
    """
    rows = members.withColumn("root", F.col("id")) if roots is None else members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rank = (-F.col("shared") / F.col("size"), F.col("id")) if spread == 1 else (F.xxhash64("id", F.pmod("key", F.lit(spread))), F.col("id"))
    best = F.min_by(F.struct(F.col("id").alias("y"), F.col("b").alias("yb"), F.col("root").alias("y_root"), F.col("size").alias("y_size"), F.col("shared").alias("y_shared")), F.struct(*rank))
    pivots = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), best.alias("p")).where("low <> high")
    rows = rows.join(pivots.select("key", "p.*"), "key")
    near = f"root <> y_root and {100 + rules.percent} * least(shared, y_shared) >= {rules.percent} * (size + y_size) and arrays_overlap(b, yb)"
    return rows.where(near).select(F.col("id").alias("x"), "y").distinct()


def pairs_across(hits: DataFrame, open_sets: DataFrame, rules: Banding, work: Workspace) -> DataFrame:
    """(x, y): all pairs of different components that share a table and that the bounds allow.

    Let p be a bucket's pivot. Of a member's kernel, ``with_p`` shingles are p's as well and the others are not;
    what two members have in common is at most the lesser of the former plus the lesser of the latter. So the fringe of a
    group of near copies isn't compared with every member. A pair is made under the first A tuple it shares only.
    """
    facts = open_sets.select("id", "root", "size", "shared")
    rows = hits.join(facts, "id").select(F.explode("a").alias("key"), "*")
    best = F.min_by("id", F.struct(-F.col("shared") / F.col("size"), "id"))
    pivots = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), best.alias("p")).where("low <> high").select("key", "p")
    rows = work.save(rows.join(pivots, "key"), "last-buckets")
    with_p = in_common(rows.selectExpr("id as x", "p as y").distinct(), open_sets.select("id", "hashes")).selectExpr("x as id", "y as p", "common as with_p")
    rows = work.save(rows.join(with_p, ["id", "p"]).withColumn("rest", F.col("shared") - F.col("with_p")), "bounded-buckets")
    # what a member can have in common with any other one of its bucket
    most = rows.groupBy("key").agg(F.min("size").alias("least"), F.max("rest").alias("most_rest"))
    p = rules.percent
    rows = rows.join(most, "key").where(f"{100 + p} * (with_p + least(rest, most_rest)) >= {p} * (size + least)")
    side = lambda n: rows.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("id", "root", "size", "with_p", "rest", "a", "b")])
    bound = f"{100 + p} * (least(with_p_x, with_p_y) + least(rest_x, rest_y)) >= {p} * (size_x + size_y)"
    first = "key = array_min(array_intersect(a_x, a_y)) and arrays_overlap(b_x, b_y)"
    pairs = side("x").join(side("y"), "key").where(f"id_x < id_y and root_x <> root_y and {bound}").where(first)
    return pairs.selectExpr("id_x as x", "id_y as y")


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches, by large-star and small-star rounds.

    Each round is a few aggregations over narrow rows, with partial minima, so the centre of
    many links isn't hot. The number of rounds follows the logarithm of the longest path.
    """
    token = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    edges = work.save(links.selectExpr("greatest(x, y) as u", "least(x, y) as v").where("u <> v").distinct(), "edges")
    before = token(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(least, "u").select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges, old = work.save(small, "edges"), edges
        work.drop(old)
        now = token(edges)
        if now == before:
            return work.view(edges, edges.selectExpr("u as id", "v as root"))
        before = now


def link(docs: DataFrame, rules: Banding, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles) of every row (id, text), and (id, root) of the linked ones. Ids are distinct, or null and never linked."""
    sign = work.save(signatures(docs, rules), "signatures")
    named = sign.where("id is not null and set_key is not null")
    # equal sets: one class each, under its smallest id
    reps = work.save(named.groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    copies = named.select("id", "set_key").join(reps, "set_key").where("id <> rep").select(F.col("id").alias("x"), F.col("rep").alias("y"))
    hits = work.save(colliding(named, rules).join(reps.select(F.col("rep").alias("id")), "id", "left_semi"), "hits")
    sets = work.save(shingle_sets(docs, hits.select("id"), rules), "sets")
    before, bounds = sets.count(), None
    while True:  # what is ruled out can rule out more
        bounds, old = work.save(reach(sets, rules), "reach"), bounds
        work.drop(old)
        sets, old = work.save(sets.join(bounds.select("id"), "id", "left_semi"), "sets"), sets
        work.drop(old)
        left = sets.count()
        if left >= (1 - WORTH) * before:
            break
        before = left
    members = work.save(hits.join(bounds, "id").select("id", F.explode("a").alias("key"), "b", "size", "shared"), "members")
    links, roots = [], None
    for spread in SPREADS:
        new = work.save(verify(pivot_pairs(members, roots, spread, rules), sets, rules), "links")
        links.append(new)
        roots, old = components(reduce(DataFrame.union, links), work), roots
        work.drop(old)
        if new.count() <= WORTH * left:
            break
    open_sets = work.save(kernels(sets, roots, rules), "kernels")
    more = work.save(verify(pairs_across(hits, open_sets, rules, work), sets, rules), "links")
    roots, old = components(reduce(DataFrame.union, [*links, more, copies]), work), roots
    work.drop(old)
    counts = work.view(sign, sign.select("id", "n_shingles"))
    return counts, roots


def near_duplicates(df: DataFrame, rules: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Rows without words are linked with nothing; so are rows with a null id, whose
    component_id is null and which are kept. Rows that repeat an id are one document with
    several texts: a link of one is a link of all. ``kept`` is true for the smallest id of
    a component. Only the two named columns are read.
    """
    bounded_batches(df.sparkSession)
    work = Workspace(df.sparkSession, "near-duplicates")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    repeated = docs.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        sign, roots = link(docs, rules, work)
        work.keep(sign, roots)
        out = sign.join(roots, "id", "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
    else:  # each row is a document of its own, linked with the others of its id
        rows = docs.select(F.when(F.col("id").isNotNull(), F.monotonically_increasing_id()).alias("row"), "id", "text")
        rows = work.save(rows, "rows")
        sign, roots = link(rows.select(F.col("row").alias("id"), "text"), rules, work)
        first = rows.groupBy("id").agg(F.min("row").alias("first"))
        same = rows.join(first, "id").where("row <> first").select(F.col("row").alias("x"), F.col("first").alias("y"))
        roots = components(roots.selectExpr("id as x", "root as y").union(same), work)
        work.keep(rows, sign, roots)
        found = sign.withColumnRenamed("id", "row").join(rows.select("row", "id"), "row", "left").join(roots.withColumnRenamed("id", "row"), "row", "left")
        found = found.withColumn("root", F.coalesce("root", "row"))
        least = found.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
        out = found.join(least, "root", "left").select("id", "n_shingles", "component_id")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM d, unnest(range(1, len(w) - 3)) t(i)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.other
), low AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN low ON low.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
