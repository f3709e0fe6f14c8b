"""Vector code compression with a GNAT over the entries (operator 11).

Vectors of whole numbers are cut into equal parts, and every part is replaced by the index of
its codebook's nearest entry. The entries of a codebook form a geometric near-neighbour access
tree: some of them are split points, all others belong to the child of their nearest split
point, and for each child the range of its distances to every split point is kept. A part
measures its distance to the split points; by the triangle inequality, a child whose range
lies further off than the nearest entry so far can't hold a nearer one, and its whole subtree
is left out. Distances are compared in whole units of 1/1024, rounded so that a subtree goes
only if it is strictly further; what is nearest, and the ties to the lower index, are decided by
exact integer squares.

The codebooks are small whatever the table (entries * dimensions numbers): they are fitted by
sums per task, part and entry, and travel with the code of the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import materialise, table

#: Split points of a node, entries up to which a node has no children, rows worked on at once.
DEGREE, LEAF, SLICE = 8, 8, 4_096
#: Distances are compared in units of 1/1024.
UNIT = 1_024
LONG_MAX = 2**63 - 1
SALTS = 16


@dataclass
class Codebooks:
    """entries[part][index] is the list of an entry's components; width is their number."""

    entries: list[list[list[int]]]
    width: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(c) for book in self.entries for e in book for c in e).encode()).hexdigest()


def whole_vectors(df: DataFrame, vec_col: str, scale: int = 256) -> DataFrame:
    """Adds ``v``, floor(scale * x) of every component as a long, and drops the rows whose
    vector is null or holds a null or non-finite component. Products beyond the long range stop at its ends."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    kept = df.where(F.col(vec_col).isNotNull()).where(F.forall(vec_col, fine))
    return kept.withColumn("v", F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def build_tree(entries, ids) -> dict:
    """The tree of some distinct entries: split points, and per child its ranges of distances to them."""
    import numpy as np

    if len(ids) <= LEAF:
        return {"ids": ids, "points": entries[ids], "children": []}
    chosen = [0]
    far = _squares(entries[ids], entries[ids[:1]])[:, 0]
    while len(chosen) < DEGREE:  # each next split point is the entry furthest from those chosen
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _squares(entries[ids], entries[ids[chosen[-1:]]])[:, 0])
    chosen = np.sort(chosen)
    splits, rest = ids[chosen], np.delete(ids, chosen)
    apart = _squares(entries[rest], entries[splits])
    owner = apart.argmin(axis=1)
    low, high = _roots(apart)
    children = []
    for j in range(len(splits)):
        own = owner == j
        if own.any():
            children.append((j, low[own].min(axis=0), high[own].max(axis=0), build_tree(entries, rest[own])))
    return {"ids": splits, "points": entries[splits], "children": children}


def _squares(x, points):
    """Squared distances (rows of x, points), exact in the integers of the arrays."""
    total = 0
    for k in range(x.shape[1]):
        total = total + (x[:, k, None] - points[None, :, k]) ** 2
    return total


def _roots(squares):
    """Whole units at or below and at or above the distances."""
    import numpy as np

    if squares.dtype == object:
        down = np.frompyfunc(lambda d: math.isqrt(int(d) * UNIT * UNIT), 1, 1)(squares)
        return down, down + 1
    # squares below 2^53: the root is at most 2^-16 of a unit off, so one unit is ample
    near = np.floor(np.sqrt(squares.astype(np.float64)) * UNIT).astype(np.int64)
    return near - 1, near + 2


def nearest_in(tree: dict, x, best, found, rows) -> None:
    """Brings the nearest entry of the rows of x up to date with this subtree: best has squares, found has indexes."""
    import numpy as np

    squares = _squares(x[rows], tree["points"])
    first = squares.argmin(axis=1)  # split points ascend by index, so the first of equals has the lower one
    least, index = squares[np.arange(len(rows)), first], tree["ids"][first]
    nearer = (least < best[rows]) | ((least == best[rows]) & (index < found[rows]))
    best[rows[nearer]], found[rows[nearer]] = least[nearer], index[nearer]
    if not tree["children"]:
        return
    down, up = _roots(squares)
    for j, _, _, child in tree["children"]:  # first into the child of the nearest split point
        if (own := first == j).any():
            nearest_in(child, x, best, found, rows[own])
    for j, low, high, child in tree["children"]:
        radius = _roots(best[rows])[1][:, None]
        beyond = ((down - high) > radius) | ((low - up) > radius)  # strictly further by some split point
        alive = (first != j) & ~beyond.any(axis=1)
        if alive.any():
            nearest_in(child, x, best, found, rows[alive])


def plant(books: Codebooks, most: int) -> tuple[list[dict], type]:
    """A tree for each part, and the numbers in which vectors of components up to ``most`` are exact."""
    import numpy as np

    most = max([most, *(abs(c) for book in books.entries for e in book for c in e)])
    kind = np.int64 if books.width * (2 * most) ** 2 < 2**53 else object
    trees = []
    for book in books.entries:
        entries = np.array(book, dtype=kind).reshape(len(book), books.width)
        kinds = {tuple(e): i for i, e in reversed(list(enumerate(book)))}  # of equal entries only the first can win
        trees.append(build_tree(entries, np.array(sorted(kinds.values()), dtype=np.int64)))
    return trees, kind


def assign(trees: list[dict], x):
    """(indexes, squared distances), both (rows, parts), of the nearest entries of x (rows, parts, width)."""
    import numpy as np

    found, best = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], x.dtype)
    for k, tree in enumerate(trees):
        part = np.ascontiguousarray(x[:, k])
        squares = _squares(part, tree["points"][:1])[:, 0]
        index = np.full(len(part), tree["ids"][0])
        nearest_in(tree, part, squares, index, np.arange(len(part)))
        found[:, k], best[:, k] = index, squares
    return found, best


def _slices(batches: Iterator, parts: int, width: int) -> Iterator:
    """(rows of a batch, their vectors as (rows, parts, width)); shorter vectors are filled up with zeros."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE)
            lists = rows.column(rows.schema.get_field_index("v"))
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            x = np.zeros((rows.num_rows, parts * width), np.int64)
            x[np.arange(parts * width)[None, :] < sizes[:, None]] = flat
            yield rows, x.reshape(rows.num_rows, parts, width)


def _exact(books: Codebooks) -> Callable:
    """Trees for a slice of vectors; those for huge numbers are only grown where they are needed."""
    grown: dict = {}

    def trees(x):
        most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
        size = max(most, 1).bit_length()
        if size not in grown:
            grown[size] = plant(books, 2**size)
        trees, kind = grown[size]
        return trees, x.astype(kind)

    return trees


def fit(vectors: DataFrame, id_col: str, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks of the rows' ``v``: each starts with the parts of the smallest ids (nulls last, ties by
    vector) and moves to the floor of the mean of what it is nearest to, round by round; unused entries stay."""
    width = max(1, -(-(vectors.agg(F.max(F.size("v"))).first()[0] or 0) // parts))
    first = [r[0] for r in vectors.orderBy(F.col(id_col).asc_nulls_last(), "v").select("v").limit(entries).collect()]
    first = [v + [0] * (parts * width - len(v)) for v in first]
    books = Codebooks([[v[k * width : (k + 1) * width] for v in first] for k in range(parts)], width)
    shape = "part int, entry int, n long, sums array<decimal(38,0)>"
    for _ in range(rounds if first else 0):

        def gather(batches, books=books):
            import numpy as np
            import pyarrow as pa

            trees_of, size = _exact(books), len(books.entries[0])
            counts, sums = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), object)
            for _, x in _slices(batches, parts, width):
                trees, x = trees_of(x)
                found, _ = assign(trees, x)
                slot = (found + np.arange(parts) * size).ravel()
                part = np.zeros((parts * size, width), x.dtype)
                np.add.at(part, slot, x.reshape(-1, width))
                counts += np.bincount(slot, minlength=parts * size)
                sums += part  # the sums of all slices in Python's integers, which don't overflow
            used = np.flatnonzero(counts)
            kinds = pa.list_(pa.decimal128(38, 0))
            yield pa.record_batch({"part": pa.array(used // size, pa.int32()), "entry": pa.array(used % size, pa.int32()), "n": pa.array(counts[used], pa.int64()), "sums": pa.array(sums[used].tolist(), kinds)})

        told = vectors.select("v").mapInArrow(gather, shape).groupBy("part", "entry")
        told = told.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
        for r in told.collect():  # parts * entries rows at most
            books.entries[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return books


def encode(vectors: DataFrame, books: Codebooks, carry: tuple[str, ...] = ()) -> DataFrame:
    """(*carry, code, error): two hexadecimal digits a part, and the squared distance to what they stand for."""
    parts, width = len(books.entries), books.width
    if books.entries and len(books.entries[0]) > 256:
        raise ValueError("two hexadecimal digits tell 256 entries apart")

    def run(batches):
        import pyarrow as pa

        trees_of = _exact(books)
        for rows, x in _slices(batches, parts, width):
            trees, x = trees_of(x)
            found, squares = assign(trees, x)
            digits = found.astype("u1").tobytes().hex()
            codes = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            errors = [min(LONG_MAX, int(e)) for e in squares.sum(axis=1)]
            cols = [rows.column(rows.schema.get_field_index(c)) for c in carry]
            yield pa.record_batch([*cols, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*carry, "code", "error"])

    rows = vectors.select(*carry, "v")
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "v"), "code string", "error long"])
    return rows.mapInArrow(run, shape)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``v``, the components that the code stands for."""
    book = F.lit([[c for e in part for c in e] for part in books.entries]).cast("array<array<bigint>>")

    def entry(k: Column) -> Column:
        index = F.conv(F.substring(F.col("code"), 2 * k + 1, F.lit(2)), 16, 10).cast("int")
        return F.slice(F.element_at(book, k + 1), index * books.width + 1, F.lit(books.width))

    return codes.withColumn("v", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), entry)))


def label_errors(codes: DataFrame, label_col: str) -> DataFrame:
    """Adds label_error, the errors summed over equal labels (nulls together).

    Sums are partial aggregates; rows find theirs by label and one of 16 salts, so a label
    that holds a large share of the rows meets no single task.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(F.col(label_col).alias("of")).agg(total.alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = codes.withColumn("own", F.pmod(F.hash(*codes.columns), F.lit(SALTS)).cast("int"))
    return rows.join(sums, F.col(label_col).eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt"))).drop("of", "own", "salt")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a sound vector.

    Rows that repeat an id each get a row; a null id comes last among those that codebooks start with. Vectors
    shorter than the longest, or than a multiple of the parts, are filled up with zeros. Errors beyond
    the long range stop at its end. Fewer than 64 rows start fewer entries; an empty table gives no rows.
    """
    rows = whole_vectors(vectors.select(id_col, label_col, vec_col), vec_col).drop(vec_col)
    books = fit(rows, id_col, parts, entries, rounds)
    codes = materialise(encode(rows, books, (id_col, label_col)), "codes")
    return label_errors(codes, label_col).select(id_col, "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op11_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector of ``embeddings``."""
    return compress(table(spark, sf_dir, "embeddings"))


_NEAREST = """a{k} AS (
  SELECT vec_id, part, x, min({{'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best FROM p JOIN b{k} USING (part) GROUP BY vec_id, part, x
)"""
_MOVED = """m{k} AS (
  SELECT part, e, list(m ORDER BY i) AS y FROM (
    SELECT part, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT w FROM w))) AS i) GROUP BY ALL
  ) GROUP BY part, e
), b{n} AS (
  SELECT part, e, coalesce(m{k}.y, b{k}.y) AS y FROM b{k} LEFT JOIN m{k} USING (part, e)
)"""
OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), w AS (SELECT (max(len(v)) + 15) // 16 AS w FROM v
), p AS (
  SELECT vec_id, label, k AS part, list_resize(v, 16 * w, 0)[k * w + 1 : k * w + w] AS x FROM v, w, (SELECT unnest(range(16)) AS k)
), b0 AS (
  SELECT part, e, x AS y FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 64
), {_NEAREST.format(k=0)}, {_MOVED.format(k=0, n=1)}, {_NEAREST.format(k=1)}, {_MOVED.format(k=1, n=2)}, {_NEAREST.format(k=2)}, s AS (
  SELECT sha256(string_agg(CAST(y[i] AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM b2, (SELECT unnest(range(1, 1 + (SELECT w FROM w))) AS i)
), c AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 JOIN v USING (vec_id) GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, s
"""
