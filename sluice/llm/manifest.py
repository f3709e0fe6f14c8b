"""Merkle manifest of a dataset, with proofs by pointer jumping (operator 13).

Every row is a leaf. Per language, leaves in order of their ids are hashed in runs of eight, and
the runs' digests again, until one is left: the subroot; subroots in order of languages are hashed
in the same way to the root. Trees are built level by level, each by one aggregation over
positions, so no group has more than eight rows, however much of the table one language holds.

For the proofs, every node above the leaves holds a pointer to an ancestor (at first its parent)
and the segment of siblings on the way there. A self-join puts the ancestor's segment after
the node's own and takes over its pointer, which doubles the distance; after about log2(height) rounds
every pointer reaches the root. Leaves take their parent's finished segment in a last step of the same
kind, so the large part, a whole proof per leaf, is hashed where it is made and never stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Workspace, table

#: Nodes of a run.
RUN = 8
#: Copies of an ancestor that share out the nodes which point at it.
MOST_COPIES = 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots; trees of languages are numbered from 0 in the order of languages.
TOP = -1
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Sha-256 of the parts one after the other, as bytes; digests among them go in as lower-case hexadecimal text."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(hashed: Column) -> Column:
    return F.lower(F.hex(hashed))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(lang, doc_id, leaf, seen): the digest of each row, and that of the row as it is met again,
    whose text has its letters A to Z in lower case where ``tampered``."""
    lowered = F.translate("text", A_TO_Z, A_TO_Z.lower())
    rest = [field(F.col(c)) for c in FIELDS[:-1]]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    changed = F.coalesce(tampered, F.lit(False)) & F.col("text").rlike("[A-Z]")
    return rows.select("lang", "doc_id", digest(*rest, field(F.col("text"))).alias("leaf"), F.when(changed, digest(*rest, field(lowered))).alias("seen"))


@dataclass
class Manifest:
    """leaves (tree, size, pos, doc_id, leaf, seen), runs by level, root; the tables are in the shared folder."""

    leaves: DataFrame
    #: One table (tree, pos, run, h, size) per level from 1: the run's digests, its own, and the nodes on its level.
    levels: list[DataFrame]
    top_levels: list[DataFrame]
    #: (tree, level, h) of every subroot.
    subroots: DataFrame
    root: bytes | None


def numbered(rows: DataFrame, space: Workspace, group: str, *order: str) -> DataFrame:
    """Adds tree (number of the group in its order), pos (place in the group) and size (rows of the group).

    Rows are sorted over range partitions and written; a row's place is its place in its partition plus
    what the partitions before hold of the group, so that no task sees a group as a whole.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = space.save(placed.withColumn("at", F.monotonically_increasing_id()), "sorted")
    piece = F.shiftright("at", 33)
    pieces = placed.groupBy(F.col(group).alias("of"), piece.alias("piece")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("of")
    pieces = pieces.withColumns({"before": F.sum("n").over(own.orderBy("piece")) - F.col("n"), "size": F.sum("n").over(own)})
    pieces = space.save(pieces.drop("n"), "pieces")
    groups = pieces.groupBy("of").agg(F.min("first").alias("first")).withColumn("in", F.shiftright("first", 33))
    starts = groups.groupBy("in").agg(F.count("*").alias("n"))
    starts = starts.select("in", (F.sum("n").over(Window.orderBy("in")) - F.col("n")).alias("base"))  # a row per partition at most
    groups = groups.withColumn("k", F.row_number().over(Window.partitionBy("in").orderBy("first"))).join(starts, "in")
    groups = space.save(groups.select(F.col("of").alias("own"), (F.col("base") + F.col("k") - 1).alias("tree")), "groups")
    pieces = pieces.join(groups, F.col("of").eqNullSafe(F.col("own"))).drop("own")
    out = placed.join(pieces, F.col(group).eqNullSafe(F.col("of")) & (piece == F.col("piece")))
    return out.select("tree", "size", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), *rows.columns)


def grow(nodes: DataFrame, space: Workspace, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the trees over nodes (tree, pos, size, h), and (tree, level, h) of what each tree comes to."""
    levels: list[DataFrame] = []
    roots = nodes.where("size = 1").select("tree", F.lit(0).alias("level"), "h")
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        runs = nodes.where("size > 1").groupBy("tree", F.floor(F.col("pos") / RUN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("run"), F.max("size").alias("size"))
        runs = runs.select("tree", F.col("up").alias("pos"), F.col("run.h").alias("run"), F.ceil(F.col("size") / RUN).alias("size"))
        runs = space.save(runs.withColumn("h", digest(F.array_join(F.transform("run", as_text), ""))), name)
        levels.append(runs)
        nodes, largest = runs.drop("run"), -(-largest // RUN)
        roots = roots.unionByName(nodes.where("size = 1").select("tree", F.lit(len(levels)).alias("level"), "h"))
    return levels, roots


def build(docs: DataFrame, tampered: Column, space: Workspace) -> Manifest:
    """The trees of ``docs``. Null languages are a tree of their own, the first; null ids are the first leaves; leaves of rows
    that repeat an id are ordered by digest. An empty table has no root."""
    rows = space.save(leaves(docs, tampered), "leaves")
    placed = space.save(numbered(rows, space, "lang", "doc_id", "leaf").drop("lang"), "numbered")
    levels, subroots = grow(placed.withColumnRenamed("leaf", "h").select("tree", "pos", "size", "h"), space, "level")
    subroots = space.save(subroots, "subroots")
    n = subroots.count()
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("size"), "h")
    top_levels, root = grow(top, space, "top-level")
    found = root.first()
    return Manifest(placed, levels, top_levels, subroots, found and bytes(found["h"]))


def siblings(run: Column, k: Column) -> Column:
    """What stands left and right of the k-th digest of a run, each as one string of bytes."""
    joined = lambda part: F.unhex(F.array_join(F.transform(part, lambda h: F.hex(h)), ""))
    return F.struct(joined(F.slice(run, 1, k)).alias("left"), joined(F.slice(run, k + 2, RUN)).alias("right"))


def pointers(m: Manifest) -> DataFrame:
    """(tree, level, pos, up_tree, up_level, up_pos, path, subroot, run) of every node above the leaves and of every lone
    leaf: its parent and its siblings. A subroot points at its own place in the upper tree, with no siblings on the way.
    ``run`` holds the leaves below a node of level 1."""
    tables = []
    # leaves themselves take part in the last step only
    for level, runs in [*enumerate(m.levels[1:], 2), *enumerate(m.top_levels, 1)]:
        kids = runs.select("tree", F.col("pos").alias("up"), "run", F.posexplode("run").alias("k", "h"))
        tables.append(kids.select("tree", F.lit(level - 1).alias("level"), (F.col("up") * RUN + F.col("k")).alias("pos"), F.col("tree").alias("up_tree"), F.lit(level).alias("up_level"), F.col("up").alias("up_pos"), F.array(siblings(F.col("run"), F.col("k"))).alias("path"), F.lit(None).cast("binary").alias("subroot")))
    roots = m.subroots.select("tree", "level", F.lit(0).cast("long").alias("pos"), F.lit(TOP).cast("long").alias("up_tree"), F.lit(0).alias("up_level"), F.col("tree").alias("up_pos"), F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.col("h").alias("subroot"))
    out = reduce(DataFrame.unionByName, tables, roots)
    if not m.levels:
        return out.withColumn("run", F.lit(None).cast("array<binary>"))
    return out.join(m.levels[0].select("tree", F.lit(1).alias("level"), "pos", "run"), ["tree", "level", "pos"], "left")


def jump(m: Manifest, space: Workspace) -> DataFrame:
    """(tree, level, pos, path, subroot, run) of every node of ``pointers``: all siblings up to the root."""
    height = len(m.levels) + 1 + len(m.top_levels)
    state, reach = space.save(pointers(m), "pointers"), 1
    key = ["up_tree", "up_level", "up_pos"]
    root = (F.col("up_tree") == TOP) & (F.col("up_level") == len(m.top_levels))
    while reach < height:
        ahead = state.select(*[F.col(c).alias(f"up_{c}") for c in ("tree", "level", "pos")], *[F.col(c).alias(f"far_{c[3:]}") for c in key], F.col("path").alias("more"), F.col("subroot").alias("own_root"))
        # up to RUN ** reach nodes point at one: as many copies of it as are asked for share them out
        copies = min(RUN ** (reach - 1), MOST_COPIES)
        open_ = state.where(~root).withColumn("copy", F.pmod(F.col("pos"), F.lit(copies)).cast("int"))
        if copies > 1:
            ahead = ahead.join(open_.select(*key, "copy").distinct(), key)
        met = open_.join(ahead, [*key, "copy"] if copies > 1 else key)
        met = met.select("tree", "level", "pos", *[F.col(f"far_{c[3:]}").alias(c) for c in key], F.concat("path", "more").alias("path"), F.coalesce("subroot", "own_root").alias("subroot"), "run")
        new = space.save(met.unionByName(state.where(root).select(*met.columns)), "pointers")
        space.drop(state)
        state, reach = new, 2 * reach
    return state


def fold(path: Column, own: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, own, lambda h, p: digest(as_text(p["left"]), as_text(h), as_text(p["right"])))


def prove(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``."""
    space = Workspace(docs.sparkSession, "manifest")
    m = build(docs, tampered, space)
    nodes = jump(m, space)
    space.keep(m.leaves, nodes)
    up = F.when(F.col("size") > 1, F.floor(F.col("pos") / RUN)).otherwise(F.lit(0))
    rows = m.leaves.select("doc_id", "leaf", "seen", "tree", F.when(F.col("size") > 1, 1).otherwise(0).alias("level"), (F.col("pos") % RUN).cast("int").alias("k"), up.alias("pos"))
    rows = rows.join(nodes.where("level <= 1").where(F.col("tree") != TOP).select("tree", "level", "pos", "path", "subroot", "run"), ["tree", "level", "pos"])
    path = F.when(F.col("level") == 1, F.concat(F.array(siblings(F.col("run"), F.col("k"))), "path")).otherwise(F.col("path"))
    rows = rows.select("doc_id", "leaf", "seen", "subroot", path.alias("path"))
    told = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(as_text(p["left"]), as_text(p["right"]))), ""), 256)
    folded = fold(F.col("path"), F.coalesce("seen", "leaf"))
    root = F.lit(m.root.hex() if m.root else None).cast("string")
    rows = rows.select("doc_id", as_text(F.col("leaf")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), root.alias("root"), told.alias("proof_sha256"), as_text(folded).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def every_third(id_col: str = "doc_id") -> Column:
    """Where 3 divides the crc32 of the decimal id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every row of ``documents``, and which of them hold once a third of the texts are tampered with."""
    return prove(table(spark, sf_dir, "documents"), every_third())


#: The check sum is worked out by its table, since the engine that runs this has none.
OP13_SQL = """
WITH RECURSIVE step(n, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8
), d AS (
  SELECT doc_id, lang, text, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS fields,
    coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(t[xor(a & 255, b) + 1], a >> 8)), 4294967295) % 3 = 0, false) AS tampered
  FROM documents, crc
), e AS (
  SELECT doc_id, lang, sha256(fields || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(fields || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END END) AS seen FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM e
), tree(lang, level, pos, n, h) AS (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 8, n
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n
), beside AS (
  SELECT a.lang, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM tree a JOIN tree b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
), above AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
), steps AS (
  SELECT x.lang, x.pos, s.level AS k, s.l, s.r FROM leaves x JOIN beside s ON x.lang IS NOT DISTINCT FROM s.lang AND s.pos = x.pos // CAST(pow(8, s.level) AS BIGINT)
  UNION ALL SELECT x.lang, x.pos, 1000 + s.level, s.l, s.r FROM leaves x JOIN subroots u ON x.lang IS NOT DISTINCT FROM u.lang JOIN above s ON s.pos = u.pos // CAST(pow(8, s.level) AS BIGINT)
), paths AS (
  SELECT lang, pos, list({'l': l, 'r': r, 'h': ''} ORDER BY k) AS path FROM steps GROUP BY lang, pos
), told AS (
  SELECT x.doc_id, x.leaf, u.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.l || s.r), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_concat([{'l': '', 'r': '', 'h': x.seen}], coalesce(path, [])), lambda a, s: {'l': '', 'r': '', 'h': sha256(s.l || a.h || s.r)}).h AS folded_root
  FROM leaves x JOIN subroots u ON x.lang IS NOT DISTINCT FROM u.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM x.lang AND p.pos = x.pos
)
SELECT *, folded_root = root AS verified FROM told
"""
