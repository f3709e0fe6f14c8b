"""Mixing sources to target weights by entropy balancing (operator 9, built-in functions only).

Each document gets a rate r >= 0, the expected number of its copies. Among all rates that
meet the token constraint of a source, sum(r * size) = target, and stay within the cap,
entropy balancing takes those nearest to 1 in Kullback-Leibler divergence. The convex dual
has one unknown per source, and its solution tilts the rates exponentially:
r = min(cap, exp(lambda * size)). A safeguarded Newton iteration solves all duals at once.
Documents of the same source and size have the same rate, so the iterations run on a
histogram of (source, size) cells. Rates become whole copies by carrying the token error
of each cell to the next smaller size, and a cell's copies fall to its documents in the
order of a hash, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import materialise, n_words, table

#: Rank weights of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: Documents of a cell that are ranked together; a larger cell is dealt to several buckets.
CELL_BUCKET = 10_000
#: Sizes of a block in which copies are worked out one after the other.
FOLD_SIZES = 128
#: So many cells, a few MB, and the plan is broadcast; beyond that it meets its rows by a shuffle.
BROADCAST_CELLS = 100_000


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): weights by rank, capped, reshared.

    Sources are ranked by code point (``mix`` turns null into the last key). A source whose share is above ``cap``
    times its size stops there and the excess is shared again by weight among the others,
    until none is above. With a common factor t the fixed point is
    target = min(cap * size, t * weight), so t follows from one ordering of the sources by
    size / weight. The table has one row per source; the ordering is over those rows only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")).cast("double"))
    full = cap * F.col("source_size")
    ratio = full / F.col("weight")
    by_ratio = Window.orderBy(ratio, "source")
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "ratio": ratio,
        "wanted": F.lit(share) * F.sum("source_size").over(every),
        "full_before": F.coalesce(F.sum(full).over(before), F.lit(0.0)),
        "weight_from": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the first source (in that order) that isn't stopped fixes t; if all stop, t is unbounded
    factor = (F.col("wanted") - F.col("full_before")) / F.col("weight_from")
    per = per.withColumn("t", F.min(F.when(factor <= F.col("ratio"), F.struct("ratio", factor.alias("t")))).over(every)["t"])
    target = F.when(F.col("t").isNull(), full).otherwise(F.least(full, F.col("t") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def solve_rates(cells: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-7, max_rounds: int = 60) -> DataFrame:
    """(source, lam): the dual solution of every source, by distributed Newton iterations.

    ``cells`` has (source, size, n). The used tokens g(lam) = sum(n * size * min(cap,
    exp(lam * size))) rise with lam. Each round evaluates g and its slope for all sources
    in one aggregation, narrows the bracket [lo, hi] and takes the Newton step (on the
    logarithms of both sides) if it stays inside, else the middle. Sources with an empty target or no words get no copies.
    """
    size = F.col("size").cast("double")
    most = cells.groupBy("source").agg(F.min(F.when(F.col("size") > 0, F.col("size"))).cast("double").alias("shortest"), F.sum(F.col("n") * F.col("size") * F.col("size")).cast("double").alias("s2"))
    state = targets.join(most, "source").where((F.col("target") > 0) & F.col("shortest").isNotNull())
    top = F.log(F.lit(cap)) / F.col("shortest")
    pull = F.log(F.col("target") / F.col("source_size"))
    # Jensen's inequality: at pull / (mean size by tokens) too many tokens are used if no rate is capped
    full = F.col("target") >= cap * F.col("source_size") * (1 - tolerance)  # only the bound itself uses so many
    start = F.when(full, top).otherwise(F.least(pull * F.col("source_size") / F.col("s2"), top))
    bottom = F.least(pull / F.col("shortest"), F.lit(0.0)) - 1e-12
    state = materialise(state.select("source", "target", start.alias("lam"), bottom.alias("lo"), top.alias("hi"), full.alias("done")), "dual")
    for _ in range(max_rounds):
        tilt = F.least(F.lit(cap), F.exp(F.col("lam") * size))
        mass = F.col("n") * size * tilt
        slope = F.when(F.col("lam") * size < F.log(F.lit(cap)), mass * size).otherwise(F.lit(0.0))
        sums = cells.join(state, "source").groupBy("source").agg(F.sum(mass).alias("g"), F.sum(slope).alias("h"), F.first("target").alias("target"), F.first("lam").alias("lam"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("done").alias("done"))
        gap = F.col("target") - F.col("g")
        sums = sums.withColumns({"done": F.col("done") | (F.abs(gap) <= F.greatest(tolerance * F.col("target"), F.lit(1e-6))), "lo": F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(gap > 0, F.col("hi")).otherwise(F.col("lam"))})
        step = F.col("lam") + F.log(F.col("target") / F.col("g")) * F.col("g") / F.col("h")
        inside = (F.col("h") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        moved = F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialise(sums.select("source", "target", moved.alias("lam"), "lo", "hi", "done"), "dual")
        if not state.where(~F.col("done") & (F.col("hi") - F.col("lo") > 1e-15)).limit(1).count():
            break
    return state.select("source", "lam")


def cell_copies(cells: DataFrame, duals: DataFrame, cap: float = 2.0) -> DataFrame:
    """(source, size, n, copies): whole copies of each cell, largest sizes first.

    A cell gets the number of copies that brings the source's running total of tokens
    nearest to the running total of its rates, so the error left by long documents is made
    up by shorter ones. Only that error is carried on, so a first pass folds each source to the error at the start of
    each block of cells, and the blocks then are rows of their own. The arrays of a source have one number for each distinct
    size: their length is bounded by the longest text, whatever the number of documents.
    """
    rate = F.least(F.lit(cap), F.exp(F.col("lam") * F.col("size")))
    cell = F.struct("size", "n", rate.alias("rate"))
    rated = cells.where("size > 0").join(duals, "source").select("source", (-F.floor(F.col("size") / FOLD_SIZES)).alias("block"), cell.alias("c"))
    down = lambda c: F.reverse(F.array_sort(F.collect_list(c)))
    blocks = rated.groupBy("source", "block").agg(down("c").alias("cells"))

    def copies_of(owed, c):
        return F.greatest(F.lit(0), F.least(F.floor(owed / c["size"] + 0.5), c["n"] * F.lit(int(cap)))).cast("long")

    def carry(owed, c):
        total = owed + c["n"] * c["rate"] * c["size"]
        return total - copies_of(total, c) * c["size"]

    kind = "struct<owed:double,starts:array<struct<cells:array<struct<size:bigint,n:bigint,rate:double>>,owed:double>>>"
    zero = F.struct(F.lit(0.0).alias("owed"), F.array().alias("starts")).cast(kind)
    start = lambda acc, b: F.struct(b["cells"].alias("cells"), acc["owed"].alias("owed"))
    over = lambda acc, b: F.struct(F.aggregate(b["cells"], acc["owed"], carry).alias("owed"), F.concat(acc["starts"], F.array(start(acc, b))).alias("starts")).cast(kind)
    sources = blocks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("block", "cells"))).alias("blocks"))
    starts = sources.select("source", F.explode(F.aggregate("blocks", zero, over)["starts"]).alias("s"))

    plan = "struct<owed:double,out:array<struct<size:bigint,n:bigint,copies:bigint>>>"
    nothing = F.struct(F.col("s.owed").alias("owed"), F.array().alias("out")).cast(plan)

    def step(acc, c):
        copies = copies_of(acc["owed"] + c["n"] * c["rate"] * c["size"], c)
        row = F.struct(c["size"].alias("size"), c["n"].alias("n"), copies.alias("copies"))
        return F.struct(carry(acc["owed"], c).alias("owed"), F.concat(acc["out"], F.array(row)).alias("out")).cast(plan)

    return starts.select("source", F.inline(F.aggregate("s.cells", nothing, step)["out"]))


def mix(df: DataFrame, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row.

    A null or empty text has size 0 and no copies; a null source is a source of its own;
    rows with the same id are separate rows (equal rows are interchangeable). Only the
    three named columns are read. Only narrow rows are shuffled, a hot source is never in
    one task: its rows are grouped by size, large groups of one size by hash buckets.
    """
    # a key that is never null and sorts by code point with null last
    key = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    narrow = df.select(F.col(id_col).alias("id"), key.alias("source"), n_words(F.col(text_col)).alias("size"))
    sizes = materialise(narrow, "sizes")
    cells = materialise(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    targets = materialise(source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), share, cap), "targets")
    copies = materialise(cell_copies(cells, solve_rates(cells, targets, cap), cap), "copies")
    # copies of a cell: everyone gets n_each, the first n_more in hash order one more
    plan = cells.join(copies.drop("n"), ["source", "size"], "left").join(targets, "source")
    plan = plan.selectExpr("source", "size", "source_size", "target", "n", f"cast(ceil(n / {CELL_BUCKET}) as int) as buckets", "coalesce(copies, 0) div n as n_each", "coalesce(copies, 0) % n as n_more")
    few = cells.agg(F.coalesce(F.sum(F.ceil(F.col("n") / CELL_BUCKET)), F.lit(0))).first()[0] <= BROADCAST_CELLS  # buckets of all cells
    rows = sizes.join(F.broadcast(plan) if few else plan, ["source", "size"]).withColumn("h", F.xxhash64("id", F.lit(9)))
    rows = rows.withColumn("bucket", F.pmod("h", "buckets"))
    cell = ["source", "size", "bucket"]
    per = rows.groupBy(*cell).agg(F.count("*").alias("m"), F.first("n_more").alias("n_more"), F.first("n").alias("n"))
    till = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket"))
    part = lambda c: F.floor(c * F.col("n_more") / F.col("n") + 1e-9)
    per = per.withColumn("till", till).select(*cell, (part(F.col("till")) - part(F.col("till") - F.col("m"))).alias("extra"))
    rows = rows.join(F.broadcast(per) if few else per, cell)
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("h", "id"))
    n = F.col("n_each") + F.when(place <= F.col("extra"), 1).otherwise(0)
    return rows.select(F.col("id").alias(id_col), F.when(F.col("source") != "1", F.substr("source", F.lit(2))).alias(source_col), "size", "source_size", "target", n.cast("long").alias("copies"))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes from every document."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
