"""Movement fields over 2-goal subspaces (L1-L7) and text overlap (M1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions import text as tx
from tonegauge.operators import metrics as M


def subspace(df: DataFrame, g1: str, g2: str, goals: list[str], unspecified: bool = True,
             specified_first: bool = False, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """L1: source point (x1, x2), binned movement (dx1, dx2) and requested movement
    (dx1_ideal, dx2_ideal) of two goals.  ``unspecified`` keeps rows whose requested movement
    *sums* to zero over the pair (so +1/7 and -1/7 cancel, as in the original);
    ``specified_first`` keeps rows moving the first goal only."""
    v = M.with_vectors(M.with_bins(df, goals), goals)
    out = v.select(*key_cols, F.col(f"source_{g1}").alias("x1"), F.col(f"source_{g2}").alias("x2"),
                   F.col(f"moved_{g1}").alias("dx1"), F.col(f"moved_{g2}").alias("dx2"),
                   F.coalesce(F.col(f"requested_{g1}"), F.lit(0.0)).alias("dx1_ideal"),
                   F.coalesce(F.col(f"requested_{g2}"), F.lit(0.0)).alias("dx2_ideal"))
    if unspecified:
        return out.filter(F.col("dx1_ideal") + F.col("dx2_ideal") == 0)
    if specified_first:
        return out.filter((F.abs(F.col("dx1_ideal")) > 0) & (F.col("dx2_ideal") == 0))
    return out


def vectors(sub: DataFrame, mode: str = "movement") -> DataFrame:
    """L2: arrows (u, v) = the movement, or the remaining distance (requested - moved)."""
    if mode == "movement":
        return sub.withColumns({"u": F.col("dx1"), "v": F.col("dx2")})
    return sub.withColumns({"u": F.col("dx1_ideal") - F.col("dx1"), "v": F.col("dx2_ideal") - F.col("dx2")})


def drop_close(vec: DataFrame, threshold: float) -> DataFrame:
    """L3: keep arrows longer than ``threshold``."""
    return vec.filter(F.hypot("u", "v") > F.lit(threshold))


def grid_bounds(vec: DataFrame) -> DataFrame:
    """L4: the observed range of the points (one aggregate row)."""
    return vec.agg(F.min("x1").alias("x1_min"), F.max("x1").alias("x1_max"), F.min("x2").alias("x2_min"), F.max("x2").alias("x2_max"))


def field(vec: DataFrame, n: int = 51, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """L4 + L5: regular ``n x n`` grid over the observed range; each arrow is assigned to its
    nearest grid node and the field is the per-node mean (empty nodes dropped).  One aggregate
    (one shuffle); the bounds row is broadcast (a single row).  Replaces scattered-data
    interpolation with a binned mean."""
    b = vec.groupBy(*group_cols).agg(F.min("x1").alias("x1_min"), F.max("x1").alias("x1_max"),
                                     F.min("x2").alias("x2_min"), F.max("x2").alias("x2_max"))
    j = vec.join(F.broadcast(b), list(group_cols)) if group_cols else vec.crossJoin(F.broadcast(b))

    def cell(x, lo, hi):
        span = F.col(hi) - F.col(lo)
        return F.when(span > 0, F.round((F.col(x) - F.col(lo)) / span * F.lit(n - 1)).cast("int")).otherwise(F.lit(0))

    j = j.withColumns({"gx": cell("x1", "x1_min", "x1_max"), "gy": cell("x2", "x2_min", "x2_max")})
    agg = j.groupBy(*group_cols, "gx", "gy").agg(
        F.first("x1_min").alias("x1_min"), F.first("x1_max").alias("x1_max"), F.first("x2_min").alias("x2_min"),
        F.first("x2_max").alias("x2_max"), F.avg("u").alias("u"), F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    x = F.col("x1_min") + F.col("gx") * (F.col("x1_max") - F.col("x1_min")) / F.lit(n - 1)
    y = F.col("x2_min") + F.col("gy") * (F.col("x2_max") - F.col("x2_min")) / F.lit(n - 1)
    return agg.select(*group_cols, "gx", "gy", x.alias("x"), y.alias("y"), "u", "v", "n")


def idw_field(vec: DataFrame, n: int = 51, radius: int = 2, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """L5 by inverse-distance weighting: the field at each node of the ``n x n`` grid over the observed range, from
    the arrows within ``radius`` cells of it, weighted by 1 / distance squared; arrows exactly on a node decide
    alone.  Nodes without an arrow so near are dropped.

    An arrow adds to at most ``(2 radius + 1) ** 2`` nodes around it, and the sums combine on the map side: the
    work is the arrows times a constant, not times the grid, and what is shuffled is bounded by the grid.
    """
    b = vec.groupBy(*group_cols).agg(F.min("x1").alias("x1_min"), F.max("x1").alias("x1_max"),
                                     F.min("x2").alias("x2_min"), F.max("x2").alias("x2_max"))
    j = vec.join(F.broadcast(b), list(group_cols)) if group_cols else vec.crossJoin(F.broadcast(b))

    def place(x: str) -> Column:
        span = F.col(f"{x}_max") - F.col(f"{x}_min")
        return F.when(span > 0, (F.col(x) - F.col(f"{x}_min")) / span * F.lit(n - 1)).otherwise(F.lit(0.0))

    j = j.withColumns({"fx": place("x1"), "fy": place("x2")})

    def nodes(f: str) -> Column:
        at = F.round(f).cast("int")
        return F.sequence(F.greatest(at - radius, F.lit(0)), F.least(at + radius, F.lit(n - 1)))

    j = j.withColumn("gx", F.explode(nodes("fx"))).withColumn("gy", F.explode(nodes("fy")))
    d2 = (F.col("fx") - F.col("gx")) * (F.col("fx") - F.col("gx")) + (F.col("fy") - F.col("gy")) * (F.col("fy") - F.col("gy"))
    j = j.withColumn("d2", d2).filter(F.col("d2") <= float(radius * radius)).withColumn("w", F.when(F.col("d2") > 0, F.lit(1.0) / F.col("d2")))
    on = F.col("d2") == 0
    first = [F.first(c).alias(c) for c in ("x1_min", "x1_max", "x2_min", "x2_max")]
    agg = j.groupBy(*group_cols, "gx", "gy").agg(
        *first, F.count("*").alias("n"), F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(f"w{c}") for c in "uv"],
        *[F.avg(F.when(on, F.col(c))).alias(f"on_{c}") for c in "uv"])
    x = F.col("x1_min") + F.col("gx") * (F.col("x1_max") - F.col("x1_min")) / F.lit(n - 1)
    y = F.col("x2_min") + F.col("gy") * (F.col("x2_max") - F.col("x2_min")) / F.lit(n - 1)
    return agg.select(*group_cols, "gx", "gy", x.alias("x"), y.alias("y"), *[F.coalesce(f"on_{c}", F.col(f"w{c}") / F.col("w")).alias(c) for c in "uv"], "n")


def scaled(fld: DataFrame, factor: float = 1.5) -> DataFrame:
    """Arrows x1.5, their magnitude, and the field's maximum magnitude (broadcast scalar)."""
    s = fld.withColumns({"u": F.col("u") * factor, "v": F.col("v") * factor}).withColumn("magnitude", F.hypot("u", "v"))
    mx = s.agg(F.max("magnitude").alias("max_magnitude"))
    return s.crossJoin(F.broadcast(mx))


def pairwise_fields(df: DataFrame, goals: list[str], n: int = 20, mode: str = "movement") -> DataFrame:
    """Every ordered goal pair (specified-first subspaces) in one pass: rows are exploded
    into pairs and one aggregate computes all fields."""
    v = M.with_vectors(M.with_bins(df, goals), goals)
    pairs = []
    for a in goals:
        for b in goals:
            if a != b:
                pairs.append(F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"source_{a}").alias("x1"), F.col(f"source_{b}").alias("x2"),
                                      F.col(f"moved_{a}").alias("dx1"), F.col(f"moved_{b}").alias("dx2"),
                                      F.coalesce(F.col(f"requested_{a}"), F.lit(0.0)).alias("dx1_ideal"),
                                      F.coalesce(F.col(f"requested_{b}"), F.lit(0.0)).alias("dx2_ideal")))
    long = v.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    long = long.filter((F.abs(F.col("dx1_ideal")) > 0) & (F.col("dx2_ideal") == 0))
    return field(vectors(long, mode), n, group_cols=("pair",))


# --------------------------------------------------------------------------------------------
# M1 sentence BLEU

def _fixed(df: DataFrame, keep: list[str], cols: dict[str, Column]) -> DataFrame:
    """``keep`` and ``cols``, which a generator fixes: a merged projection would evaluate them once for every use, a lambda
    once an entry."""
    one = F.struct(*[c.alias(name) for name, c in cols.items()])
    return df.select(*keep, F.explode(F.array(one)).alias("_x")).select(*keep, "_x.*")


def _longer(g: Column, h: Column, n: int) -> Column:
    """The n-grams of the tokens ``h`` from the n-grams ``g`` of one token less."""
    many = F.greatest(F.size(h) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(g, 1, many), F.slice(h, n, many), lambda a, b: F.xxhash64(a, b))


#: bytes of both texts, copies included, that a task of :func:`pair_bleu` takes
PART_BYTES = 8 << 20


def pair_bleu(pairs: DataFrame, key: list[str], cand: str, ref: str, top: int = 4, eps: float = 0.1) -> DataFrame:
    """(key, bleu): sentence BLEU of each pair of texts, as a multiset intersection.

    An n-gram is a 64-bit hash (one text has far too few for two to meet).  What matches is the smaller count of both
    sides: one for each n-gram that both have, found within the row, and the smaller count of its repeats.  In a sorted
    array a repeat follows its equal, so only repeats become rows (key, n, gram) with a count a side.  The texts are dealt
    by ``key`` once, and all aggregates below keep that dealing: one shuffle, of the texts.
    Uniform weights, method-1 smoothing (a zero count becomes eps), brevity penalty; 0 when no token matches, null when
    a text is null.  ``key`` is not null; rows with equal keys hold equal texts and count once.
    """
    # fixed, as a derived text would be made once more for the filter, which goes below a projection
    pairs = _fixed(pairs, key, {"_c": F.col(cand), "_r": F.col(ref)})
    # few bytes of text are many n-grams: at most PART_BYTES of texts a partition, so that no task's counts spill
    size = pairs.agg(F.sum(F.octet_length("_c").cast("long") + F.octet_length("_r"))).first()[0] or 0
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = pairs.filter(F.col("_c").isNotNull() & F.col("_r").isNotNull()).repartition(parts, *key).dropDuplicates(key)
    grams = _fixed(rows, key, {f"{s}1": F.transform(tx.tokens(F.col(f"_{s}")), lambda x: F.xxhash64(x)) for s in "cr"})
    for n in range(2, top + 1):
        grams = _fixed(grams, grams.columns, {f"{s}{n}": _longer(F.col(f"{s}{n - 1}"), F.col(f"{s}1"), n) for s in "cr"})
    orders = F.array(*[F.struct(F.lit(n).alias("n"), *[F.sort_array(f"{s}{n}").alias(s) for s in "cr"]) for n in range(1, top + 1)])
    orders = grams.select(*key, F.explode(orders).alias("_x")).select(*key, "_x.*")
    common = F.size(F.array_intersect("c", "r"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("g"), hit.alias("hit")) for s, hit in (("c", common), ("r", F.lit(0)))])
    sides = orders.select(*key, "n", F.explode(sides).alias("_x")).select(*key, "n", "_x.*")
    # the first entry, or the null of an empty array, stays too: it brings the matches and counts the side's n-grams
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    entries = sides.select("*", F.posexplode_outer("g").alias("i", "x")).filter(first | (F.get("g", F.col("i") - 1) == F.col("x")))
    many = F.when(first, F.size("g")).otherwise(1)
    counted = entries.groupBy(*key, "n", F.when(~first, F.col("x")).alias("x")).agg(
        *[F.sum(F.when(F.col("side") == s, many).otherwise(0)).alias(f"_{s}") for s in "cr"], F.sum(F.when(first, F.col("hit")).otherwise(0)).alias("hit"))
    hit = F.when(F.col("x").isNull(), F.col("hit")).otherwise(F.least("_c", "_r"))
    sizes = [F.max(F.when((F.col("n") == 1) & F.col("x").isNull(), F.col(f"_{s}"))).alias(f"_{s}s") for s in "cr"]
    row = counted.groupBy(*key).agg(*[F.sum(F.when(F.col("n") == n, hit).otherwise(0)).alias(f"_h{n}") for n in range(1, top + 1)], *sizes)
    logs = None
    for n in range(1, top + 1):
        p = F.when(F.col(f"_h{n}") > 0, F.col(f"_h{n}").cast("double")).otherwise(F.lit(eps)) / F.greatest(F.lit(1), F.col("_cs") - (n - 1))
        logs = F.log(p) / top if logs is None else logs + F.log(p) / top
    brief = F.when(F.col("_cs") > F.col("_rs"), 1.0).otherwise(F.exp(1 - F.col("_rs") / F.greatest(F.col("_cs"), F.lit(1))))
    return row.select(*key, F.when(F.col("_h1") > 0, brief * F.exp(logs)).otherwise(0.0).alias("bleu"))


def with_bleu(df: DataFrame, cand: str = "llm_response", ref: str = "text") -> DataFrame:
    """M1 per row: ``bleu`` of ``cand`` against ``ref`` (C4 tokens), null when either is null.

    Rows with equal texts share one computation: a pair is known by two hashes of both texts (128 bits), and
    the result comes back to the rows by that key."""
    keyed = df.withColumns({"_p1": F.xxhash64(cand, ref), "_p2": F.xxhash64(F.lit(1), ref, cand)})
    return keyed.join(pair_bleu(keyed, ["_p1", "_p2"], cand, ref), ["_p1", "_p2"], "left").drop("_p1", "_p2")


def bleu_by_source(df: DataFrame, source: str = "source") -> DataFrame:
    """M1: mean BLEU overall (``source`` = 'all') and per source dataset via ``rollup``."""
    out = df.rollup(source).agg(F.avg("bleu").alias("mean_bleu"), F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce(F.col(source), F.lit("all")).alias(source), "mean_bleu", "n")
