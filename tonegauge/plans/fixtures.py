"""Stand-in input tables derived from the driver's test tables, in Spark and as DuckDB CTEs.

The reference exchanges CSV tables between an LLM, a scorer and a judge.  Here the LLM side is
replaced by rows derived deterministically from ``/root/testdata`` so every operator can run
over whole tables; the operators themselves (scoring, normalisation, probe generation, metrics)
run through the library code.  Stand-in parts (marked "stand-in") only produce rows of the
expected schema:

* ``scored``    documents -> D1-D4 raw goals (library scorers)              key ``row_id = doc_id``
* ``goalspace`` scored -> E1 percentile normalisation -> ``source_<g>``     (library)
* ``probe``     goalspace x F3 reps -> F4/F5 deltas -> targets              (library)
* ``result``    probe x generations + stand-in outputs:
                ``output_g = clip(s + coalesce(d, 0)(0.5 + u1) + 0.2(u2 - 0.5))``, null when u3 < 0.02;
                stand-in response = the text with adjacent word pairs swapped
* ``judged``    result left join labels: answer Yes/No from ``quality``, approval from ``toxic``
* ``numeric``   lineitem quantity / extendedprice / discount / tax as four goals, same chain

Every random choice goes through ``u``/``u4`` (md5), so the SQL twins rebuild identical rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.functions.scorers import REGISTRY
from tonegauge.keys import md5_hex, u4_sql, u_from_hex
from tonegauge.operators import normalise as N
from tonegauge.operators import probe as P
from tonegauge.schema import DEFAULT_GOALS

GOALS = list(DEFAULT_GOALS)
NUM_GOALS = ["quantity", "extendedprice", "discount", "tax"]
REPS = 4
MAX_ACTIVE = 3
SEED = 42
NULL_RATE = 0.02
SWAP = r"(\p{L}+) (\p{L}+)"

_CACHE: dict = {}


def reset() -> None:
    """Release cached fixture tables (the bench calls this between queries)."""
    for df in _CACHE.values():
        if isinstance(df, DataFrame):
            df.unpersist()
    _CACHE.clear()


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy per-row text work all cores: hash-repartition on the key when one of the scan's partitions holds
    more than twice its share of the rows.  A row group is read by one task, so a file of few row groups leaves most of
    its splits empty, however many they are.  The number of partitions follows the number of splits, i.e. the bytes read.
    The count below reads no column; inputs that arrive evenly are left alone."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism * 2, df.rdd.getNumPartitions())
    held = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    if held.most is not None and held.most * parts > 2 * held.rows:
        return df.repartition(parts, key)
    return df


# --------------------------------------------------------------------------------------------
# Spark builders

def scored(spark: SparkSession, sf: str, goals=GOALS) -> DataFrame:
    """D5 over ``documents``: ``row_id, text, source`` + raw goal columns (persisted once)."""
    key = ("scored", id(spark), sf, tuple(goals))
    if key not in _CACHE:
        docs = read(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", "source")
        out = spread(docs, "row_id").withColumns({g: REGISTRY.get(g)(F.col("text")) for g in goals})
        _CACHE[key] = out.persist(StorageLevel.MEMORY_AND_DISK)
    return _CACHE[key]


def goalspace(spark: SparkSession, sf: str, goals=GOALS) -> DataFrame:
    """E1 on ``scored``: ``source_<g>`` from the 2.5 / 97.5 percentiles."""
    key = ("bounds", id(spark), sf, tuple(goals))
    s = scored(spark, sf, goals)
    if key not in _CACHE:
        _CACHE[key] = N.percentile_bounds(s, goals, 95)
    return N.apply_bounds(s, _CACHE[key])


def probe(spark: SparkSession, sf: str, goals=GOALS, reps: int = REPS, seed: int = SEED, response: bool = False) -> DataFrame:
    gs = goalspace(spark, sf, goals).withColumnRenamed("row_id", "original_index")
    if response:
        gs = gs.withColumn("llm_response", F.regexp_replace(F.col("text"), SWAP, "$2 $1"))
    return P.with_deltas(P.repeat_rows(gs, reps), goals, ["original_index", "rep"], seed, MAX_ACTIVE)


def with_outputs(df: DataFrame, goals: list[str], key_cols: list[str], seed: int = SEED) -> DataFrame:
    """Stand-in model outputs (see module docstring); one md5 per row and goal."""
    keys = [f"col:{k}" for k in key_cols]
    df = df.withColumns({f"_oh_{g}": md5_hex(*keys, seed, "out", g) for g in goals})
    cols = {}
    for g in goals:
        h = F.col(f"_oh_{g}")
        cols[f"_o1_{g}"], cols[f"_o2_{g}"], cols[f"_o3_{g}"] = u_from_hex(h, 0), u_from_hex(h, 1), u_from_hex(h, 2)
    df = df.withColumns(cols).drop(*[f"_oh_{g}" for g in goals])
    outs = {}
    for g in goals:
        s, d = F.col(f"source_{g}"), F.coalesce(F.col(f"delta_{g}"), F.lit(0.0))
        moved = s + d * (F.lit(0.5) + F.col(f"_o1_{g}")) + F.lit(0.2) * (F.col(f"_o2_{g}") - F.lit(0.5))
        outs[f"output_{g}"] = F.when(F.col(f"_o3_{g}") < F.lit(NULL_RATE), F.lit(None).cast("double")).otherwise(N.clip01(moved))
    return df.withColumns(outs).drop(*cols)


def result(spark: SparkSession, sf: str, goals=GOALS, generations: int = 1) -> DataFrame:
    # the stand-in response hangs on the text alone: one replacement a text, below the repeats
    p = probe(spark, sf, goals, response=True)
    p = P.repeat_rows(p, generations, "generation")
    p = p.select(*[c for c in p.columns if c != "llm_response"], "llm_response")
    return with_outputs(p, goals, ["original_index", "rep", "generation"])


def judged(spark: SparkSession, sf: str, goals=GOALS, generations: int = 1) -> DataFrame:
    labels = read(spark, sf, "labels")
    r = result(spark, sf, goals, generations)
    j = r.join(labels, r["original_index"] == labels["doc_id"], "left")
    return j.select(
        *[r[c] for c in r.columns],
        F.when(labels["quality"] == 1, F.lit("Yes")).when(labels["quality"] == 0, F.lit("No")).alias("answer"),
        F.when(labels["doc_id"].isNotNull(),
               F.concat(F.lit("quality "), labels["quality"].cast("string"), F.lit(", toxic "), labels["toxic"].cast("string"))
               ).alias("rationale"),
        F.coalesce(labels["toxic"] == 0, F.lit(True)).alias("rationale_approved"),
        F.lit(False).alias("spot_check"),
    )


def numeric_goalspace(spark: SparkSession, sf: str, extend=None) -> DataFrame:
    """E1 over lineitem; ``extend`` adds columns to the narrow rows before the goal columns are derived."""
    cols = ["l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
            F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")]
    li = read(spark, sf, "lineitem").select(*cols)
    key = ("numbounds", id(spark), sf)
    if key not in _CACHE:
        _CACHE[key] = N.percentile_bounds(spread(li, "l_orderkey"), NUM_GOALS, 95)
    li = spread(li, "l_orderkey") if extend is None else extend(li)
    return N.apply_bounds(li, _CACHE[key])


def numeric_result(spark: SparkSession, sf: str, extend=None) -> DataFrame:
    gs = numeric_goalspace(spark, sf, extend)
    keys = ["l_orderkey", "l_linenumber"]
    p = P.with_deltas(gs, NUM_GOALS, keys, SEED, MAX_ACTIVE)
    return with_outputs(p, NUM_GOALS, keys)


# --------------------------------------------------------------------------------------------
# DuckDB twins (CTE lists: name -> SELECT)

def sql_scored(goals=GOALS) -> list[tuple[str, str]]:
    sel = ", ".join(f"{REGISTRY.sql(g)('text')} AS {g}" for g in goals)
    return [("scored", f"SELECT doc_id AS row_id, text, source, {sel} FROM documents")]


def sql_goalspace(goals=GOALS) -> list[tuple[str, str]]:
    bounds, src = N.normalize_percentile_sql("scored", goals, alias="bnd")
    return sql_scored(goals) + [("bnd", bounds), ("goalspace", f"SELECT s.*, {src} FROM scored s CROSS JOIN bnd")]


def _delta_ctes(src_cte: str, goals, keys, seed=SEED, prefix="p") -> list[tuple[str, str]]:
    bind, deltas = P.deltas_sql(goals, keys, seed, MAX_ACTIVE)
    b = ", ".join(f"{v} AS {k}" for k, v in bind.items())
    d = ", ".join(f"{v} AS {k}" for k, v in deltas.items())
    t = ", ".join(f"source_{g} + delta_{g} AS target_{g}" for g in goals)
    drop = ", ".join(bind)
    return [
        (f"{prefix}_u", f"SELECT *, {b} FROM {src_cte}"),
        (f"{prefix}_d", f"SELECT * EXCLUDE ({drop}), {d} FROM {prefix}_u"),
        (f"{prefix}robe", f"SELECT *, {t} FROM {prefix}_d"),
    ]


def sql_probe(goals=GOALS, reps: int = REPS) -> list[tuple[str, str]]:
    rep = ("rep_rows", "SELECT * EXCLUDE (row_id), row_id AS original_index, "
                       f"CAST(unnest(generate_series(1, {reps})) AS INTEGER) AS rep FROM goalspace")
    return sql_goalspace(goals) + [rep] + _delta_ctes("rep_rows", goals, ["original_index", "rep"])


def _output_ctes(src: str, goals, keys, name: str, seed: int = SEED) -> list[tuple[str, str]]:
    binds = []
    for g in goals:
        u1, u2, u3, _ = u4_sql(*[f"col:{k}" for k in keys], seed, "out", g)
        binds += [f"{u1} AS _o1_{g}", f"{u2} AS _o2_{g}", f"{u3} AS _o3_{g}"]
    outs = []
    for g in goals:
        moved = (f"source_{g} + coalesce(delta_{g}, 0.0::DOUBLE) * (0.5::DOUBLE + _o1_{g}) "
                 f"+ 0.2::DOUBLE * (_o2_{g} - 0.5::DOUBLE)")
        outs.append(f"CASE WHEN _o3_{g} < {NULL_RATE!r}::DOUBLE THEN NULL ELSE {N.clip01_sql(moved)} END AS output_{g}")
    drop = ", ".join(f"_o{k}_{g}" for g in goals for k in (1, 2, 3))
    return [
        (f"{name}_u", f"SELECT *, {', '.join(binds)} FROM {src}"),
        (name, f"SELECT * EXCLUDE ({drop}), {', '.join(outs)} FROM {name}_u"),
    ]


def sql_result(goals=GOALS, generations: int = 1) -> list[tuple[str, str]]:
    gen = ("gen_rows", f"SELECT *, CAST(unnest(generate_series(1, {generations})) AS INTEGER) AS generation, "
                       f"regexp_replace(text, '{SWAP}', '\\2 \\1', 'g') AS llm_response FROM probe")
    return sql_probe(goals) + [gen] + _output_ctes("gen_rows", goals, ["original_index", "rep", "generation"], "result")


def sql_judged(goals=GOALS, generations: int = 1) -> list[tuple[str, str]]:
    j = ("judged", "SELECT r.*, CASE WHEN l.quality = 1 THEN 'Yes' WHEN l.quality = 0 THEN 'No' END AS answer, "
                   "CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || CAST(l.quality AS VARCHAR) || ', toxic ' || CAST(l.toxic AS VARCHAR) END AS rationale, "
                   "coalesce(l.toxic = 0, TRUE) AS rationale_approved, FALSE AS spot_check "
                   "FROM result r LEFT JOIN labels l ON r.original_index = l.doc_id")
    return sql_result(goals, generations) + [j]


def sql_numeric_goalspace() -> list[tuple[str, str]]:
    li = ("li", "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS extendedprice, "
                "l_discount AS discount, l_tax AS tax FROM lineitem")
    bounds, src = N.normalize_percentile_sql("li", NUM_GOALS, alias="nbnd")
    return [li, ("nbnd", bounds), ("ngoalspace", f"SELECT s.*, {src} FROM li s CROSS JOIN nbnd")]


def sql_numeric_result() -> list[tuple[str, str]]:
    keys = ["l_orderkey", "l_linenumber"]
    return (sql_numeric_goalspace() + _delta_ctes("ngoalspace", NUM_GOALS, keys, prefix="n")
            + _output_ctes("nrobe", NUM_GOALS, keys, "nresult"))


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    seen = []
    names = {}
    for name, body in ctes:
        if name in names:
            if names[name] != body:
                raise ValueError(f"CTE name {name} reused with a different body")
            continue
        names[name] = body
        seen.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(seen) + "\n" + final
