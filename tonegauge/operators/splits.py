"""Train / test / evaluation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.keys import u
from tonegauge.operators import quantiles as Q
from tonegauge.operators.ordered import positions
from tonegauge.operators.probe import sample_uniform


def _half_count(n: int, frac: float) -> int:
    return int(round(frac * n))


def split_fraction(df: DataFrame, key_cols: list[str], frac: float = 0.5, seed: int = 42, by: str = "row",
                   text_col: str = "original_index") -> DataFrame:
    """F8: flag ``in_first`` for exactly ``round(frac * n)`` units; the rest is the complement.

    ``by='row'`` splits rows (the original's behaviour: one text can land on both sides);
    ``by='text'`` splits distinct texts, so no text leaks across.  The cut is the k-th smallest
    ``u`` found with the distributed order-statistic selector (no global sort, no single-task
    window); the units are those with ``u`` at or below it.
    Rows with equal keys share ``u`` and stay together, so the count is exact for distinct keys.
    """
    unit_cols = key_cols if by == "row" else [text_col]
    keyed = df.withColumn("_u", u(*[f"col:{k}" for k in unit_cols], seed, "split"))
    units = keyed.select(*unit_cols, "_u").dropDuplicates(unit_cols) if by == "text" else keyed.select("_u")
    n = units.count()
    k = _half_count(n, frac)
    if k == 0:
        return keyed.withColumn("in_first", F.lit(False)).drop("_u")
    stats = {"_u": {"n": n, "min": 0.0, "max": 1.0}}
    cut = Q.order_statistics(units.select(F.col("_u").alias("v0")), ["_u"], {"_u": {k - 1}}, stats)[("_u", k - 1)]
    return keyed.withColumn("in_first", F.col("_u") <= F.lit(cut)).drop("_u")


def sample_sources(df: DataFrame, n: int, id_col: str = "original_index", seed: int = 42) -> DataFrame:
    """n distinct source ids (F1 over the distinct ids), then their rows (left semi join)."""
    ids = sample_uniform(df.select(id_col).distinct(), n, [id_col], seed=seed)
    return df.join(ids, id_col, "left_semi")


def sample_per_group(df: DataFrame, k: int, group: str, key_cols: list[str], seed: int = 42) -> DataFrame:
    """up to k rows per group without replacement (the k smallest ``u`` of the group).

    ``row_number() <= k`` plans with a group limit before the shuffle (Spark's window group
    limit), so a hot group sends at most k rows per map partition."""
    w = Window.partitionBy(group).orderBy("_u", *key_cols)
    return (df.withColumn("_u", u(*[f"col:{c}" for c in key_cols], seed, "pergroup"))
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_u", "_rn"))


def first_groups(df: DataFrame, k: int, n_groups: int, group: str, order_cols: list[str]) -> DataFrame:
    """the first k rows (by ``order_cols``) of each of the first ``n_groups`` groups in order
    of first appearance.  The first groups come from a TakeOrdered over per-group minima."""
    firsts = df.groupBy(group).agg(F.min(F.struct(*order_cols)).alias("_first"))
    chosen = firsts.orderBy("_first").limit(n_groups).select(group)
    w = Window.partitionBy(group).orderBy(*order_cols)
    return df.join(chosen, group, "left_semi").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def with_position(df: DataFrame, order_cols: list[str], name: str = "pos") -> DataFrame:
    """Global 0-based position by a unique ``order_cols`` key (see :func:`ordered.positions`).

    Only the key columns are sorted and written; the rows meet their positions by the key."""
    return df.join(positions(df.select(*order_cols), order_cols, name), order_cols)


def paired_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The k-th key of ``a`` beside the k-th key of ``b`` (``_a_<key>``, ``_b_<key>``), in the order of the unique
    key, as far as both go: two narrow sorts and one join of positions."""
    left = positions(a.select(*[F.col(k).alias(f"_a_{k}") for k in key]), [f"_a_{k}" for k in key], "_pos")
    right = positions(b.select(*[F.col(k).alias(f"_b_{k}") for k in key]), [f"_b_{k}" for k in key], "_pos")
    return left.join(right, "_pos").drop("_pos")


def crossed(source_df: DataFrame, inst_df: DataFrame, pairs: DataFrame, goals: list[str], key: list[str],
            copy_cols: tuple[str, ...], source: str = "a", inst: str = "b") -> DataFrame:
    """The paired rows of ``source_df`` with the deltas and ``copy_cols`` of their partners in ``inst_df``.

    Targets are recomputed, filled from the source where no delta is asked, and clipped to [0, 1]."""
    taken = [f"delta_{g}" for g in goals] + list(copy_cols)
    own, other = [f"_{source}_{k}" for k in key], [f"_{inst}_{k}" for k in key]
    partner = inst_df.select(*[F.col(k).alias(o) for k, o in zip(key, other)], *taken).join(pairs, other).drop(*other)
    rows = source_df.drop(*taken).join(partner.withColumnsRenamed(dict(zip(own, key))), key)
    targets = {}
    for g in goals:
        t = F.coalesce(F.col(f"source_{g}") + F.col(f"delta_{g}"), F.col(f"source_{g}"))
        targets[f"target_{g}"] = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return rows.withColumns(targets)


def cross_probe(source_df: DataFrame, inst_df: DataFrame, goals: list[str], order_cols: list[str],
                copy_cols: tuple[str, ...] = ("instructions",)) -> DataFrame:
    """texts of one split paired by position with the deltas (and instructions) of another,
    truncated to the shorter side; targets recomputed, null-filled from source, clipped to [0, 1].
    The prompt is rebuilt by the caller from the row's own text (the original copied it, Q13)."""
    return crossed(source_df, inst_df, paired_keys(source_df, inst_df, order_cols), goals, order_cols, copy_cols)


def label_union(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """union of splits with a ``split`` label column."""
    out = None
    for name, df in parts:
        d = df.withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def exclude_ids(test: DataFrame, train_ids: list[DataFrame], id_col: str = "original_index") -> DataFrame:
    """F16: drop from ``test`` every id eligible for training under any config (distinct union,
    then a left anti join)."""
    ids = None
    for t in train_ids:
        s = t.select(id_col)
        ids = s if ids is None else ids.union(s)
    return test.join(ids.distinct(), id_col, "left_anti")


def meta_sample(df: DataFrame, size: str, key_cols: list[str], id_col: str = "original_index", seed: int = 430) -> DataFrame:
    """``"<texts>x<instructions>"``: F9 then F10."""
    n_texts, n_inst = map(int, size.split("x"))
    return sample_per_group(sample_sources(df, n_texts, id_col, seed), n_inst, id_col, key_cols, seed)
