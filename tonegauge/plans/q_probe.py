"""Queries F1-F17 (sampling, probe construction, splits)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tonegauge.keys import u_sql
from tonegauge.operators import normalise as N
from tonegauge.operators import probe as P
from tonegauge.operators import prompts as PR
from tonegauge.operators import splits as SP
from tonegauge.operators import training as TR
from tonegauge.plans import fixtures as X
from tonegauge.plans.registry import query, rounded
from tonegauge.session import checkpoint_dir

G = X.GOALS
PKEY = ["original_index", "rep"]
PKEY_SQL = "original_index, rep"
W = X.with_ctes


def weighted_goalspace(spark, sf):
    """Goalspace plus stand-in sampling weights proportional to ``source_text_length + 0.5``."""
    gs = X.goalspace(spark, sf)
    total = gs.agg(F.sum(F.col("source_text_length") + F.lit(0.5)).alias("_t"))
    return gs.crossJoin(F.broadcast(total)).withColumn("sampling_weights", (F.col("source_text_length") + F.lit(0.5)) / F.col("_t")).drop("_t")


def sql_weighted():
    return X.sql_goalspace() + [("wgs", "SELECT *, (source_text_length + 0.5) / sum(source_text_length + 0.5) OVER () AS sampling_weights FROM goalspace")]


@query("f1_sample_uniform", W(X.sql_goalspace(), f"SELECT row_id FROM goalspace ORDER BY {u_sql('col:row_id', 42, 'sample')}, row_id LIMIT 64"))
def f1_sample_uniform(spark, sf):
    """64 texts uniformly without replacement (seeded)."""
    return P.sample_uniform(X.goalspace(spark, sf), 64, ["row_id"]).select("row_id")


@query("f2_sample_weighted", W(sql_weighted(), f"SELECT row_id FROM wgs WHERE sampling_weights > 0 ORDER BY "
                              f"-ln(1.0 - {u_sql('col:row_id', 42, 'wsample')}) / sampling_weights, row_id LIMIT 64"))
def f2_sample_weighted(spark, sf):
    """64 texts by weight without replacement (exponential keys)."""
    return P.sample_weighted(weighted_goalspace(spark, sf), 64, ["row_id"]).select("row_id")


@query("f3_f4_f5_probe_deltas", W(X.sql_probe(), f"SELECT {PKEY_SQL}, " + ", ".join(f"round(delta_{g}, 6) AS delta_{g}, round(target_{g}, 6) AS target_{g}" for g in G)
                                  + ", " + " + ".join(f"CAST(delta_{g} IS NOT NULL AS INTEGER)" for g in G) + " AS n_active FROM probe"))
def f3_f4_f5_probe_deltas(spark, sf):
    """F3 repeat x4, F4 exactly 3 active goals, F5 deltas outside the dead zone, targets."""
    p = X.probe(spark, sf)
    n_active = sum((F.col(f"delta_{g}").isNotNull().cast("int") for g in G[1:]), F.col(f"delta_{G[0]}").isNotNull().cast("int"))
    return rounded(p.select(*PKEY, *[c for g in G for c in (F.col(f"delta_{g}"), F.col(f"target_{g}"))], n_active.alias("n_active")))


def _final_probe_sql(seed=42, n=64, reps=32):
    sample = ("fp_s", f"SELECT * FROM wgs WHERE sampling_weights > 0 ORDER BY -ln(1.0 - {u_sql('col:row_id', seed, 'wsample')}) / sampling_weights, row_id LIMIT {n}")
    rep = ("fp_r", f"SELECT * EXCLUDE (row_id), row_id AS original_index, CAST(unnest(generate_series(1, {reps})) AS INTEGER) AS rep FROM fp_s")
    return sql_weighted() + [sample, rep] + X._delta_ctes("fp_r", G, PKEY, seed, prefix="f")


@query("f6_final_probe", W(_final_probe_sql(), f"SELECT {PKEY_SQL}, " + ", ".join(f"round(delta_{g}, 6) AS delta_{g}, round(target_{g}, 6) AS target_{g}" for g in G) + " FROM frobe"))
def f6_final_probe(spark, sf):
    """the 64x32 probe: weighted sample of 64 texts, 32 goal draws each, deltas, targets."""
    p = P.final_probe(weighted_goalspace(spark, sf), G, 64, 32, key="row_id")
    return rounded(p.select(*PKEY, *[c for g in G for c in (f"delta_{g}", f"target_{g}")]))


@query("f7_matched_probe", W(X.sql_probe() + [("mp0", "SELECT * EXCLUDE (" + ", ".join(f"delta_{g}, target_{g}" for g in G) + ") FROM probe")]
                             + X._delta_ctes("mp0", G, PKEY, 7, prefix="m"),
                             f"SELECT {PKEY_SQL}, " + ", ".join(f"round(delta_{g}, 6) AS delta_{g}, round(target_{g}, 6) AS target_{g}" for g in G) + " FROM mrobe"))
def f7_matched_probe(spark, sf):
    """same texts and sources, fresh deltas and targets under another seed."""
    p = P.matched_probe(X.probe(spark, sf), seed=7)
    return rounded(p.select(*PKEY, *[c for g in G for c in (f"delta_{g}", f"target_{g}")]))


def _split_sql(seed=42, frac=0.5, src="probe", name="sp"):
    uu = u_sql("col:original_index", "col:rep", seed, "split")
    return [(name, f"SELECT *, row_number() OVER (ORDER BY {uu}, {PKEY_SQL}) <= CAST(round({frac} * count(*) OVER ()) AS BIGINT) AS in_first FROM {src}")]


@query("f8_split_half", W(X.sql_probe() + _split_sql(), f"SELECT {PKEY_SQL}, in_first FROM sp"))
def f8_split_half(spark, sf):
    """F8: exact 50/50 row split (train = first, test = complement)."""
    return SP.split_fraction(X.probe(spark, sf), PKEY).select(*PKEY, "in_first")


def _f9_sql(src, n, seed, name):
    return [(f"{name}_ids", f"SELECT original_index FROM (SELECT DISTINCT original_index FROM {src}) "
                            f"ORDER BY {u_sql('col:original_index', seed, 'sample')}, original_index LIMIT {n}"),
            (name, f"SELECT * FROM {src} WHERE original_index IN (SELECT original_index FROM {name}_ids)")]


def _f10_sql(src, k, seed, name):
    uu = u_sql("col:original_index", "col:rep", seed, "pergroup")
    return [(name, f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY original_index ORDER BY {uu}, {PKEY_SQL}) AS rn FROM {src}) WHERE rn <= {k}")]


@query("f9_f10_sources_and_per_text", W(X.sql_probe() + _split_sql() + [("tr", "SELECT * FROM sp WHERE in_first")] + _f9_sql("tr", 16, 42, "f9") + _f10_sql("f9", 2, 42, "f10"),
                                        f"SELECT {PKEY_SQL} FROM f10"))
def f9_f10_sources_and_per_text(spark, sf):
    """F9 16 distinct source texts of the train half, F10 up to 2 rows per text."""
    tr = SP.split_fraction(X.probe(spark, sf), PKEY).filter("in_first")
    return SP.sample_per_group(SP.sample_sources(tr, 16), 2, "original_index", PKEY).select(*PKEY)


@query("f11_first_groups", W(X.sql_probe() + [
    ("fg", "SELECT original_index FROM probe GROUP BY original_index ORDER BY min(rep), original_index LIMIT 10"),
    ("fr", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY original_index ORDER BY {PKEY_SQL}) AS rn FROM probe "
           "WHERE original_index IN (SELECT original_index FROM fg)) WHERE rn <= 3")], f"SELECT {PKEY_SQL} FROM fr"))
def f11_first_groups(spark, sf):
    """first 3 rows of each of the first 10 texts in order of appearance (rep, then id)."""
    return SP.first_groups(X.probe(spark, sf), 3, 10, "original_index", ["rep", "original_index"]).select(*PKEY)


def _f12_sql():
    inst = PR.direct_instruction_sql(G, PKEY, disambig=True)
    return X.sql_probe() + _split_sql() + [
        ("a", f"SELECT *, row_number() OVER (ORDER BY {PKEY_SQL}) - 1 AS pos FROM sp WHERE in_first"),
        ("b", f"SELECT *, {inst} AS instructions, row_number() OVER (ORDER BY {PKEY_SQL}) - 1 AS pos FROM sp WHERE NOT in_first"),
        ("cp", "SELECT a.original_index, a.rep, b.instructions, " + ", ".join(
            f"b.delta_{g} AS delta_{g}, least(greatest(coalesce(a.source_{g} + b.delta_{g}, a.source_{g}), 0.0), 1.0) AS target_{g}" for g in G)
         + " FROM a JOIN b USING (pos)")]


@query("f12_cross_probe", W(_f12_sql(), f"SELECT {PKEY_SQL}, md5(instructions) AS inst_md5, " + ", ".join(
    f"round(delta_{g}, 6) AS delta_{g}, round(target_{g}, 6) AS target_{g}" for g in G) + " FROM cp"))
def f12_cross_probe(spark, sf):
    """train texts paired by position with test deltas / instructions; targets recomputed."""
    s = SP.split_fraction(X.probe(spark, sf), PKEY)
    a = s.filter("in_first")
    b = s.filter("NOT in_first").withColumn("instructions", PR.direct_instruction(G, PKEY, disambig=True))
    cp = SP.cross_probe(a, b, G, PKEY)
    return rounded(cp.select(*PKEY, F.md5("instructions").alias("inst_md5"), *[c for g in G for c in (f"delta_{g}", f"target_{g}")]))


@query("f13_f14_f15_eval_sets", W(X.sql_probe() + _split_sql() + [("tr", "SELECT * FROM sp WHERE in_first"), ("te", "SELECT * FROM sp WHERE NOT in_first")]
                                  + _f9_sql("tr", 16, 42, "trs") + _f10_sql("trs", 2, 42, "trk") + _f9_sql("te", 8, 43, "tes") + _f10_sql("tes", 2, 43, "tek")
                                  + [("ev", f"SELECT 'train' AS split, {PKEY_SQL}, {PR.direct_instruction_sql(G, PKEY, disambig=True)} AS instructions FROM trk "
                                            f"UNION ALL SELECT 'test' AS split, {PKEY_SQL}, {PR.direct_instruction_sql(G, PKEY, disambig=True)} AS instructions FROM tek")],
                                  f"SELECT split, {PKEY_SQL}, md5(instructions) AS inst_md5 FROM ev"))
def f13_f14_f15_eval_sets(spark, sf):
    """F14 train/test construction (F8 -> F9 -> F10 -> G9 instructions) and the F13 labelled
    union used as the evaluation set (F15's composition, without the file sinks)."""
    s = SP.split_fraction(X.probe(spark, sf), PKEY)
    tr = SP.sample_per_group(SP.sample_sources(s.filter("in_first"), 16, seed=42), 2, "original_index", PKEY, seed=42)
    te = SP.sample_per_group(SP.sample_sources(s.filter("NOT in_first"), 8, seed=43), 2, "original_index", PKEY, seed=43)
    inst = PR.direct_instruction(G, PKEY, disambig=True)
    ev = SP.label_union([("train", tr.withColumn("instructions", inst)), ("test", te.withColumn("instructions", inst))])
    return ev.select("split", *PKEY, F.md5("instructions").alias("inst_md5"))


TRAINING = TR.TrainingConfig(n_source_texts=64, instructions_per_text=2, num_train_prompts_for_eval=48, num_test_prompts_for_eval=64,
                             insts_per_probe_source_text=2, clip_min=0.6, clip_max=1.4)


def _drawn_sql(src, n, k, seed, name):
    uu = u_sql("col:original_index", "col:rep", seed, "pergroup")
    return _f9_sql(src, n, seed, f"{name}9") + [
        (f"{name}d", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY original_index ORDER BY {uu}, rep) AS draw FROM {name}9) WHERE draw <= {k}"),
        (name, "SELECT *, " + PR.direct_instruction_sql(G, PKEY, disambig=True) + " AS instructions FROM "
               f"(SELECT * REPLACE ({', '.join(f'coalesce(target_{g}, source_{g}) AS target_{g}' for g in G)}) FROM {name}d)")]


def _f15_sql():
    c = TRAINING
    probe = sql_weighted() + [("rep_w", "SELECT * EXCLUDE (row_id, sampling_weights), row_id AS original_index, sampling_weights * count(*) OVER () AS sampling_weights_mean, "
                               f"CAST(unnest(generate_series(1, {X.REPS})) AS INTEGER) AS rep FROM wgs")] + X._delta_ctes("rep_w", G, PKEY, prefix="w")
    k = c.insts_per_probe_source_text
    own = "delta_{g}, target_{g}"
    cross = ("b.delta_{g} AS delta_{g}, least(greatest(coalesce(a.source_{g} + b.delta_{g}, a.source_{g}), 0.0::DOUBLE), 1.0::DOUBLE) AS target_{g}")
    cols = lambda t: ", ".join(t.format(g=g) for g in G)
    prompt = "{i}.instructions || chr(10) || chr(10) || {i}.text"
    return probe + _split_sql(src="wrobe") + [("tr", "SELECT * FROM sp WHERE in_first"), ("te", "SELECT * FROM sp WHERE NOT in_first")] \
        + _drawn_sql("tr", c.n_source_texts, c.instructions_per_text, c.train_seed, "trk") \
        + _drawn_sql("te", c.num_test_prompts_for_eval // k, k, c.test_seed, "tek") + [
        ("trc", f"SELECT * REPLACE (least(greatest(sampling_weights_mean, {c.clip_min!r}::DOUBLE), {c.clip_max!r}::DOUBLE) AS sampling_weights_mean) FROM trk"),
        ("tre", f"SELECT * FROM trc WHERE draw <= {k} AND original_index IN (SELECT DISTINCT original_index FROM trc ORDER BY original_index LIMIT {c.num_train_prompts_for_eval // k})"),
        ("a", "SELECT *, row_number() OVER (ORDER BY original_index, draw) AS pos FROM tre"),
        ("b", "SELECT *, row_number() OVER (ORDER BY original_index, draw) AS pos FROM tek"),
        ("ev", f"SELECT 'train' AS split, {PKEY_SQL}, sampling_weights_mean AS w, {prompt.format(i='a')} AS prompt, {cols(own)} FROM a UNION ALL "
               f"SELECT 'test', {PKEY_SQL}, sampling_weights_mean, {prompt.format(i='b')}, {cols(own)} FROM b UNION ALL "
               f"SELECT 'train_source_test_inst', a.original_index, a.rep, a.sampling_weights_mean, {prompt.format(i='b')}, {cols(cross)} FROM a JOIN b USING (pos) UNION ALL "
               f"SELECT 'test_source_train_inst', a.original_index, a.rep, a.sampling_weights_mean, {prompt.format(i='b')}, {cols(cross)} FROM b AS a JOIN a AS b USING (pos)")]


@query("f15_prepare_probe", W(_f15_sql(), f"SELECT split, {PKEY_SQL}, round(w, 6) AS w, md5(prompt) AS prompt_md5, "
                              + ", ".join(f"round(delta_{g}, 6) AS delta_{g}, round(target_{g}, 6) AS target_{g}" for g in G) + " FROM ev"))
def f15_prepare_probe(spark, sf):
    """Halves, sampled texts and draws, chat prompts, clipped weights, the four labelled evaluation splits
    with both cross-probes, written as one phase and read back."""
    gs = N.mean_weights(weighted_goalspace(spark, sf)).withColumnRenamed("row_id", "original_index")
    p = P.with_deltas(P.repeat_rows(gs, X.REPS), G, PKEY, X.SEED, X.MAX_ACTIVE)
    folder = f"{checkpoint_dir(spark)}/training-{uuid.uuid4().hex}"
    ev = TR.prepare(p, G, TRAINING, "stand-in", folder, "run")["eval"]
    return rounded(ev.select("split", *PKEY, F.col("sampling_weights_mean").alias("w"), F.md5(F.col("prompt")[0]["content"]).alias("prompt_md5"),
                             *[c for g in G for c in (f"delta_{g}", f"target_{g}")]))


@query("f16_meta_exclusion", W(X.sql_probe() + _split_sql(42, name="s1") + _split_sql(7, name="s2") + _split_sql(99, name="s3"),
                               f"SELECT {PKEY_SQL} FROM s3 WHERE NOT in_first AND original_index NOT IN "
                               "(SELECT original_index FROM s1 WHERE in_first UNION SELECT original_index FROM s2 WHERE in_first)"))
def f16_meta_exclusion(spark, sf):
    """F16: final-stage test half minus every id train-eligible under two earlier configs."""
    p = X.probe(spark, sf)
    s1 = SP.split_fraction(p, PKEY, seed=42).filter("in_first")
    s2 = SP.split_fraction(p, PKEY, seed=7).filter("in_first")
    test = SP.split_fraction(p, PKEY, seed=99).filter("NOT in_first")
    return SP.exclude_ids(test, [s1, s2]).select(*PKEY)


@query("f17_meta_sample", W(X.sql_probe() + _f9_sql("probe", 8, 430, "ms") + _f10_sql("ms", 4, 430, "mk"),
                            f"SELECT {PKEY_SQL}, md5({PR.direct_instruction_sql(G, PKEY, disambig=True)}) AS inst_md5 FROM mk"))
def f17_meta_sample(spark, sf):
    """the "8x4" meta-test probe (8 texts, up to 4 draws each) with instructions."""
    m = SP.meta_sample(X.probe(spark, sf), "8x4", PKEY)
    return m.select(*PKEY, F.md5(PR.direct_instruction(G, PKEY, disambig=True)).alias("inst_md5"))
