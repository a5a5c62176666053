"""Queries J1-J7 (rewards), G1-G10 (prompts) and R1-R2 (responses)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegauge.functions import text as tx
from tonegauge.keys import u, u_sql
from tonegauge.functions import scorers as S
from tonegauge.operators import goalspace as GS
from tonegauge.operators import normalise as N
from tonegauge.operators import prompts as PR
from tonegauge.operators import rewards as RW
from tonegauge.plans import fixtures as X
from tonegauge.plans.q_text import RANGES
from tonegauge.plans.registry import query, rounded
from tonegauge.store import written_once

G = X.GOALS
KEY = ["original_index", "rep", "generation"]
KEY_SQL = "original_index, rep, generation"
PKEY = ["original_index", "rep"]
W = X.with_ctes
MODEL = "deepseek-ai/DeepSeek-R1-Distill-Llama-8B"


def completions(spark, sf):
    """Stand-in completions: the response, behind a short reasoning block for ~30 % of rows."""
    r = X.result(spark, sf)
    think = u("col:original_index", "col:rep", "col:generation", 42, "think") < F.lit(0.3)
    return r.withColumn("completion", F.when(think, F.concat(F.lit("<think>plan the edit</think>\n"), F.col("llm_response")))
                        .otherwise(F.col("llm_response")))


def sql_completions():
    t = f"{u_sql('col:original_index', 'col:rep', 'col:generation', 42, 'think')} < 0.3"
    return X.sql_result() + [("comp", f"SELECT *, CASE WHEN {t} THEN '<think>plan the edit</think>' || chr(10) || llm_response ELSE llm_response END AS completion FROM result")]


def _t(g):
    return f"coalesce(target_{g}, source_{g})"


def _steer_sql(goals, good=None, bad=None, decile=False, rescale=False, square=False, n_all=None):
    terms = []
    for g in goals:
        e = f"abs({_t(g)} - output_{g})"
        if good is not None:
            e = f"greatest({e}, {good!r}::DOUBLE)"
        if bad is not None:
            e = f"least({e}, {bad!r}::DOUBLE)"
        if decile:
            e = f"least(greatest(ceil({e} * 10) / 10.0, 0.0), 1.0)"
        terms.append(f"({e}) * ({e})")
    tot = "(" + " + ".join(terms) + ")"
    n = float(n_all or len(goals))
    if rescale:
        return f"1.0 - {tot} / {n!r}" if square else f"1.0 - sqrt({tot} / {n!r})"
    return f"-{tot}" if square else f"-sqrt({tot})"


def _vec_sql(goals):
    a = {g: f"({_t(g)} - output_{g})" for g in goals}
    b = {g: f"({_t(g)} - source_{g})" for g in goals}
    mv = {g: f"(output_{g} - source_{g})" for g in goals}
    return a, b, mv


def _dot_sql(a, b, goals):
    return "(" + " + ".join(f"{a[g]} * {b[g]}" for g in goals) + ")"


def _neg_ortho_sql(goals):
    a, b, _ = _vec_sql(goals)
    coef = f"({_dot_sql(a, b, goals)} / ({_dot_sql(b, b, goals)} + 1e-8))"
    return "-sqrt(" + " + ".join(f"({a[g]} - {coef} * {b[g]}) * ({a[g]} - {coef} * {b[g]})" for g in goals) + ")"


def _neg_miscal_sql(goals):
    a, b, _ = _vec_sql(goals)
    return f"-abs({_dot_sql(a, b, goals)} / (sqrt({_dot_sql(b, b, goals)}) + 1e-8))"


@query("j1_steering_reward", W(X.sql_result(), f"SELECT {KEY_SQL}, round({_steer_sql(G)}, 6) AS reward, "
                              f"round({_steer_sql(G, good=0.05, decile=True, rescale=True, square=True)}, 6) AS reward_rescaled, "
                              f"round({_steer_sql(['reading_difficulty', 'formality'], bad=0.5, rescale=True, n_all=4)}, 6) AS reward_two_goals FROM result"))
def j1_steering_reward(spark, sf):
    """Default steering reward, a decile/rescaled/squared variant with a good-enough floor,
    and a two-goal variant normalised by all four mapped goals (as the original does)."""
    r = X.result(spark, sf)
    return rounded(r.select(*KEY, RW.steering_reward(G).alias("reward"),
                            RW.steering_reward(G, good_enough=0.05, decile=True, rescale_norm=True, square=True).alias("reward_rescaled"),
                            RW.steering_reward(["reading_difficulty", "formality"], all_goals=G, too_bad=0.5, rescale_norm=True).alias("reward_two_goals")))


@query("j2_j3_raw_geometry_rewards", W(X.sql_result(), f"SELECT {KEY_SQL}, round({_neg_ortho_sql(G)}, 6) AS neg_orthogonality, "
                                       f"round({_neg_miscal_sql(G)}, 6) AS neg_miscalibration FROM result"))
def j2_j3_raw_geometry_rewards(spark, sf):
    """Negative orthogonality and miscalibration on raw (unbinned) vectors."""
    r = X.result(spark, sf)
    return rounded(r.select(*KEY, RW.neg_orthogonality(G).alias("neg_orthogonality"), RW.neg_miscalibration(G).alias("neg_miscalibration")))


@query("j4_goal_abs_error", W(X.sql_result(), f"SELECT {KEY_SQL}, " + ", ".join(f"round(-abs({_t(g)} - output_{g}), 6) AS neg_err_{g}" for g in G) + " FROM result"))
def j4_goal_abs_error(spark, sf):
    """Per-goal negative absolute error."""
    r = X.result(spark, sf)
    return rounded(r.select(*KEY, *[RW.neg_abs_error(g).alias(f"neg_err_{g}") for g in G]))


@query("j5_j6_format_language", W(sql_completions(), f"SELECT {KEY_SQL}, CASE WHEN regexp_matches(completion, '{RW.THINK_FORMAT}') THEN 1.0 ELSE 0.0 END AS think_format, "
                                   "CASE WHEN regexp_matches(completion, '[\\x{4E00}-\\x{9FFF}]') THEN 0.0 ELSE 1.0 END AS english_only FROM comp"))
def j5_j6_format_language(spark, sf):
    """Reasoning-format reward and the CJK language penalty on chat completions."""
    c = completions(spark, sf)
    c = c.withColumn("completion", tx.wrap_chat(F.col("completion"), "assistant"))
    said = tx.unwrap_chat(c, "completion")
    return c.select(*KEY, RW.format_reward(said).alias("think_format"), RW.english_only_reward(said).alias("english_only"))


PLAN = RW.reward_plan(["steering_error", "orthogonality", "not_a_reward"], ["miscalibration", "think_format"], MODEL, G)


def _j7_sql():
    exprs = {"steering_error": _steer_sql(G), "orthogonality": _neg_ortho_sql(G), "miscalibration": _neg_miscal_sql(G),
             "think_format": f"CASE WHEN regexp_matches(completion, '{RW.THINK_FORMAT}') THEN 1.0 ELSE 0.0 END",
             "english_only": "CASE WHEN regexp_matches(completion, '[\\x{4E00}-\\x{9FFF}]') THEN 0.0 ELSE 1.0 END"}
    cols = [f"({exprs[n]}) AS r{i}_{n}" for i, (n, _) in enumerate(PLAN)]
    total = " + ".join(f"r{i}_{n} * {w!r}" for i, (n, w) in enumerate(PLAN) if w)
    return W(sql_completions() + [("rw", f"SELECT {KEY_SQL}, {', '.join(cols)} FROM comp")],
             f"SELECT {KEY_SQL}, " + ", ".join(f"round(r{i}_{n}, 6) AS r{i}_{n}" for i, (n, _) in enumerate(PLAN)) + f", round({total}, 6) AS reward FROM rw")


@query("j7_weighted_rewards", _j7_sql())
def j7_weighted_rewards(spark, sf):
    """Registry lookup (unknown names skipped), weights 1 / 0, english_only for deepseek models."""
    c = completions(spark, sf)
    out = RW.with_rewards(c, PLAN, G)
    return rounded(out.select(*KEY, *[f"r{i}_{n}" for i, (n, _) in enumerate(PLAN)], "reward"))


# ---------------------------------------------------------------- prompts
@query("g1_direct_prompt", W(X.sql_probe(), f"SELECT original_index, rep, {PR.direct_instruction_sql(G, PKEY)} AS instruction, "
                             f"{PR.direct_instruction_sql(G, PKEY, no_explain=False, disambig=True)} AS instruction_disambig FROM probe"))
def g1_direct_prompt(spark, sf):
    """The direct instruction with the default suffix and with the negative-prompt suffix."""
    p = X.probe(spark, sf)
    return p.select(*PKEY, PR.direct_instruction(G, PKEY).alias("instruction"),
                    PR.direct_instruction(G, PKEY, no_explain=False, disambig=True).alias("instruction_disambig"))


@query("g2_underspecified_prompt", W(X.sql_probe(), f"SELECT original_index, rep, {PR.underspecified_instruction_sql(PKEY)} AS instruction FROM probe"))
def g2_underspecified_prompt(spark, sf):
    """One of ten vague requests per row."""
    return X.probe(spark, sf).select(*PKEY, PR.underspecified_instruction(PKEY).alias("instruction"))


@query("g3_g4_cot_and_null_prompt", W(X.sql_probe(), f"SELECT original_index, rep, {PR.direct_instruction_sql(G, PKEY)} || {tx.sql_str(PR.COT_SUFFIX)} AS cot, "
                                      f"{tx.sql_str(PR.NULL_BASE + PR.NO_EXPLAIN)} AS null_prompt FROM probe"))
def g3_g4_cot_and_null_prompt(spark, sf):
    """Chain-of-thought prompt and the null prompt."""
    p = X.probe(spark, sf)
    return p.select(*PKEY, PR.cot_instruction(G, PKEY).alias("cot"), PR.null_instruction().alias("null_prompt"))


def cot_responses(spark, sf):
    """Stand-in chain-of-thought extractor outputs, two per delta key (ord 1, 2): a numbered
    list built from the row's own direct instruction and key."""
    p = X.probe(spark, sf)
    p = X.P.repeat_rows(p, 2, "k")
    inst = PR.direct_instruction(G, PKEY, no_explain=False)
    listing = F.concat(F.lit("Edits:\n1. "), inst, F.lit("\n2 . keep the topic of document "), F.col("original_index").cast("string"),
                       F.lit("\n3. pass "), F.col("k").cast("string"), F.lit("\nno number here"))
    return p.select(*[f"delta_{g}" for g in G], listing.alias("inst_lists_extracted"),
                    (F.col("original_index") * 100 + F.col("rep") * 10 + F.col("k")).cast("bigint").alias("ord"))


def _cot_sql():
    inst = PR.direct_instruction_sql(G, PKEY, no_explain=False)
    listing = (f"'Edits:' || chr(10) || '1. ' || {inst} || chr(10) || '2 . keep the topic of document ' || CAST(original_index AS VARCHAR) "
               f"|| chr(10) || '3. pass ' || CAST(k AS VARCHAR) || chr(10) || 'no number here'")
    return [("pk", "SELECT *, CAST(unnest(generate_series(1, 2)) AS INTEGER) AS k FROM probe"),
            ("cot", f"SELECT {', '.join(f'delta_{g}' for g in G)}, {listing} AS inst_lists_extracted, "
                    "CAST(original_index * 100 + rep * 10 + k AS BIGINT) AS ord FROM pk"),
            ("db", f"SELECT {', '.join(f'delta_{g}' for g in G)}, arg_max({tx.numbered_items_sql('inst_lists_extracted')}, ord) AS edit_instruction "
                   f"FROM cot GROUP BY ALL")]


@query("g10_instruction_db", W(X.sql_probe() + _cot_sql(), "SELECT " + ", ".join(f"round(delta_{g}, 6) AS delta_{g}" for g in G)
                               + ", array_to_string(edit_instruction, ' | ') AS edit_instruction FROM db"))
def g10_instruction_db(spark, sf):
    """Instruction database from extractor outputs (C9 items keyed by deltas, last wins)."""
    db = PR.build_instruction_db(cot_responses(spark, sf), G)
    return rounded(db.select(*[f"delta_{g}" for g in G], F.array_join("edit_instruction", " | ").alias("edit_instruction")))


def _inst_sql(base_sql):
    keys = ", ".join(f"p.delta_{g} IS NOT DISTINCT FROM db.delta_{g}" for g in G).replace(", ", " AND ")
    pick = (f"list_transform(list_sort(list_transform(db.edit_instruction, lambda s: struct_pack(o := "
            f"{u_sql('col:p.original_index', 'col:p.rep', 42, 'inst', 'col:s')}, s := s)))[1:3], lambda x: x.s)")
    bullet = tx.sql_str(PR.INSTRUCTION_BULLET)
    return (f"SELECT p.original_index, p.rep, {base_sql} || {tx.sql_str(PR.INSTRUCTION_LEAD)} || {bullet} || array_to_string({pick}, {bullet}) "
            f"|| chr(10) || chr(10) AS instructions FROM probe p JOIN db ON {keys}")


@query("g5_instruction_only_prompt", W(X.sql_probe() + _cot_sql(), _inst_sql(tx.sql_str(PR.NULL_BASE))))
def g5_instruction_only_prompt(spark, sf):
    """Null prompt + up to 3 sampled instructions for the row's delta key."""
    db = PR.build_instruction_db(cot_responses(spark, sf), G)
    out = PR.with_sampled_instructions(X.probe(spark, sf), db, G, PKEY, PR.null_instruction(no_explain=False))
    return out.select(*PKEY, "instructions")


@query("g6_direct_grounded_prompt", W(X.sql_probe() + _cot_sql(), _inst_sql(PR.direct_instruction_sql(G, PKEY, no_explain=False).replace("delta_", "p.delta_"))))
def g6_direct_grounded_prompt(spark, sf):
    """Direct prompt + up to 3 sampled instructions for the row's delta key."""
    db = PR.build_instruction_db(cot_responses(spark, sf), G)
    out = PR.with_sampled_instructions(X.probe(spark, sf), db, G, PKEY, PR.direct_instruction(G, PKEY, no_explain=False))
    return out.select(*PKEY, "instructions")


_G8 = [f"SELECT '{name}' AS strategy, original_index, rep, md5(instructions) AS inst_md5 FROM ({sql})" for name, sql in (
    ("direct+inst", _inst_sql(PR.direct_instruction_sql(G, PKEY, no_explain=False).replace("delta_", "p.delta_"))), ("instruct", _inst_sql(tx.sql_str(PR.NULL_BASE))),
    ("underspecified", f"SELECT original_index, rep, {PR.underspecified_instruction_sql(PKEY, disambig=True)} AS instructions FROM probe"))]


@query("g8_strategies", W(X.sql_probe() + _cot_sql(), " UNION ALL ".join(_G8)))
def g8_strategies(spark, sf):
    """One entry for all strategies, here the two that draw from the instruction database and a vague one."""
    db = PR.build_instruction_db(cot_responses(spark, sf), G)
    parts = [PR.with_instructions(X.probe(spark, sf), name, G, PKEY, disambig=True, database=db).select(F.lit(name).alias("strategy"), *PKEY, F.md5("instructions").alias("inst_md5"))
             for name in ("direct+inst", "instruct", "underspecified")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("g9_prompt_columns", W(X.sql_probe(), f"SELECT original_index, rep, " + ", ".join(f"round(coalesce(target_{g}, source_{g}), 6) AS target_{g}" for g in G)
                              + f", md5({PR.direct_instruction_sql(G, PKEY, disambig=True)} || chr(10) || chr(10) || text) AS prompt_md5, "
                              f"'{MODEL}' AS model_name, 'user' AS role FROM probe"))
def g9_prompt_columns(spark, sf):
    """G9 (+ G8 dispatch, C11 chat wrap): filled targets, instructions, chat prompt, model name."""
    out = PR.prompt_columns(X.probe(spark, sf), G, PKEY, MODEL, "direct", chat=True)
    return rounded(out.select(*PKEY, *[f"target_{g}" for g in G], F.md5(F.col("prompt")[0]["content"]).alias("prompt_md5"),
                              "model_name", F.col("prompt")[0]["role"].alias("role")))


# ---------------------------------------------------------------- responses
LLMS = [MODEL, "meta-llama/Llama-3.1-8B-Instruct"]


def raw_responses(spark, sf):
    """Stand-in raw model outputs from ``conversations`` assistant turns: some wrapped in a
    reasoning block, some with a "here is the rewritten" preamble, some failed (null)."""
    c = X.read(spark, sf, "conversations").filter(F.col("role") == "assistant")
    u1 = u("col:conv_id", "col:turn", 42, "raw")
    raw = (F.when(u1 < 0.25, F.concat(F.lit("<think>draft\nmore</think>\n\n"), F.col("text")))
           .when(u1 < 0.5, F.concat(F.lit("Sure, here is the rewritten text:\n"), F.col("text")))
           .when(u1 < 0.55, F.lit(None).cast("string"))
           .otherwise(F.col("text")))
    llm = F.when(u("col:conv_id", "col:turn", 42, "llm") < 0.5, F.lit(LLMS[0])).otherwise(F.lit(LLMS[1]))
    return c.select("conv_id", "turn", raw.alias("raw_response"), llm.alias("llm"))


def _raw_sql():
    u1 = u_sql("col:conv_id", "col:turn", 42, "raw")
    ul = u_sql("col:conv_id", "col:turn", 42, "llm")
    return [("raw", f"SELECT conv_id, turn, CASE WHEN {u1} < 0.25 THEN '<think>draft' || chr(10) || 'more</think>' || chr(10) || chr(10) || text "
                    f"WHEN {u1} < 0.5 THEN 'Sure, here is the rewritten text:' || chr(10) || text WHEN {u1} < 0.55 THEN NULL ELSE text END AS raw_response, "
                    f"CASE WHEN {ul} < 0.5 THEN '{LLMS[0]}' ELSE '{LLMS[1]}' END AS llm FROM conversations WHERE role = 'assistant'")]


@query("r1_clean_responses", W(_raw_sql(), "SELECT conv_id, turn, md5("
                               + tx.clean_preamble_sql(tx.clean_model_output_sql(f"coalesce(raw_response, '{tx.ERROR_RESPONSE}')", "llm"))
                               + ") AS response_md5, " + tx.clean_preamble_sql(tx.clean_model_output_sql(f"coalesce(raw_response, '{tx.ERROR_RESPONSE}')", "llm"))
                               + " = coalesce(raw_response, '') AS unchanged FROM raw"))
def r1_clean_responses(spark, sf):
    """Error string for failed calls, reasoning strip by model, preamble strip."""
    out = PR.clean_responses(raw_responses(spark, sf))
    return out.select("conv_id", "turn", F.md5("llm_response").alias("response_md5"),
                      (F.col("llm_response") == F.coalesce(F.col("raw_response"), F.lit(""))).alias("unchanged"))


@query("r1_clean_cot", W(_raw_sql(), "SELECT conv_id, turn, md5("
                         + tx.cot_extract_sql(tx.clean_model_output_sql(f"coalesce(raw_response, '{tx.ERROR_RESPONSE}')", "llm")) + ") AS response_md5 FROM raw"))
def r1_clean_cot(spark, sf):
    """R1 for chain-of-thought prompts: error string, reasoning strip, then the rewritten section."""
    return PR.clean_responses(raw_responses(spark, sf), strategy="cot").select("conv_id", "turn", F.md5("llm_response").alias("response_md5"))


@query("r2_assemble_result", W(X.sql_result(), f"SELECT {KEY_SQL}, md5(instruction || chr(10) || chr(10) || text) AS prompt_md5, "
                               + ", ".join(f"round(output_{g}, 6) AS output_{g}" for g in G)
                               + ", 'DirectTemplateInstruction' AS instruction_generator, 'stand-in' AS llm, 'chat' AS chat_type, 'local' AS endpoint "
                               f"FROM (SELECT *, {PR.direct_instruction_sql(G, PKEY)} AS instruction FROM result)"))
def r2_assemble_result(spark, sf):
    """R2: probe, prompts, responses and scores joined on the row key (not by position), plus the
    experiment signature columns."""
    res = X.result(spark, sf)
    first = res.filter(F.col("generation") == 1)
    probe = first.select(*PKEY, "text")
    prompts = first.select(*PKEY, PR.direct_instruction(G, PKEY).alias("instruction"))
    responses = res.select(*KEY, "llm_response")
    raw = res.select(*KEY, *[F.col(f"output_{g}").alias(f"output_raw_{g}") for g in G])
    norm = res.select(*KEY, *[f"output_{g}" for g in G])
    out = PR.assemble_result(probe, prompts, responses, raw, norm, PKEY,
                             {"instruction_generator": "DirectTemplateInstruction", "llm": "stand-in", "chat_type": "chat", "endpoint": "local"})
    out = out.withColumn("prompt_md5", F.md5(tx.assemble_prompt(F.col("instruction"), F.col("text"))))
    return rounded(out.select(*KEY, "prompt_md5", *[f"output_{g}" for g in G], "instruction_generator", "llm", "chat_type", "endpoint"))


SCORED = ["text_length", "reading_difficulty"]


def _scored_sql():
    raw = ", ".join(f"{S.REGISTRY.sql(g)('llm_response')} AS output_raw_{g}" for g in SCORED)
    norm = ", ".join(f"round({N.clip01_sql(f'(output_raw_{g} - {lo!r}::DOUBLE) / ({hi - lo!r}::DOUBLE)')}, 6) AS output_{g}" for g, (lo, hi) in
                     ((g, RANGES[g]) for g in SCORED))
    return (f"SELECT original_index, rep, generation, md5(instruction) AS instruction_md5, " + ", ".join(f"round(output_raw_{g}, 6) AS output_raw_{g}" for g in SCORED)
            + f", {norm}, 'stand-in' AS llm FROM (SELECT *, {PR.direct_instruction_sql(G, PKEY)} AS instruction, {raw} FROM result)")


@query("r2_generations", W(X.sql_result(generations=4), _scored_sql()))
def r2_generations(spark, sf):
    """R2 with four generations: raw scores of every response (D5) beside their normalised values."""
    res = X.result(spark, sf, generations=4)
    first = res.filter(F.col("generation") == 1)
    responses = res.select(*KEY, "llm_response")
    ranges = {g: RANGES[g] for g in SCORED}
    # written once: raw and normalised scores are two tables of one scoring
    scores = GS.score_endpoint(responses, SCORED, ranges, "llm_response")
    scores = written_once(scores.select(*KEY, *[f"{p}{g}" for p in ("output_raw_", "output_") for g in SCORED]), "scores")
    raw, norm = (scores.select(*KEY, *[f"{p}{g}" for g in SCORED]) for p in ("output_raw_", "output_"))
    out = PR.assemble_result(first.select(*PKEY), first.select(*PKEY, PR.direct_instruction(G, PKEY).alias("instruction")), responses, raw, norm, PKEY, {"llm": "stand-in"})
    return rounded(out.select(*KEY, F.md5("instruction").alias("instruction_md5"), *[f"output_raw_{g}" for g in SCORED], *[f"output_{g}" for g in SCORED], "llm"))
