"""Prompt construction (G1-G10) and response assembly.

Instructions are built per row from Columns only: phrase choice, modifiers and the English
list are literals selected by ``when``; the per-row "shuffle" of requests is a sort by a
deterministic uniform.  Every variant of a phrase is prepared once on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions import text as tx
from tonegauge.keys import u, u_sql

# Instruction phrases and suffixes of the direct prompting strategy.
NO_EXPLAIN = " Respond with only the rewritten text and do not explain your response."
DISAMBIG = (" You MUST not change anything else about the other parts of the text, even if it makes "
            "the rewritten text sound unnatural or otherwise awkward.")
#: goal -> (direction, strength) -> finished request
PHRASES = {
    "reading_difficulty": {
        ("more", "much"): "much harder to read", ("more", "slightly"): "slightly harder to read", ("more", ""): "harder to read",
        ("less", "much"): "much easier to read", ("less", "slightly"): "slightly easier to read", ("less", ""): "easier to read"},
    "textual_diversity": {
        ("more", "much"): "use much more diverse language", ("more", "slightly"): "use slightly more diverse language",
        ("more", ""): "use more diverse language", ("less", "much"): "use much less diverse language",
        ("less", "slightly"): "use slightly less diverse language", ("less", ""): "use less diverse language"},
    "text_length": {
        ("more", "much"): "much longer", ("more", "slightly"): "slightly longer", ("more", ""): "longer",
        ("less", "much"): "much shorter", ("less", "slightly"): "slightly shorter", ("less", ""): "shorter"},
    "formality": {
        ("more", "much"): "much more formal", ("more", "slightly"): "slightly more formal", ("more", ""): "more formal",
        ("less", "much"): "much more informal", ("less", "slightly"): "slightly more informal", ("less", ""): "more informal"},
}
BASE = "Please rewrite the following, but make it "
NOTHING = "as close to the original as possible."
NULL_BASE = "Please rewrite the following."
UNDERSPECIFIED = [
    "Please rewrite the following, but make it better.",
    "Please rewrite the following, but improve it.",
    "Please rewrite the following, but with some improvements.",
    "Please rewrite the following, but make it higher-quality.",
    "Please rewrite the following, but with more polish.",
    "Please rewrite the following, but refine it.",
    "Please rewrite the following, but make it less bad.",
    "Please rewrite the following, but make it actually good.",
    "Please rewrite the following, but make it worthwhile.",
    "Please rewrite the following, but make it not suck.",
]
COT_SUFFIX = (" Before outputting the rewritten text, propose and discuss a few concrete edits you might apply "
              "to this specific text using the following format and replacing the placeholders in []:\n\n"
              "## Edits\n\n[your proposed edits]\n\n## Rewritten text\n\n[your rewritten text]")
INSTRUCTION_LEAD = " Some ways that you can do so might include:"
INSTRUCTION_BULLET = "\n\t- "


def _phrase(g: str, d: Column) -> Column:
    """Request of one active goal, looked up by the sign of its delta and its strength."""
    if g not in PHRASES:
        raise ValueError(f"Goal {g} not supported. Valid goals: {list(PHRASES)}")
    key = F.concat_ws(":", F.when(d > 0, "more").otherwise("less"),
                      F.when(F.abs(d) > 0.5, "much").when(F.abs(d) < 0.2, "slightly").otherwise(""))
    table = F.create_map(*[F.lit(x) for (way, how), p in PHRASES[g].items() for x in (f"{way}:{how}", p)])
    return F.element_at(table, key)


def _phrase_sql(g: str, d: str) -> str:
    key = (f"if({d} > 0, 'more', 'less') || ':' || "
           f"CASE WHEN abs({d}) > 0.5 THEN 'much' WHEN abs({d}) < 0.2 THEN 'slightly' ELSE '' END")
    rows = " ".join(f"WHEN '{way}:{how}' THEN {tx.sql_str(p)}" for (way, how), p in PHRASES[g].items())
    return f"CASE {key} {rows} END"


def _suffix(no_explain: bool, disambig: bool) -> str:
    return (DISAMBIG if disambig else "") + (NO_EXPLAIN if no_explain else "")


def direct_instruction(goals: list[str], key_cols: list[str], seed: int = 42, no_explain: bool = True,
                       disambig: bool = False) -> Column:
    """G1 (+ G7 suffix switches): phrase per active goal (non-null, non-zero delta), requests in a
    deterministic shuffled order, English list "a, b, and c." / "a." / fallback."""
    keys = [f"col:{k}" for k in key_cols]
    items = []
    for g in goals:
        d = F.col(f"delta_{g}")
        active = d.isNotNull() & (d != 0)
        items.append(F.when(active, F.struct(u(*keys, seed, "order", g).alias("o"), _phrase(g, d).alias("p"))))
    arr = F.transform(F.array_sort(F.array_compact(F.array(*items))), lambda s: s["p"])
    n = F.size(arr)
    many = F.concat(F.array_join(F.slice(arr, 1, n - 1), ", "), F.lit(", and "), F.element_at(arr, -1), F.lit("."))
    body = F.when(n > 1, many).when(n == 1, F.concat(F.element_at(arr, 1), F.lit("."))).otherwise(F.lit(NOTHING))
    return F.concat(F.lit(BASE), body, F.lit(_suffix(no_explain, disambig)))


def direct_instruction_sql(goals: list[str], key_cols: list[str], seed: int = 42, no_explain: bool = True,
                           disambig: bool = False) -> str:
    keys = [f"col:{k}" for k in key_cols]
    items = []
    for g in goals:
        d = f"delta_{g}"
        items.append(f"CASE WHEN {d} IS NOT NULL AND {d} <> 0 THEN struct_pack(o := {u_sql(*keys, seed, 'order', g)}, "
                     f"p := {_phrase_sql(g, d)}) END")
    arr = f"list_transform(list_sort(list_filter([{', '.join(items)}], lambda s: s IS NOT NULL)), lambda s: s.p)"
    n = f"len({arr})"
    body = (f"CASE WHEN {n} > 1 THEN array_to_string({arr}[1:{n} - 1], ', ') || ', and ' || {arr}[{n}] || '.' "
            f"WHEN {n} = 1 THEN {arr}[1] || '.' ELSE {tx.sql_str(NOTHING)} END")
    return f"({tx.sql_str(BASE)} || {body} || {tx.sql_str(_suffix(no_explain, disambig)) if _suffix(no_explain, disambig) else "''"})"


def underspecified_instruction(key_cols: list[str], seed: int = 42, no_explain: bool = True, disambig: bool = False) -> Column:
    """One of ten vague requests, chosen by ``u``."""
    idx = F.floor(u(*[f"col:{k}" for k in key_cols], seed, "under") * 10).cast("int") + 1
    return F.concat(F.element_at(F.array(*[F.lit(s) for s in UNDERSPECIFIED]), idx), F.lit(_suffix(no_explain, disambig)))


def underspecified_instruction_sql(key_cols: list[str], seed: int = 42, no_explain: bool = True, disambig: bool = False) -> str:
    idx = f"CAST(floor({u_sql(*[f'col:{k}' for k in key_cols], seed, 'under')} * 10) AS INTEGER) + 1"
    lst = "[" + ", ".join(tx.sql_str(s) for s in UNDERSPECIFIED) + "]"
    suf = _suffix(no_explain, disambig)
    return f"({lst}[{idx}] || {tx.sql_str(suf) if suf else "''"})"


def cot_instruction(goals, key_cols, seed=42, no_explain=True, disambig=False) -> Column:
    """The direct prompt followed by the edits / rewritten-text section template."""
    return F.concat(direct_instruction(goals, key_cols, seed, no_explain, disambig), F.lit(COT_SUFFIX))


def null_instruction(no_explain: bool = True, disambig: bool = False) -> Column:
    """A bare rewrite request."""
    return F.lit(NULL_BASE + _suffix(no_explain, disambig))


def with_sampled_instructions(df: DataFrame, database: DataFrame, goals: list[str], key_cols: list[str],
                              prompt: Column, k: int = 3, seed: int = 42, missing: str = "raise") -> DataFrame:
    """Append up to ``k`` instructions drawn without replacement from the database entry
    whose delta vector equals the row's (null-safe on every goal).

    The database has one row per delta key (G10 guarantees it), so the join multiplies nothing.
    No row is dropped: one without an entry fails the job (``missing="raise"``) or gets null
    instructions (``missing="null"``; list such rows with :func:`missing_instruction_keys`).
    Draw order is ``u(row key, instruction)``.
    """
    if missing not in ("raise", "null"):
        raise ValueError(f"missing must be 'raise' or 'null', not {missing!r}")
    keys = [f"col:{c}" for c in key_cols]
    db = database.select(*[F.col(f"delta_{g}").alias(f"_db_{g}") for g in goals], "edit_instruction", F.lit(True).alias("_entry"))
    cond = None
    for g in goals:
        c = df[f"delta_{g}"].eqNullSafe(db[f"_db_{g}"])
        cond = c if cond is None else cond & c
    j = df.withColumn("_prompt", prompt).join(db, cond, "left")
    ranked = F.transform(F.col("edit_instruction"), lambda s: F.struct(u(*keys, seed, "inst", s).alias("o"), s.alias("s")))
    picked = F.transform(F.slice(F.array_sort(ranked), 1, k), lambda x: x["s"])
    text = F.concat(F.col("_prompt"), F.lit(INSTRUCTION_LEAD), F.lit(INSTRUCTION_BULLET),
                    F.array_join(picked, INSTRUCTION_BULLET), F.lit("\n\n"))
    absent = F.raise_error("no instruction database entry for a row's deltas") if missing == "raise" else F.lit(None)
    text = F.when(F.col("_entry"), text).otherwise(absent.cast("string"))
    return j.withColumn("instructions", text).drop("_prompt", "_entry", "edit_instruction", *[f"_db_{g}" for g in goals])


def missing_instruction_keys(df: DataFrame, database: DataFrame, goals: list[str]) -> DataFrame:
    cond = None
    for g in goals:
        c = df[f"delta_{g}"].eqNullSafe(database[f"delta_{g}"])
        cond = c if cond is None else cond & c
    return df.join(database, cond, "left_anti")


def build_instruction_db(responses: DataFrame, goals: list[str], extracted: str = "inst_lists_extracted",
                         order: str = "ord") -> DataFrame:
    """Numbered items (C9) of each extractor output keyed by the delta vector; duplicate keys
    keep the last row by ``order`` (``groupBy`` treats null delta values as equal keys)."""
    items = responses.withColumn("edit_instruction", tx.numbered_items(F.col(extracted)))
    return items.groupBy(*[f"delta_{g}" for g in goals]).agg(F.max_by("edit_instruction", order).alias("edit_instruction"))


STRATEGIES: dict[str, Callable] = {}


def instruction_for(strategy: str, goals: list[str], key_cols: list[str], seed: int = 42, no_explain: bool = True,
                    disambig: bool = False) -> Column:
    """Strategy dispatch for the Column-only strategies; unknown names raise."""
    if strategy == "direct":
        return direct_instruction(goals, key_cols, seed, no_explain, disambig)
    if strategy == "underspecified":
        return underspecified_instruction(key_cols, seed, no_explain, disambig)
    if strategy == "cot":
        return cot_instruction(goals, key_cols, seed, no_explain, disambig)
    if strategy == "null":
        return null_instruction(no_explain, disambig)
    if strategy in ("direct+inst", "instruct"):
        raise ValueError(f"{strategy} needs an instruction database: use with_instructions")
    raise ValueError(f"{strategy} is not an implemented instruction generator.")


#: strategies that draw from an instruction database, and the prompt that the draws are appended to
DATABASE_STRATEGIES = {"direct+inst": lambda goals, key_cols, seed: direct_instruction(goals, key_cols, seed, no_explain=False),
                       "instruct": lambda goals, key_cols, seed: null_instruction(no_explain=False)}


def with_instructions(df: DataFrame, strategy: str, goals: list[str], key_cols: list[str], seed: int = 42, no_explain: bool = True, disambig: bool = False,
                      database: DataFrame | None = None, k: int = 3, missing: str = "raise") -> DataFrame:
    """``df`` with ``instructions`` by any strategy, those with a database included; unknown names raise.

    ``direct+inst`` appends up to ``k`` draws to the direct prompt (G6), ``instruct`` to the bare request (G5);
    both need ``database`` and follow ``missing`` for rows whose deltas it lacks."""
    if strategy not in DATABASE_STRATEGIES:
        return df.withColumn("instructions", instruction_for(strategy, goals, key_cols, seed, no_explain, disambig))
    if database is None:
        raise ValueError(f"{strategy} needs an instruction database")
    return with_sampled_instructions(df, database, goals, key_cols, DATABASE_STRATEGIES[strategy](goals, key_cols, seed), k, seed, missing)


def prompt_columns(df: DataFrame, goals: list[str], key_cols: list[str], model_name: str, strategy: str = "direct",
                   seed: int = 42, disambig: bool = True, chat: bool = False, text_col: str = "text", database: DataFrame | None = None) -> DataFrame:
    """B7 target fill, ``instructions``, ``prompt`` = instructions + blank line + text (C12),
    optionally chat-wrapped (C11), and ``model_name``."""
    from tonegauge.operators.metrics import fill_targets
    out = with_instructions(fill_targets(df, goals), strategy, goals, key_cols, seed, True, disambig, database)
    prompt = tx.assemble_prompt(F.col("instructions"), F.col(text_col))
    out = out.withColumn("prompt", tx.wrap_chat(prompt) if chat else prompt)
    return out.withColumn("model_name", F.lit(model_name))


# --------------------------------------------------------------------------------------------
# R1 / R2

def clean_responses(df: DataFrame, raw: str = "raw_response", llm: str = "llm", strategy: str = "direct") -> DataFrame:
    """Failed calls -> a fixed error string; reasoning strip (C5) by model; then the strategy
    cleaner (C7 for chain-of-thought, C6 otherwise)."""
    r = F.coalesce(F.col(raw), F.lit(tx.ERROR_RESPONSE))
    stage1 = tx.clean_model_output(r, F.col(llm))
    stage2 = tx.cot_extract(stage1) if strategy == "cot" else tx.clean_preamble(stage1)
    return df.withColumn("llm_response", stage2)


def assemble_result(probe: DataFrame, prompts: DataFrame, responses: DataFrame, raw_scores: DataFrame,
                    norm_scores: DataFrame, key: list[str], signature: dict[str, str]) -> DataFrame:
    """R2: probe, prompts, responses and raw / normalised scores joined on the row key (and the
    generation for per-response tables), plus the experiment signature columns (B13)."""
    gen_key = key + ["generation"]
    out = probe.join(prompts, key).join(responses, key).join(raw_scores, gen_key).join(norm_scores, gen_key)
    # responses carry one row per (key, generation); probe and prompts one per key
    return out.withColumns({k: F.lit(v) for k, v in signature.items()})
