"""Queries C1-C21 (text functions), D1-D10 (goal scoring) and E1-E7 (normalisation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegauge.functions import scorers as S
from tonegauge.functions import text as tx
from tonegauge.keys import text_key, text_key_b64, u, u_sql
from tonegauge.operators import normalise as N
from tonegauge.operators import goalspace as GS
from tonegauge.operators import tagging as TG
from tonegauge.plans import fixtures as X
from tonegauge.plans.registry import query, rounded

G = X.GOALS
W = X.with_ctes
CHUNK = 5


def docs(spark, sf):
    return X.read(spark, sf, "documents")


@query("c1_chunk_paragraphs", f"SELECT doc_id, CAST(start // {CHUNK} AS BIGINT) AS chunk_index, md5(array_to_string(s[start + 1:start + {CHUNK}], ' ')) AS chunk_md5 "
       f"FROM (SELECT doc_id, s, unnest(range(0, len(s), {CHUNK})) AS start FROM (SELECT doc_id, {tx.sentences_sql('text')} AS s FROM documents))")
def c1_chunk_paragraphs(spark, sf):
    """Each document split into paragraphs of 5 sentences (posexplode keeps the order)."""
    d = docs(spark, sf)
    return d.select("doc_id", F.posexplode(tx.chunk_sentences(F.col("text"), CHUNK)).alias("chunk_index", "chunk")).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("chunk").alias("chunk_md5"))


@query("c2_sentence_explode", "SELECT doc_id, source, CAST(i - 1 AS BIGINT) AS sentence_index, md5(s[i]) AS sentence_md5 "
       f"FROM (SELECT doc_id, source, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, source, {tx.sentences_sql('text')} AS s FROM documents))")
def c2_sentence_explode(spark, sf):
    """One row per sentence, keeping the source label and the origin row."""
    d = docs(spark, sf)
    return d.select("doc_id", "source", F.posexplode(tx.sentences(F.col("text"))).alias("sentence_index", "sentence")).select(
        "doc_id", "source", F.col("sentence_index").cast("bigint").alias("sentence_index"), F.md5("sentence").alias("sentence_md5"))


@query("c3_newline_sentences", f"SELECT doc_id, md5({tx.newlines_as_sentences_sql('text', True)}) AS compat_md5, "
       f"md5({tx.newlines_as_sentences_sql('text')}) AS fixed_md5 FROM documents")
def c3_newline_sentences(spark, sf):
    """Newline-as-sentence rewrite, original (compat) and fixed forms."""
    d = docs(spark, sf)
    return d.select("doc_id", F.md5(tx.newlines_as_sentences(F.col("text"), compat=True)).alias("compat_md5"),
                    F.md5(tx.newlines_as_sentences(F.col("text"))).alias("fixed_md5"))


@query("c4_token_count", f"SELECT doc_id, {tx.token_count_sql('text')} AS n_tokens, {tx.word_count_sql('text')} AS n_words FROM documents")
def c4_token_count(spark, sf):
    """C4: token and word counts over whole texts."""
    d = docs(spark, sf)
    return d.select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"), tx.word_count(F.col("text")).alias("n_words"))


def conv_outputs(spark, sf):
    """Stand-in model outputs from ``conversations``: some turns behind a reasoning block, some
    behind a rewrite preamble, some in the chain-of-thought layout."""
    c = X.read(spark, sf, "conversations")
    uu = u("col:conv_id", "col:turn", 42, "fmt")
    out = (F.when(uu < 0.2, F.concat(F.lit("<think>\nweigh options\n</think>\n\n\n"), F.col("text")))
           .when(uu < 0.4, F.concat(F.lit("Okay, here's the rewritten version:\n"), F.col("text")))
           .when(uu < 0.6, F.concat(F.lit("## Edits\n\n1. tighten wording\n2 . fix tone\n\n## Rewritten text\n\n"), F.col("text"), F.lit("\n")))
           .when(uu < 0.65, F.concat(F.lit("\n---\n\n"), F.col("text")))
           .otherwise(F.col("text")))
    return c.select("conv_id", "turn", "role", out.alias("s"))


def conv_outputs_sql():
    uu = u_sql("col:conv_id", "col:turn", 42, "fmt")
    nl = "chr(10)"
    return [("co", f"SELECT conv_id, turn, role, CASE WHEN {uu} < 0.2 THEN '<think>' || {nl} || 'weigh options' || {nl} || '</think>' || {nl} || {nl} || {nl} || text "
                   f"WHEN {uu} < 0.4 THEN 'Okay, here''s the rewritten version:' || {nl} || text "
                   f"WHEN {uu} < 0.6 THEN '## Edits' || {nl} || {nl} || '1. tighten wording' || {nl} || '2 . fix tone' || {nl} || {nl} || '## Rewritten text' || {nl} || {nl} || text || {nl} "
                   f"WHEN {uu} < 0.65 THEN {nl} || '---' || {nl} || {nl} || text ELSE text END AS s FROM conversations")]


@query("c5_c6_c7_clean_outputs", W(conv_outputs_sql(), f"SELECT conv_id, turn, md5({tx.strip_think_sql('s')}) AS think_md5, "
                                   f"md5({tx.clean_preamble_sql('s')}) AS preamble_md5, md5({tx.cot_extract_sql('s')}) AS cot_md5 FROM co"))
def c5_c6_c7_clean_outputs(spark, sf):
    """C5 reasoning strip, C6 preamble strip, C7 chain-of-thought section extraction."""
    c = conv_outputs(spark, sf)
    s = F.col("s")
    return c.select("conv_id", "turn", F.md5(tx.strip_think(s)).alias("think_md5"), F.md5(tx.clean_preamble(s)).alias("preamble_md5"),
                    F.md5(tx.cot_extract(s)).alias("cot_md5"))


@query("c8_c9_edit_items", W(conv_outputs_sql(), f"SELECT conv_id, turn, {tx.edits_block_sql('s')} AS edits, "
                             f"array_to_string({tx.numbered_items_sql(tx.edits_block_sql('s'))}, ' | ') AS items FROM co"))
def c8_c9_edit_items(spark, sf):
    """C8 edits block and C9 numbered items within it."""
    c = conv_outputs(spark, sf)
    e = tx.edits_block(F.col("s"))
    return c.select("conv_id", "turn", e.alias("edits"), F.array_join(tx.numbered_items(e), " | ").alias("items"))


@query("c10_c11_c12_chat_prompt", "SELECT conv_id, turn, 'user' AS role, md5('Rewrite this.' || chr(10) || chr(10) || text) AS content_md5, "
       "substr('Rewrite this.' || chr(10) || chr(10) || text, 16) = text AS text_kept FROM conversations")
def c10_c11_c12_chat_prompt(spark, sf):
    """C12 prompt assembly, C11 chat wrapping and C10 unwrapping back to the content, of all turns."""
    c = X.read(spark, sf, "conversations")
    wrapped = c.select("conv_id", "turn", "text", tx.wrap_chat(tx.assemble_prompt(F.lit("Rewrite this."), F.col("text"))).alias("prompt"))
    content = tx.unwrap_chat(wrapped, "prompt")
    return wrapped.select("conv_id", "turn", F.col("prompt")[0]["role"].alias("role"), F.md5(content).alias("content_md5"),
                          (F.substr(content, F.lit(16)) == F.col("text")).alias("text_kept"))


TEMPLATE = "Turn $turn of $$conversation ${conv}:\n$text"


@query("c13_c14_template_truncate", f"SELECT conv_id, turn, md5({tx.fill_template_sql(TEMPLATE, turn='CAST(turn AS VARCHAR)', conv='CAST(conv_id AS VARCHAR)', text=tx.truncate_tokens_sql('text', 64))}) AS filled_md5, "
       f"CAST(len({tx.truncate_tokens_sql('text', 64)}) AS BIGINT) AS truncated_chars, md5({tx.truncate_tokens_sql('text')}) AS whole_md5, "
       f"md5({tx.fill_template_sql(TEMPLATE, turn='CAST(turn AS VARCHAR)', conv='CAST(conv_id AS VARCHAR)', text='text')}) AS filled_whole_md5 FROM conversations")
def c13_c14_template_truncate(spark, sf):
    """C13 ``$name`` template substitution and C14 token truncation (64-token limit here so the
    cut path is exercised on short turns), beside the default, which keeps texts whole, and the whole text filled in."""
    c = X.read(spark, sf, "conversations")
    t = tx.truncate_tokens(F.col("text"), 64)
    names = {"turn": F.col("turn").cast("string"), "conv": F.col("conv_id").cast("string")}
    filled, whole = tx.fill_template(TEMPLATE, **names, text=t), tx.fill_template(TEMPLATE, **names, text=F.col("text"))
    return c.select("conv_id", "turn", F.md5(filled).alias("filled_md5"), F.length(t).cast("bigint").alias("truncated_chars"),
                    F.md5(tx.truncate_tokens(F.col("text"))).alias("whole_md5"), F.md5(whole).alias("filled_whole_md5"))


def verdicts(spark, sf):
    """Stand-in judge outputs from ``labels``: strict JSON, JSON with a trailing comma (quoted and
    unquoted answers) and free text, chosen by ``u``."""
    lab = X.read(spark, sf, "labels")
    ans = F.when(F.col("quality") == 1, F.lit("Yes")).otherwise(F.lit("No"))
    rat = F.concat(F.lit("toxic="), F.col("toxic").cast("string"))
    uu = u("col:doc_id", 42, "verdict")
    s = (F.when(uu < 0.4, F.concat(F.lit('{"answer": "'), ans, F.lit('", "rationale": "'), rat, F.lit('"}')))
         .when(uu < 0.6, F.concat(F.lit('{"answer": "'), ans, F.lit('", "rationale": "'), rat, F.lit('",}')))
         .when(uu < 0.85, F.concat(F.lit('{\n  "answer": '), ans, F.lit(',\n  "rationale": "'), rat, F.lit('",\n}')))
         .otherwise(F.concat(F.lit("I think the answer is "), ans)))
    return lab.select("doc_id", s.alias("raw"))


def verdicts_sql():
    uu = u_sql("col:doc_id", 42, "verdict")
    ans = "CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END"
    rat = "'toxic=' || CAST(toxic AS VARCHAR)"
    return [("vd", f"SELECT doc_id, CASE WHEN {uu} < 0.4 THEN '{{\"answer\": \"' || {ans} || '\", \"rationale\": \"' || {rat} || '\"}}' "
                   f"WHEN {uu} < 0.6 THEN '{{\"answer\": \"' || {ans} || '\", \"rationale\": \"' || {rat} || '\",}}' "
                   f"WHEN {uu} < 0.85 THEN '{{' || chr(10) || '  \"answer\": ' || {ans} || ',' || chr(10) || '  \"rationale\": \"' || {rat} || '\",' || chr(10) || '}}' "
                   f"ELSE 'I think the answer is ' || {ans} END AS raw FROM labels")]


_A, _R = tx.parse_verdict_sql("raw")


@query("c15_parse_verdict", W(verdicts_sql(), f"SELECT doc_id, {_A} AS answer, {_R} AS rationale FROM vd"))
def c15_parse_verdict(spark, sf):
    """Verdict JSON with the regex fallback (quoted answers in invalid JSON stay null)."""
    v = verdicts(spark, sf)
    p = tx.parse_verdict(F.col("raw"))
    return v.select("doc_id", p["answer"].alias("answer"), p["rationale"].alias("rationale"))


ATTRS = ["higher_formality", "higher_length"]


def pairwise_verdicts(spark, sf):
    """Stand-in pairwise judge outputs (nested per attribute), valid JSON or broken JSON."""
    lab = X.read(spark, sf, "labels")
    a1 = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("Tie")), F.col("quality") + 1)
    a2 = F.element_at(F.array(F.lit("B"), F.lit("Tie"), F.lit("A")), F.col("toxic") + 1)
    body = F.concat(F.lit('{"higher_formality": {"answer": "'), a1, F.lit('", "rationale": "q'), F.col("quality").cast("string"),
                    F.lit('"}, "higher_length": {"rationale": "t'), F.col("toxic").cast("string"), F.lit('", "answer": "'), a2, F.lit('"}'))
    broken = u("col:doc_id", 42, "pair") < F.lit(0.5)
    return lab.select("doc_id", F.when(broken, F.concat(body, F.lit(",}"))).otherwise(F.concat(body, F.lit("}"))).alias("raw"))


@query("c16_c17_c18_pairwise_verdicts",
       "SELECT doc_id, ['A', 'B', 'Tie'][quality + 1] AS higher_formality_choice, 'q' || CAST(quality AS VARCHAR) AS higher_formality_rationale, "
       "['B', 'Tie', 'A'][toxic + 1] AS higher_length_choice, 't' || CAST(toxic AS VARCHAR) AS higher_length_rationale, "
       f"{tx.label_to_ordinal_sql(chr(39) + 'x' + chr(39))} AS unknown_ordinal, CAST(CASE quality WHEN 0 THEN 1 WHEN 1 THEN -1 END AS INTEGER) AS formality_ordinal FROM labels")
def c16_c17_c18_pairwise_verdicts(spark, sf):
    """C16 nested verdict parse (JSON, else block regexes), C17 flatten, C18 ordinal labels."""
    v = pairwise_verdicts(spark, sf)
    m = tx.parse_pairwise_verdict(F.col("raw"))
    flat = v.select("doc_id", *tx.flatten_verdicts(m, ATTRS))
    return flat.select("*", tx.label_to_ordinal(F.lit("x")).alias("unknown_ordinal"),
                       tx.label_to_ordinal(F.col("higher_formality_choice")).alias("formality_ordinal"))


@query("c19_cleaner_audit", W(conv_outputs_sql() + [
    ("st", f"SELECT s AS raw, {tx.clean_model_output_sql('s', chr(39) + tx.THINK_MODELS[0] + chr(39))} AS model FROM co"),
    ("st2", f"SELECT *, {tx.clean_preamble_sql('model')} AS inst FROM st")],
    "SELECT count_if(raw <> model) AS changed_by_model, count_if(model <> inst) AS changed_by_strategy, count_if(raw = inst) AS unchanged FROM st2"))
def c19_cleaner_audit(spark, sf):
    """Rows changed by the model cleaner, by the strategy cleaner, and untouched."""
    c = conv_outputs(spark, sf)
    m = tx.clean_model_output(F.col("s"), F.lit(tx.THINK_MODELS[0]))
    st = c.select(F.col("s").alias("raw"), m.alias("model")).withColumn("inst", tx.clean_preamble(F.col("model")))
    return st.agg(F.count_if(F.col("raw") != F.col("model")).alias("changed_by_model"),
                  F.count_if(F.col("model") != F.col("inst")).alias("changed_by_strategy"),
                  F.count_if(F.col("raw") == F.col("inst")).alias("unchanged"))


@query("c21_text_keys", "SELECT doc_id, sha256(text) AS text_key, md5(translate(to_base64(encode(text)), '+/', '-_')) AS b64_md5 FROM documents")
def c21_text_keys(spark, sf):
    """Content keys, sha-256 and the url-safe base64 form."""
    d = docs(spark, sf)
    return d.select("doc_id", text_key(F.col("text")).alias("text_key"), F.md5(text_key_b64(F.col("text"))).alias("b64_md5"))


# ---------------------------------------------------------------- D goals
def _goal_sql(goals):
    return ", ".join(f"round({S.REGISTRY.sql(g)('text')}, 6) AS {g}" for g in goals)


@query("d1_d2_d3_d4b_goal_scores", f"SELECT doc_id, {_goal_sql(G)} FROM documents")
def d1_d2_d3_d4b_goal_scores(spark, sf):
    """D1 text length, D2 reading difficulty, D3 textual diversity (MTLD), D4b formality."""
    d = X.spread(docs(spark, sf), "doc_id")
    return rounded(GS.map_goals(d, G).select("doc_id", *G))


@query("d4a_pos_percentages", "SELECT doc_id, " + ", ".join(
    f"round(CASE WHEN len(tags) > 0 THEN len(list_filter(tags, lambda x: x = '{t}')) / len(tags) * 100.0 ELSE 0.0 END, 6) AS pct_{t.lower()}"
    for t in S.POS_TAGS) + f" FROM (SELECT doc_id, list_transform({S.alpha_tokens_sql('text')}, lambda t: {S.pos_tag_sql('t')}) AS tags FROM documents)")
def d4a_pos_percentages(spark, sf):
    """Share of each native part-of-speech tag among alphabetic tokens."""
    d = X.spread(docs(spark, sf), "doc_id")
    return rounded(d.select("doc_id", *S.pos_percentages(F.col("text"))))


@query("d4a_lexicon", "SELECT doc_id, " + ", ".join(
    f"round(CASE WHEN len(tags) > 0 THEN len(list_filter(tags, lambda x: x = '{t}')) / len(tags) * 100.0 ELSE 0.0 END, 6) AS pct_{t.lower()}"
    for t in S.POS_TAGS) + f" FROM (SELECT doc_id, list_transform({S.alpha_tokens_sql('text')}, lambda t: {S.pos_tag_sql('t')}) AS tags FROM documents)")
def d4a_lexicon(spark, sf):
    """D4a by a lexicon table with suffix rules as fallback: the same shares as the inline tagger's."""
    return rounded(TG.lexicon_percentages(docs(spark, sf), ["doc_id"], TG.closed_classes(spark)))


def _cache(spark, sf):
    """A stand-in score cache: the ``benchmark`` passages scored once (many reappear in documents)."""
    b = X.read(spark, sf, "benchmark").select("text")
    return GS.map_goals(b, G).select(text_key(F.col("text")).alias("text_key"), *G)


@query("d5_d6_cached_goalspace", f"SELECT doc_id, {_goal_sql(G)} FROM documents")
def d5_d6_cached_goalspace(spark, sf):
    """D5 goalspace mapping with the D6 content cache: distinct texts only, cache hits reused,
    misses scored, new entries merged (new wins), joined back to every row by text key."""
    d = docs(spark, sf)
    out, _ = GS.map_with_cache(d, _cache(spark, sf), G)
    return rounded(out.select("doc_id", *G))


# The usual raw goal ranges (they belong to other scorers than ours, so they only scale).
RANGES = {"reading_difficulty": (2.8, 12.9), "formality": (40.37, 69.121634),
          "textual_diversity": (44.84394871794872, 128.54409583333333), "text_length": (78.0, 1509.0)}


@query("d10_e2_fixed_normalised", f"SELECT doc_id, " + ", ".join(
    f"round({N.clip01_sql(f'({S.REGISTRY.sql(g)("text")} - {lo!r}::DOUBLE) / ({hi - lo!r}::DOUBLE)')}, 6) AS output_{g}"
    for g, (lo, hi) in RANGES.items()) + " FROM documents")
def d10_e2_fixed_normalised(spark, sf):
    """D10 scoring endpoint (texts -> normalised goals) with E2 fixed ranges from an A6 table."""
    d = X.spread(docs(spark, sf), "doc_id")
    table = N.normalization_table(spark, RANGES)
    out = GS.score_endpoint(d, list(RANGES), N.ranges_from_table(table), text_col="text")
    return rounded(out.select("doc_id", *[f"output_{g}" for g in RANGES]))


@query("e1_percentile_normalise", W(X.sql_goalspace(), "SELECT row_id, " + ", ".join(f"round(source_{g}, 6) AS source_{g}" for g in G) + " FROM goalspace"))
def e1_percentile_normalise(spark, sf):
    """Middle 95 % of each goal scaled to [0, 1] (exact distributed percentiles)."""
    return rounded(X.goalspace(spark, sf).select("row_id", *[f"source_{g}" for g in G]))


def _raw_outputs_sql():
    return [("ro", "SELECT original_index, rep, generation, " + ", ".join(f"{g} * (1.0 + coalesce(delta_{g}, 0.0)) AS output_raw_{g}" for g in G)
             + " FROM result")]


@query("e3_renormalise", W(X.sql_result() + _raw_outputs_sql() + [
    ("mp", "SELECT " + ", ".join(
        f"arg_min({g}, source_{g}) FILTER (WHERE source_{g} > 0 AND source_{g} < 1) AS x1_{g}, min(source_{g}) FILTER (WHERE source_{g} > 0 AND source_{g} < 1) AS y1_{g}, "
        f"arg_max({g}, source_{g}) FILTER (WHERE source_{g} > 0 AND source_{g} < 1) AS x2_{g}, max(source_{g}) FILTER (WHERE source_{g} > 0 AND source_{g} < 1) AS y2_{g}"
        for g in G) + " FROM goalspace"),
    ("sl", "SELECT " + ", ".join(f"(y2_{g} - y1_{g}) / (x2_{g} - x1_{g}) AS slope_{g}, y1_{g} AS y1_{g}, x1_{g} AS x1_{g}" for g in G) + " FROM mp"),
    ("ic", "SELECT " + ", ".join(f"slope_{g}, y1_{g} - slope_{g} * x1_{g} AS intercept_{g}" for g in G) + " FROM sl")],
    "SELECT original_index, rep, generation, " + ", ".join(f"round({N.clip01_sql(f'output_raw_{g} * slope_{g} + intercept_{g}')}, 6) AS output_{g}" for g in G)
    + " FROM ro CROSS JOIN ic"))
def e3_renormalise(spark, sf):
    """Recover each goal's linear map from (raw, normalised) pairs inside (0, 1) and apply it
    to stand-in raw outputs (``raw * (1 + delta)``)."""
    gs = X.goalspace(spark, sf)
    maps = N.recover_ranges(gs, G)
    r = X.result(spark, sf)
    raw = r.select("original_index", "rep", "generation", *[(F.col(g) * (F.lit(1.0) + F.coalesce(F.col(f"delta_{g}"), F.lit(0.0)))).alias(f"output_raw_{g}") for g in G])
    return rounded(N.renormalize(raw, maps, G).select("original_index", "rep", "generation", *[f"output_{g}" for g in G]))


@query("e6_e7_weight_scaling", W(X.sql_goalspace() + [("wt", "SELECT row_id, source_text_length + 0.5 AS w FROM goalspace"),
                                                      ("ws", "SELECT row_id, w / sum(w) OVER () AS sampling_weights FROM wt")],
                                 "SELECT row_id, round(sampling_weights, 6) AS sampling_weights, "
                                 "round(least(greatest(sampling_weights * count(*) OVER (), 0.5), 2.0), 6) AS sampling_weights_mean FROM ws"))
def e6_e7_weight_scaling(spark, sf):
    """E6 mean-1 weights (w * N) and E7 clipping to [0.5, 2], from stand-in weights
    proportional to ``source_text_length + 0.5`` normalised to sum 1 (one aggregate, broadcast scalar)."""
    gs = X.goalspace(spark, sf).select("row_id", (F.col("source_text_length") + F.lit(0.5)).alias("w"))
    total = gs.agg(F.sum("w").alias("t"))
    w = gs.crossJoin(F.broadcast(total)).select("row_id", (F.col("w") / F.col("t")).alias("sampling_weights"))
    w = N.mean_weights(w)
    w, _ = N.clip_weights(w, 0.5, 2.0)
    return rounded(w)
