"""Text scalar functions (C1-C21) as Spark Columns, each with a DuckDB SQL twin.

Regex dialect notes.  Java's ``\\w``, ``\\s`` and ``\\W`` are ASCII and Python's are Unicode, and
Java's ``.`` stops at several line terminators, so every pattern here spells its classes out
with Unicode properties (``\\p{L}``, ``\\p{N}``, ``\\p{Z}``) and explicit control characters.  The
same pattern text then means the same thing in Java and in RE2 (DuckDB).
"""

from __future__ import annotations

from string import Template

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns shared by Spark and the DuckDB oracle.
WS = r"[\t\n\x0B\f\r\p{Z}]"
WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{Z}\p{C}]"
ALPHA = r"\p{L}+"
SENT_PIECE = r"[^.!?]+[.!?]*"
HAS_WORD = r"[\p{L}\p{N}]"
NONWORD = r"[^\p{L}\p{N}_]"

# Fixed values from the rewrite cleaner.
THINK_MODELS = [
    "deepseek-ai/DeepSeek-R1-Distill-Llama-70B",
    "deepseek-ai/DeepSeek-R1-Distill-Llama-8B",
    "Qwen/Qwen3-4B",
    "Qwen/Qwen3-32B",
    "Qwen/Qwen3-30B-A3B",
]
SECTION_BREAK = "\n---\n\n"
ERROR_RESPONSE = "<error>"
NAN_TEXT = "<nan>"
MAX_JUDGE_TOKENS = 4096  # the usual explicit limit for a judge with a short window


def _lit(p: str) -> Column:
    return F.lit(p)


def sql_str(s: str) -> str:
    """A DuckDB string literal; newlines become chr(10) because DuckDB keeps backslashes literal."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


# --------------------------------------------------------------------------------------------
# whitespace strip (Python str.strip equivalent for the characters we treat as space)

def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


# --------------------------------------------------------------------------------------------
# C4 token count and words

def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(text, _lit(pattern), 0)


def token_count(text: Column) -> Column:
    """Words and single punctuation marks (NLTK-like, native)."""
    return F.size(tokens(text, TOKEN)).cast("bigint")


def token_count_sql(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, '{TOKEN}')) AS BIGINT)"


def word_count(text: Column) -> Column:
    return F.size(tokens(text, WORD)).cast("bigint")


def word_count_sql(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, '{WORD}')) AS BIGINT)"


# --------------------------------------------------------------------------------------------
# C1 / C2 sentences and chunks

def sentences(text: Column) -> Column:
    """Sentence list: runs ending in . ! ? (or the text end), stripped, with a word character."""
    pieces = F.transform(F.regexp_extract_all(text, _lit(SENT_PIECE), 0), strip)
    return F.filter(pieces, lambda p: p.rlike(HAS_WORD))


def sentences_sql(e: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({e}, '{SENT_PIECE}'), lambda p: {strip_sql('p')}), "
            f"lambda p: regexp_matches(p, '{HAS_WORD}'))")


def chunk_sentences(text: Column, n: int) -> Column:
    """Array of paragraphs of ``n`` sentences joined by a space (last one may be short)."""
    def chunks(s):
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(s, i + 1, n), " "))

    # the outer lambda's variable holds the sentences: as an expression they would be split again for every chunk
    return F.transform(F.array(sentences(text)), chunks)[0]


# --------------------------------------------------------------------------------------------
# C3 newline rule

NEWLINE_COMPAT = r"[^.!?\t\n\x0B\f\r\p{Z}]\r?\n+"
NEWLINE_KEEP = r"([^.!?\t\n\x0B\f\r\p{Z}])\r?\n+"


def newlines_as_sentences(text: Column, compat: bool = False) -> Column:
    """A newline after a non-terminal character ends a sentence.

    ``compat=True`` also consumes that character (``hello\\nworld`` -> ``hell. world``), as the
    original regex does; the default keeps it (``hello. world``).
    """
    if compat:
        return F.regexp_replace(text, NEWLINE_COMPAT, ". ")
    return F.regexp_replace(text, NEWLINE_KEEP, "$1. ")


def newlines_as_sentences_sql(e: str, compat: bool = False) -> str:
    if compat:
        return f"regexp_replace({e}, '{NEWLINE_COMPAT}', '. ', 'g')"
    return f"regexp_replace({e}, '{NEWLINE_KEEP}', '\\1. ', 'g')"


# --------------------------------------------------------------------------------------------
# C5 reasoning block strip

def strip_think(s: Column, tag: str = "think") -> Column:
    """Drop everything up to ``</tag>``, one more character, then any newlines.

    Unchanged when the tag is absent; an empty string when nothing follows (the original
    raised IndexError there).
    """
    end = f"</{tag}>"
    pos = F.instr(s, end)
    rest = F.substr(s, pos + F.lit(len(end) + 1))
    return F.when(pos > 0, F.regexp_replace(rest, r"^\n+", "")).otherwise(s)


def strip_think_sql(e: str, tag: str = "think") -> str:
    end = f"</{tag}>"
    return (f"CASE WHEN instr({e}, '{end}') > 0 THEN regexp_replace(substr({e}, instr({e}, '{end}') + {len(end) + 1}), "
            f"'^' || chr(10) || '+', '') ELSE {e} END")


def clean_model_output(s: Column, llm: Column, models: list[str] = THINK_MODELS) -> Column:
    """C5 switch: strip reasoning only for models that emit it."""
    return F.when(llm.isin(models), strip_think(s)).otherwise(s)


def clean_model_output_sql(e: str, llm: str, models: list[str] = THINK_MODELS) -> str:
    names = ", ".join(sql_str(m) for m in models)
    return f"CASE WHEN {llm} IN ({names}) THEN {strip_think_sql(e)} ELSE {e} END"


# --------------------------------------------------------------------------------------------
# C6 preamble strip

def clean_preamble(resp: Column) -> Column:
    """Drop a first line saying "here ... rewritten", then a leading ``\\n---\\n\\n``."""
    nl = F.instr(resp, "\n")
    first = F.lower(F.substring_index(resp, "\n", 1))
    after = F.substr(resp, nl + F.lit(1))
    dropped = F.when((nl > 0) & first.contains("here") & first.contains("rewritten"), after).otherwise(resp)
    out = F.when(F.startswith(dropped, F.lit(SECTION_BREAK)), F.substr(dropped, F.lit(len(SECTION_BREAK) + 1))).otherwise(dropped)
    return F.when(nl > 0, out).otherwise(resp)


def clean_preamble_sql(e: str) -> str:
    nl = f"instr({e}, chr(10))"
    first = f"lower(split_part({e}, chr(10), 1))"
    dropped = (f"(CASE WHEN {nl} > 0 AND contains({first}, 'here') AND contains({first}, 'rewritten') "
               f"THEN substr({e}, {nl} + 1) ELSE {e} END)")
    brk = sql_str(SECTION_BREAK)
    out = f"(CASE WHEN starts_with({dropped}, {brk}) THEN substr({dropped}, {len(SECTION_BREAK) + 1}) ELSE {dropped} END)"
    return f"(CASE WHEN {nl} > 0 THEN {out} ELSE {e} END)"


# --------------------------------------------------------------------------------------------
# C7 chain-of-thought section

COT_HEADER = r"(?i)^" + NONWORD + r"*rewritten text" + NONWORD + r"*$"


def cot_extract(resp: Column) -> Column:
    """C6, then the lines after the first "rewritten text" header, stripped.

    Returns the (C6-cleaned) response itself when no header line exists or nothing follows it.
    """
    cleaned = clean_preamble(resp)
    lines = F.split(cleaned, "\n")
    hit = F.array_position(F.transform(lines, lambda ln: strip(ln).rlike(COT_HEADER)), True)
    tail = F.slice(lines, (hit + 1).cast("int"), F.greatest(F.size(lines) - hit.cast("int"), F.lit(1)))
    body = strip(F.array_join(tail, "\n"))
    return F.when((hit > 0) & (hit < F.size(lines)), body).otherwise(cleaned)


def cot_extract_sql(e: str) -> str:
    c = clean_preamble_sql(e)
    lines = f"string_split({c}, chr(10))"
    hit = f"coalesce(list_position(list_transform({lines}, lambda ln: regexp_matches({strip_sql('ln')}, '{COT_HEADER}')), true), 0)"
    body = strip_sql(f"array_to_string({lines}[{hit} + 1:], chr(10))")
    return f"(CASE WHEN {hit} > 0 AND {hit} < len({lines}) THEN {body} ELSE {c} END)"


# --------------------------------------------------------------------------------------------
# C8 / C9 instruction extraction

EDITS_BLOCK = r"(?s)## Edits(.*?)## Rewritten text"
NUMBERED = r"\d+\s*\.\s*(.+)"


def edits_block(text: Column) -> Column:
    """Text between ``## Edits`` and ``## Rewritten text``, stripped; null without both."""
    return F.when(text.rlike(EDITS_BLOCK), strip(F.regexp_extract(text, EDITS_BLOCK, 1)))


def edits_block_sql(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, '{EDITS_BLOCK}') THEN {strip_sql(f'regexp_extract({e}, {sql_str(EDITS_BLOCK)}, 1)')} END"


def numbered_items(text: Column) -> Column:
    """Every ``<n>. item`` on a line (``.`` never crosses a newline)."""
    return F.regexp_extract_all(text, _lit("(?d)" + NUMBERED), 1)


def numbered_items_sql(e: str) -> str:
    return f"regexp_extract_all({e}, '{NUMBERED}', 1)"


# --------------------------------------------------------------------------------------------
# C10 / C11 / C12 / C13 chat format and prompt assembly

def unwrap_chat(df: DataFrame, column: str) -> Column:
    """Content of the first message when the column holds chat messages, else the string."""
    dt = df.schema[column].dataType
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
        names = {f.name for f in dt.elementType.fields}
        if {"role", "content"} <= names:
            return F.col(column)[0]["content"]
    return F.col(column)


def wrap_chat(prompt: Column, role: str = "user") -> Column:
    """C11: ``[{role, content}]``."""
    return F.array(F.struct(F.lit(role).alias("role"), prompt.alias("content")))


def assemble_prompt(instruction: Column, text: Column, sep: str = "\n\n") -> Column:
    """Instruction, blank line, text."""
    return F.concat(instruction, F.lit(sep), text)


def fill_template(template: str, **values: Column) -> Column:
    """``$name`` substitution.  The template is split once on the driver; rows only concat."""
    parts: list[Column] = []
    pattern = Template.pattern
    pos = 0
    for m in pattern.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        if m.group("escaped") is not None:
            parts.append(F.lit("$"))
        else:
            name = m.group("named") or m.group("braced")
            if name is None:
                raise ValueError("invalid placeholder in template")
            parts.append(values[name])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def fill_template_sql(template: str, **values: str) -> str:
    parts = []
    pos = 0
    for m in Template.pattern.finditer(template):
        if m.start() > pos:
            parts.append(sql_str(template[pos:m.start()]))
        if m.group("escaped") is not None:
            parts.append("'$'")
        else:
            parts.append(values[m.group("named") or m.group("braced")])
        pos = m.end()
    if pos < len(template):
        parts.append(sql_str(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def truncate_tokens(s: Column, max_tokens: int | None = None) -> Column:
    """C14: missing text -> ``<nan>``; with an explicit ``max_tokens`` a text of at least that many
    whitespace tokens is cut to its first ``max_tokens`` tokens joined by single spaces.  Other
    texts, and all texts without a limit, stay whole."""
    if max_tokens is None:
        return F.coalesce(s, F.lit(NAN_TEXT))
    toks = F.split(strip(s), WS + "+")
    cut = F.array_join(F.slice(toks, 1, max_tokens), " ")
    return F.when(s.isNull(), F.lit(NAN_TEXT)).when(F.size(toks) >= max_tokens, cut).otherwise(s)


def truncate_tokens_sql(e: str, max_tokens: int | None = None) -> str:
    if max_tokens is None:
        return f"coalesce({e}, '{NAN_TEXT}')"
    toks = f"regexp_split_to_array({strip_sql(e)}, '{WS}+')"
    return (f"CASE WHEN {e} IS NULL THEN '{NAN_TEXT}' WHEN len({toks}) >= {max_tokens} "
            f"THEN array_to_string({toks}[1:{max_tokens}], ' ') ELSE {e} END")


# --------------------------------------------------------------------------------------------
# C15 - C18 verdicts

ANSWER_FALLBACK = r'"answer"\s*:\s*([\p{L}\p{N}_]+)'
RATIONALE_FALLBACK = r'"rationale"\s*:\s*"([^"]+)"'
TRAILING_COMMA = r",[\t\n\r ]*[}\]]"


def parse_verdict(s: Column) -> Column:
    """``struct(answer, rationale)`` from strict JSON, else the two fallback regexes.

    The answer regex wants an unquoted word, so a quoted answer inside invalid JSON (a trailing
    comma, say) gives a null answer, as in the original.
    """
    schema = "answer STRING, rationale STRING, _corrupt STRING"
    j = F.from_json(s, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
                                "allowSingleQuotes": "false"})
    valid = j["_corrupt"].isNull() & s.isNotNull()
    ans = F.when(valid, j["answer"]).otherwise(F.nullif(F.regexp_extract(s, ANSWER_FALLBACK, 1), F.lit("")))
    rat = F.when(valid, j["rationale"]).otherwise(F.nullif(F.regexp_extract(s, RATIONALE_FALLBACK, 1), F.lit("")))
    return F.struct(ans.alias("answer"), rat.alias("rationale"))


def parse_verdict_sql(e: str) -> tuple[str, str]:
    valid = f"(json_valid({e}) AND NOT regexp_matches({e}, '{TRAILING_COMMA}'))"
    ans = (f"CASE WHEN {valid} THEN json_extract_string({e}, '$.answer') "
           f"ELSE nullif(regexp_extract({e}, {sql_str(ANSWER_FALLBACK)}, 1), '') END")
    rat = (f"CASE WHEN {valid} THEN json_extract_string({e}, '$.rationale') "
           f"ELSE nullif(regexp_extract({e}, {sql_str(RATIONALE_FALLBACK)}, 1), '') END")
    return ans, rat


BLOCK = r'"(higher_[^"]+)":\s*\{([^}]+)\}'
KV_VALUE = r'"[^"]*"\s*:\s*"([^"]*)"'
CHOICES = ["A", "B", "Tie"]


def parse_pairwise_verdict(s: Column) -> Column:
    """``map<attribute, struct(answer, rationale)>`` from JSON, else per-block regexes.

    In the fallback, inside each ``"higher_*": {...}`` block the last quoted value in
    {A, B, Tie} is the answer and the last other quoted value the rationale.
    """
    mtype = "MAP<STRING, STRUCT<answer: STRING, rationale: STRING>>"
    parsed = F.from_json(s, mtype, {"allowSingleQuotes": "false"})
    names = F.regexp_extract_all(s, _lit(BLOCK), 1)
    blocks = F.regexp_extract_all(s, _lit(BLOCK), 2)

    def inner(b):
        vals = F.regexp_extract_all(b, _lit(KV_VALUE), 1)
        ans = F.try_element_at(F.filter(vals, lambda v: v.isin(CHOICES)), F.lit(-1))
        rat = F.try_element_at(F.filter(vals, lambda v: ~v.isin(CHOICES)), F.lit(-1))
        return F.struct(ans.alias("answer"), rat.alias("rationale"))

    entries = F.arrays_zip(names.alias("name"), blocks.alias("block"))
    # of repeated blocks the last one counts
    last = F.filter(entries, lambda e, i: F.array_position(F.slice(names, i + 2, F.size(names)), e["name"]) == 0)
    fallback = F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"], inner(e["block"]))))
    return F.when(parsed.isNotNull(), parsed).otherwise(fallback)


def flatten_verdicts(m: Column, attributes: list[str]) -> list[Column]:
    """C17: ``<k>_choice`` and ``<k>_rationale`` per known attribute key."""
    out = []
    for k in attributes:
        out.append(m[k]["answer"].alias(f"{k}_choice"))
        out.append(m[k]["rationale"].alias(f"{k}_rationale"))
    return out


def label_to_ordinal(c: Column) -> Column:
    """A -> 1, Tie -> 0, B -> -1, anything else -> null."""
    return F.when(c == "A", 1).when(c == "Tie", 0).when(c == "B", -1).cast("int")


def label_to_ordinal_sql(e: str) -> str:
    return f"CAST(CASE WHEN {e} = 'A' THEN 1 WHEN {e} = 'Tie' THEN 0 WHEN {e} = 'B' THEN -1 END AS INTEGER)"


# --------------------------------------------------------------------------------------------
# B15 preview

def wrap_truncate(text: Column, width: int = 100, limit: int | None = None) -> Column:
    """Newline every ``width`` characters; with an explicit ``limit`` cut at that many
    characters and ``...`` if the text is longer."""
    wrapped = F.regexp_replace(text, f"(?s)(.{{{width}}})(?=.)", "$1\n")
    if limit is None:
        return wrapped
    return F.concat(F.substring(wrapped, 1, limit), F.when(F.length(text) > limit, F.lit("...")).otherwise(F.lit("")))
