"""Goal scorers (D1-D4) as JVM-side Columns, plus the goal registry.

The original delegates to third-party NLP libraries (a readability package, an MTLD package,
a POS tagger) that are not part of this build.  These are native implementations of the
published formulas, so their values differ from those libraries; calibrate normalisation on
the data (E1) instead of reusing fixed ranges made for the other scorers.

* text_length: C4 token count.
* reading_difficulty: Flesch-Kincaid grade ``0.39 w/s + 11.8 syl/w - 15.59`` with words
  ``[\\p{L}\\p{N}]+``, sentences from :func:`tonegauge.functions.text.sentences` (at least 1)
  and syllables = vowel groups; 0 for a text without words.
* textual_diversity: MTLD (McCarthy & Jarvis 2010), mean of a forward and a backward pass over
  lower-cased alphabetic tokens with factor threshold 0.72 (a factor closes when the running
  type/token ratio falls to or below it; the remainder counts ``(1 - ttr) / (1 - 0.72)``);
  a pass without any factor counts its token total; 0 for a text without tokens.
* formality: Heylighen & Dewaele ``F = (noun + adj + adp + article - pron - verb - adv - intj + 100) / 2``
  over percentages of alphabetic tokens; tags come from a closed-class lexicon, then suffix
  rules, else noun.  50 for a text without tokens.

Every scorer is a single expression per row (no explode, no shuffle); counting, tagging and MTLD run as
Arrow-batched UDFs.  Each has a DuckDB SQL
twin used by the oracle.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tonegauge.functions import text as tx

MTLD_THRESHOLD = 0.72
VOWEL_GROUP = r"[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüý]+"

# Closed-class lexicon for the native part-of-speech approximation.
ARTICLES = ["a", "an", "the"]
PRONOUNS = [
    "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "we", "us", "our", "ours", "ourselves", "they", "them", "their", "theirs", "themselves",
    "who", "whom", "whose", "what", "whoever", "whatever", "someone", "somebody", "something",
    "anyone", "anybody", "anything", "everyone", "everybody", "everything", "nobody", "nothing",
]
ADPOSITIONS = [
    "of", "in", "on", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "out", "off", "over", "under", "across", "along", "among", "around", "behind", "beneath",
    "beside", "besides", "beyond", "despite", "except", "inside", "near", "onto", "outside",
    "past", "since", "toward", "towards", "upon", "via", "within", "without", "throughout",
]
INTERJECTIONS = ["oh", "ah", "wow", "hey", "hi", "hello", "oops", "ouch", "alas", "hmm", "uh", "um",
                 "yeah", "okay", "ok", "hooray", "yes"]
ADVERBS = ["not", "very", "too", "so", "also", "just", "only", "then", "now", "here", "there",
           "when", "where", "why", "how", "always", "never", "often", "sometimes", "soon", "still",
           "already", "almost", "even", "quite", "rather", "really", "again", "ever", "perhaps",
           "maybe", "yet", "once", "together", "away"]
VERBS = ["is", "am", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
         "do", "does", "did", "done", "will", "would", "shall", "should", "can", "could", "may",
         "might", "must", "get", "got", "make", "made", "say", "said", "go", "went", "know", "knew",
         "take", "took", "see", "saw", "come", "came", "think", "thought", "want", "give", "gave",
         "use", "find", "found", "tell", "told", "ask", "seem", "feel", "felt", "try", "leave",
         "left", "call", "keep", "let", "put", "mean", "become", "became", "show", "hear", "run"]
OTHER = ["and", "or", "but", "nor", "if", "because", "although", "though", "while", "as", "than",
         "whether", "this", "that", "these", "those", "some", "any", "each", "every", "all", "both",
         "either", "neither", "no", "such", "which", "one", "two", "three", "many", "much", "more",
         "most", "few", "other", "another", "own", "same"]
ADV_SUFFIXES = ["ly"]
VERB_SUFFIXES = ["ing", "ed", "ize", "ise", "ify"]
ADJ_SUFFIXES = ["ous", "ful", "ive", "able", "ible", "al", "ic", "less", "ish"]
SUFFIX_MIN_LEN = 5

POS_TAGS = ["NOUN", "ADJ", "ADP", "ARTICLE", "PRON", "VERB", "ADV", "INTJ"]
DEICTIC = {"NOUN": 1, "ADJ": 1, "ADP": 1, "ARTICLE": 1, "PRON": -1, "VERB": -1, "ADV": -1, "INTJ": -1, "OTHER": 0}


# --------------------------------------------------------------------------------------------
# counts of one pass over the characters

_LN, _MARK, _END, _VOWEL, _DOTTED = 1, 2, 4, 8, 16
_VOWELS = set(VOWEL_GROUP[1:-2])
#: characters of a slice that is counted at once
_SLICE = 1 << 22


@functools.cache
def _classes() -> np.ndarray:
    """Flags of every code point: letter or number, other token, sentence end, vowel when lower-cased."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        out[i] = _LN if kind in "LN" else 0 if kind in "ZC" else _MARK
        if kind == "L" and c.lower()[0] in _VOWELS:
            out[i] |= _VOWEL
    out[[ord(c) for c in ".!?"]] |= _END
    out[0x130] |= _DOTTED  # lower-cased it is a vowel and a mark, which ends the group
    return out


def _counts_of(texts: list[str]) -> np.ndarray:
    """(tokens, words, sentences, vowel groups) per text: the matches of ``tx.TOKEN``, ``tx.WORD``, ``SENTENCE_WITH_WORD``
    and, lower-cased, ``VOWEL_GROUP``."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    flags = _classes()[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "<u4")]
    flags[ends - 1] = _END  # the line feed behind each text keeps them apart
    before = np.concatenate([[np.uint8(_END)], flags[:-1]])
    words = (flags & ~before & _LN).astype(bool)
    vowels = ((flags & _VOWEL) != 0) & (((before & _VOWEL) == 0) | ((before & _DOTTED) != 0))
    at = np.flatnonzero(flags & (_LN | _END))
    seen = flags[at]
    sentences = np.zeros(len(flags), bool)
    sentences[at[((seen & _LN) != 0) & (np.concatenate([[_END], seen[:-1]]) & _END != 0)]] = True
    tokens = words | ((flags & _MARK) != 0)
    return np.stack([np.add.reduceat(x, ends - sizes, dtype=np.int64) for x in (tokens, words, sentences, vowels)], axis=1)


def text_counts(text: Column) -> Column:
    """Struct (tokens, words, sentences, syllables) of a text, null for null: an Arrow-batched UDF, one pass per text."""
    fields = ["tokens", "words", "sentences", "syllables"]

    @F.arrow_udf(", ".join(f"{f} bigint" for f in fields))
    def counts(texts: pa.Array) -> pa.Array:
        parts, held, chars = [np.zeros((0, len(fields)), np.int64)], [], 0
        for t in texts:
            held.append(t.as_py() or "")
            chars += len(held[-1])
            if chars >= _SLICE:
                parts.append(_counts_of(held))
                held, chars = [], 0
        if held:
            parts.append(_counts_of(held))
        found = np.concatenate(parts)
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(fields))], fields, mask=texts.is_null())

    return counts(text)


# --------------------------------------------------------------------------------------------
# D1 text length

def text_length(text: Column) -> Column:
    return text_counts(text)["tokens"].cast("double")


def text_length_sql(e: str) -> str:
    return f"CAST({tx.token_count_sql(e)} AS DOUBLE)"


# --------------------------------------------------------------------------------------------
# D2 reading difficulty

# One match per sentence piece holding a word character, the same count as ``size(sentences(text))`` (the match
# runs from the first word character to the piece's terminator, so each piece yields at most one).
SENTENCE_WITH_WORD = r"[\p{L}\p{N}][^.!?]*"


def reading_difficulty(text: Column) -> Column:
    x = text_counts(text)
    w = x["words"].cast("double")
    grade = F.lit(0.39) * (w / F.greatest(x["sentences"], F.lit(1))) + F.lit(11.8) * (x["syllables"] / w) - F.lit(15.59)
    return F.when(w > 0, grade).otherwise(F.lit(0.0))


def reading_difficulty_sql(e: str) -> str:
    w = f"CAST(len(regexp_extract_all({e}, '{tx.WORD}')) AS DOUBLE)"
    s = f"greatest(len(regexp_extract_all({e}, '{SENTENCE_WITH_WORD}')), 1)"
    y = f"len(regexp_extract_all(lower({e}), '{VOWEL_GROUP}'))"
    return f"(CASE WHEN {w} > 0 THEN 0.39::DOUBLE * ({w} / {s}) + 11.8::DOUBLE * ({y} / {w}) - 15.59::DOUBLE ELSE 0.0::DOUBLE END)"


# --------------------------------------------------------------------------------------------
# D3 textual diversity (MTLD)

def diversity_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(tx.ALPHA), 0)


def _mtld_factors(toks: Column, thr: float) -> Column:
    empty = F.array().cast("array<string>")
    init = F.struct(empty.alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("f"))

    def step(acc, x):
        grown = F.when(F.array_contains(acc["t"], x), acc["t"]).otherwise(F.array_append(acc["t"], x))
        n2 = acc["n"] + 1
        closes = (F.size(grown) / n2) <= F.lit(thr)
        return F.when(closes, F.struct(empty.alias("t"), F.lit(0).alias("n"), (acc["f"] + F.lit(1.0)).alias("f"))) \
            .otherwise(F.struct(grown.alias("t"), n2.alias("n"), acc["f"].alias("f")))

    def finish(acc):
        part = F.when(acc["n"] > 0, (F.lit(1.0) - F.size(acc["t"]) / acc["n"]) / F.lit(1.0 - thr)).otherwise(F.lit(0.0))
        return acc["f"] + part

    return F.aggregate(toks, init, step, finish)


def mtld_fold(toks: Column, thr: float = MTLD_THRESHOLD) -> Column:
    """MTLD as a JVM-only ``aggregate`` fold (no Python worker); same value as :func:`mtld`."""
    n = F.size(toks).cast("double")

    def one(factors):
        return F.when(factors > 0, n / factors).otherwise(n)

    fwd = one(_mtld_factors(toks, thr))
    bwd = one(_mtld_factors(F.reverse(toks), thr))
    return F.when(n > 0, (fwd + bwd) / F.lit(2.0)).otherwise(F.lit(0.0))


def _mtld_factors_py(tokens, thr: float) -> float:
    seen: set = set()
    n = 0
    f = 0.0
    for t in tokens:
        n += 1
        seen.add(t)
        if len(seen) / n <= thr:
            f += 1.0
            seen = set()
            n = 0
    if n > 0:
        f += (1.0 - len(seen) / n) / (1.0 - thr)
    return f


def mtld_value(tokens, thr: float = MTLD_THRESHOLD) -> float:
    """MTLD of one token sequence (used inside the Arrow UDF and by tests)."""
    n = float(len(tokens))
    if n == 0:
        return 0.0
    fwd = _mtld_factors_py(tokens, thr)
    bwd = _mtld_factors_py(tokens[::-1], thr)
    fwd = n / fwd if fwd > 0 else n
    bwd = n / bwd if bwd > 0 else n
    return (fwd + bwd) / 2.0


def _coded(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, their places in the flat tokens, where each row ends) of a batch of token arrays."""
    flat = tokens.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _mtld_udf(thr: float):
    @F.arrow_udf("double")
    def mtld_batch(tokens: pa.Array) -> pa.Array:
        _, codes, ends = _coded(tokens)
        rows = np.split(codes, ends[:-1])
        return pa.array([mtld_value(row.tolist(), thr) if valid else None for row, valid in zip(rows, tokens.is_valid().to_pylist())], pa.float64())

    return mtld_batch


def mtld(toks: Column, thr: float = MTLD_THRESHOLD) -> Column:
    """MTLD over a token array.  The scan over tokens is sequential within a text, so it runs as
    an Arrow-batched pandas UDF; tokenisation stays in the JVM and only the token arrays cross."""
    return _mtld_udf(thr)(toks)


def textual_diversity(text: Column) -> Column:
    return mtld(diversity_tokens(text))


def _mtld_factors_sql(toks: str, thr: float) -> str:
    grown = "(CASE WHEN list_contains(acc.t, x) THEN acc.t ELSE list_append(acc.t, x) END)"
    step = (f"lambda acc, x: CASE WHEN len({grown}) / (acc.n + 1) <= {thr!r}::DOUBLE "
            f"THEN struct_pack(t := []::VARCHAR[], n := 0, f := acc.f + 1.0::DOUBLE) "
            f"ELSE struct_pack(t := {grown}, n := acc.n + 1, f := acc.f) END")
    init = "struct_pack(t := []::VARCHAR[], n := 0, f := 0.0::DOUBLE)"
    r = f"list_reduce({toks}, {step}, {init})"
    return (f"(SELECT r.f + CASE WHEN r.n > 0 THEN (1.0::DOUBLE - len(r.t) / r.n) / {1.0 - thr!r}::DOUBLE "
            f"ELSE 0.0::DOUBLE END FROM (SELECT {r} AS r))")


def textual_diversity_sql(e: str, thr: float = MTLD_THRESHOLD) -> str:
    toks = f"regexp_extract_all(lower({e}), '{tx.ALPHA}')"
    n = f"CAST(len({toks}) AS DOUBLE)"

    def one(f):
        return f"(CASE WHEN {f} > 0 THEN {n} / {f} ELSE {n} END)"

    fwd = one(_mtld_factors_sql(toks, thr))
    bwd = one(_mtld_factors_sql(f"list_reverse({toks})", thr))
    return f"(CASE WHEN {n} > 0 THEN ({fwd} + {bwd}) / 2.0::DOUBLE ELSE 0.0::DOUBLE END)"


# --------------------------------------------------------------------------------------------
# D4 formality

def _long_suffix(t: Column, suffixes: list[str]) -> Column:
    cond = None
    for s in suffixes:
        c = t.endswith(s)
        cond = c if cond is None else (cond | c)
    return (F.length(t) >= SUFFIX_MIN_LEN) & cond


def pos_tag(t: Column) -> Column:
    """Native tag of one lower-case alphabetic token (closed classes, suffixes, else NOUN)."""
    return (F.when(t.isin(ARTICLES), F.lit("ARTICLE"))
            .when(t.isin(PRONOUNS), F.lit("PRON"))
            .when(t.isin(ADPOSITIONS), F.lit("ADP"))
            .when(t.isin(INTERJECTIONS), F.lit("INTJ"))
            .when(t.isin(ADVERBS), F.lit("ADV"))
            .when(t.isin(VERBS), F.lit("VERB"))
            .when(t.isin(OTHER), F.lit("OTHER"))
            .when(_long_suffix(t, ADV_SUFFIXES), F.lit("ADV"))
            .when(_long_suffix(t, VERB_SUFFIXES), F.lit("VERB"))
            .when(_long_suffix(t, ADJ_SUFFIXES), F.lit("ADJ"))
            .otherwise(F.lit("NOUN")))


def _in_sql(t: str, words: list[str]) -> str:
    return f"{t} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def _suffix_sql(t: str, suffixes: list[str]) -> str:
    ors = " OR ".join(f"suffix({t}, '{s}')" for s in suffixes)
    return f"(length({t}) >= {SUFFIX_MIN_LEN} AND ({ors}))"


def pos_tag_sql(t: str) -> str:
    return ("CASE "
            f"WHEN {_in_sql(t, ARTICLES)} THEN 'ARTICLE' "
            f"WHEN {_in_sql(t, PRONOUNS)} THEN 'PRON' "
            f"WHEN {_in_sql(t, ADPOSITIONS)} THEN 'ADP' "
            f"WHEN {_in_sql(t, INTERJECTIONS)} THEN 'INTJ' "
            f"WHEN {_in_sql(t, ADVERBS)} THEN 'ADV' "
            f"WHEN {_in_sql(t, VERBS)} THEN 'VERB' "
            f"WHEN {_in_sql(t, OTHER)} THEN 'OTHER' "
            f"WHEN {_suffix_sql(t, ADV_SUFFIXES)} THEN 'ADV' "
            f"WHEN {_suffix_sql(t, VERB_SUFFIXES)} THEN 'VERB' "
            f"WHEN {_suffix_sql(t, ADJ_SUFFIXES)} THEN 'ADJ' "
            "ELSE 'NOUN' END")


def alpha_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(tx.ALPHA), 0)


def alpha_tokens_sql(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '{tx.ALPHA}')"


#: suffix rules in the order of :func:`pos_tag`
_SUFFIXES = [(tuple(ADV_SUFFIXES), "ADV"), (tuple(VERB_SUFFIXES), "VERB"), (tuple(ADJ_SUFFIXES), "ADJ")]
_CLOSED = {w: tag for tag, words in reversed([("ARTICLE", ARTICLES), ("PRON", PRONOUNS), ("ADP", ADPOSITIONS), ("INTJ", INTERJECTIONS),
                                              ("ADV", ADVERBS), ("VERB", VERBS), ("OTHER", OTHER)]) for w in words}
_COUNTED = [*POS_TAGS, "OTHER"]


def pos_tag_value(t: str) -> str:
    """:func:`pos_tag` of one token (used inside the Arrow UDF and by tests)."""
    if t in _CLOSED:
        return _CLOSED[t]
    if len(t) >= SUFFIX_MIN_LEN:
        for suffixes, tag in _SUFFIXES:
            if t.endswith(suffixes):
                return tag
    return "NOUN"


def tag_counts(toks: Column) -> Column:
    """Tokens of each tag (``POS_TAGS``, then OTHER) of a token array, null for a null array.

    An Arrow-batched UDF: a batch's distinct tokens are tagged once and counted per row by their places."""
    width = len(_COUNTED)

    @F.arrow_udf("array<int>")
    def counts(tokens: pa.Array) -> pa.Array:
        words, codes, ends = _coded(tokens)
        tags = np.array([_COUNTED.index(pos_tag_value(w)) for w in words.to_pylist()], np.int64)
        rows = np.repeat(np.arange(len(tokens)), np.diff(ends, prepend=0))
        per_row = np.bincount(rows * width + tags[codes], minlength=len(tokens) * width).astype(np.int32)
        offsets = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * width)
        return pa.ListArray.from_arrays(offsets, pa.array(per_row), mask=tokens.is_null())

    return counts(toks)


def _counted(text: Column) -> tuple[list[Column], Column]:
    """(tokens per tag of ``_COUNTED``, all alphabetic tokens) of a text."""
    counts = tag_counts(alpha_tokens(text))
    each = [counts[i] for i in range(len(_COUNTED))]
    return each, sum(each[1:], each[0])


def pos_percentages(text: Column) -> list[Column]:
    """Percentage of alphabetic tokens per tag (0 for a text without tokens)."""
    each, total = _counted(text)
    return [F.when(total > 0, cnt / total * F.lit(100.0)).otherwise(F.lit(0.0)).alias(f"pct_{tag.lower()}") for tag, cnt in zip(POS_TAGS, each)]


def formality(text: Column) -> Column:
    """D4b in one pass: the signed tag count over the token total equals the percentage formula."""
    each, total = _counted(text)
    signed = sum((F.lit(DEICTIC[tag]) * cnt for tag, cnt in zip(_COUNTED, each)), F.lit(0))
    return F.when(total > 0, (signed / total * F.lit(100.0) + F.lit(100.0)) / F.lit(2.0)).otherwise(F.lit(50.0))


def formality_sql(e: str) -> str:
    toks = alpha_tokens_sql(e)
    tag = pos_tag_sql("t")
    sign = f"CASE WHEN ({tag}) IN ('NOUN', 'ADJ', 'ADP', 'ARTICLE') THEN 1 WHEN ({tag}) = 'OTHER' THEN 0 ELSE -1 END"
    signed = f"coalesce(list_sum(list_transform({toks}, lambda t: {sign})), 0)"
    return f"(CASE WHEN len({toks}) > 0 THEN ({signed} / len({toks}) * 100.0::DOUBLE + 100.0::DOUBLE) / 2.0::DOUBLE ELSE 50.0::DOUBLE END)"


# --------------------------------------------------------------------------------------------
# D7 registry

class GoalRegistry:
    """Name -> scorer (``Column -> Column`` double).  Pandas UDFs are accepted as scorers too."""

    def __init__(self):
        self._goals: dict[str, Callable[[Column], Column]] = {}
        self._sql: dict[str, Callable[[str], str]] = {}

    def register(self, name: str, fn: Callable[[Column], Column], sql: Callable[[str], str] | None = None):
        self._goals[name] = fn
        if sql is not None:
            self._sql[name] = sql
        return fn

    def get(self, name: str) -> Callable[[Column], Column]:
        if name not in self._goals:
            raise ValueError(f"goal {name} is not registered")
        return self._goals[name]

    def sql(self, name: str) -> Callable[[str], str]:
        return self._sql[name]

    def names(self) -> list[str]:
        return list(self._goals)

    def __contains__(self, name: str) -> bool:
        return name in self._goals


REGISTRY = GoalRegistry()
REGISTRY.register("reading_difficulty", reading_difficulty, reading_difficulty_sql)
REGISTRY.register("textual_diversity", textual_diversity, textual_diversity_sql)
REGISTRY.register("text_length", text_length, text_length_sql)
REGISTRY.register("formality", formality, formality_sql)


def register_goal(name: str, sql: Callable[[str], str] | None = None):
    """Decorator form of :meth:`GoalRegistry.register`."""
    def deco(fn):
        REGISTRY.register(name, fn, sql)
        return fn
    return deco
