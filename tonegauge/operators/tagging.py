"""Part-of-speech shares from a lexicon table or from a table of tagged tokens.

The inline tagger (:func:`scorers.pos_tag`) knows closed word classes and suffixes.  Here the lexicon is data: any
(token, tag) table, with the suffix rules for tokens that it lacks; or the tokens come tagged from elsewhere.
Tokens are exploded and counted per (row, token) before they meet the lexicon, which is broadcast only if its
counted size allows and joined by token otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.functions import scorers as S

#: most lexicon rows that are broadcast
SMALL_LEXICON = 200_000


def suffix_tag(t: Column) -> Column:
    """The tag of a token that no lexicon holds: by suffix, else NOUN."""
    return (F.when(S._long_suffix(t, S.ADV_SUFFIXES), "ADV").when(S._long_suffix(t, S.VERB_SUFFIXES), "VERB")
            .when(S._long_suffix(t, S.ADJ_SUFFIXES), "ADJ").otherwise("NOUN"))


def closed_classes(spark: SparkSession) -> DataFrame:
    """(token, tag) of the scorers' closed word classes; the first class of a token counts."""
    tags: dict[str, str] = {}
    for tag, tokens in (("ARTICLE", S.ARTICLES), ("PRON", S.PRONOUNS), ("ADP", S.ADPOSITIONS), ("INTJ", S.INTERJECTIONS), ("ADV", S.ADVERBS),
                        ("VERB", S.VERBS), ("OTHER", S.OTHER)):
        for t in tokens:
            tags.setdefault(t, tag)
    return spark.createDataFrame(sorted(tags.items()), "token string, tag string")


def token_counts(df: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, token, n): the alphabetic tokens of each row, lower-cased."""
    return df.select(*key, F.explode(S.alpha_tokens(F.col(text_col))).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("n"))


def tagged_counts(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``counts`` with ``tag``: the lexicon's (one per token, the smallest if it names several), or by suffix."""
    one = lexicon.filter("token is not null").groupBy(F.lower("token").alias("token")).agg(F.min("tag").alias("_tag"))
    if lexicon.limit(SMALL_LEXICON + 1).count() <= SMALL_LEXICON:
        one = F.broadcast(one)
    return counts.join(one, "token", "left").withColumn("tag", F.coalesce("_tag", suffix_tag(F.col("token")))).drop("_tag")


def shares(df: DataFrame, key: list[str], tagged: DataFrame) -> DataFrame:
    """(key, pct_<tag>...) of every row of ``df``: 0 for one without tokens; ``tagged`` has (key, tag, n).

    ``key`` names a row; rows with equal keys count as one.  A DET counts as ARTICLE only if ``tagged`` carries
    ``token`` and it is a, an or the; any other tag outside the eight only adds to the total."""
    tag = F.col("tag")
    if "token" in tagged.columns:
        tag = F.when((tag == "DET") & F.lower("token").isin(S.ARTICLES), "ARTICLE").otherwise(tag)
    n = F.col("n") if "n" in tagged.columns else F.lit(1)
    sums = tagged.withColumn("_tag", tag).groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(
        F.sum(n).alias("_total"), *[F.sum(F.when(F.col("_tag") == t, n).otherwise(0)).alias(f"_n_{t}") for t in S.POS_TAGS])
    rows = df.select(*key).distinct()
    same = F.lit(True)
    for k in key:
        same = same & rows[k].eqNullSafe(F.col(f"_k_{k}"))
    pct = [F.when(F.col("_total") > 0, F.col(f"_n_{t}") / F.col("_total") * F.lit(100.0)).otherwise(F.lit(0.0)).alias(f"pct_{t.lower()}") for t in S.POS_TAGS]
    return rows.join(sums, same, "left").select(*key, *pct)


def lexicon_percentages(df: DataFrame, key: list[str], lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """D4a with a lexicon table."""
    return shares(df, key, tagged_counts(token_counts(df, key, text_col), lexicon))
