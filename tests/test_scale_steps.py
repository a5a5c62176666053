"""Steps whose work or traffic must not multiply: scores, n-gram counts, judged lines."""

from pyspark.sql import functions as F

from tonegauge.operators import flow as FL
from tonegauge.plans import fixtures as X
from tonegauge.plans import q_metrics, q_rewards_prompts

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generations_are_scored_once(spark):
    X.reset()
    out = q_rewards_prompts.r2_generations(spark, SF)
    assert "regexp_replace" not in optimized(out)  # raw and normalised scores come from the written table
    assert out.count() == 16 * X.read(spark, SF, "documents").count()


def test_bleu_deals_more_text_to_more_tasks(spark, monkeypatch):
    df = spark.range(40).select(F.concat(F.lit("some text of row "), "id").alias("text"), F.lit("some other text").alias("llm_response"), F.lit("s").alias("source"))
    want = {r.text: r.bleu for r in FL.with_bleu(df).collect()}
    monkeypatch.setattr(FL, "PART_BYTES", 100)
    small = FL.with_bleu(df)
    size = df.agg(F.sum(F.length("text") + F.length("llm_response"))).first()[0]
    assert f", {-(-size // 100)}), REPARTITION" in small._jdf.queryExecution().executedPlan().toString()
    assert {r.text: r.bleu for r in small.collect()} == want


def aggregated_rows(df):
    """The rows that each hash aggregate of ``df`` gives out, as it runs."""
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        df.collect()
        found, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "HashAggregate":
                found.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found
    finally:
        spark.conf.set(name, before)


def test_bleu_counts_repeats_only(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [("k", " ".join(words), " ".join(words[::-1])), ("l", "a a a b b c", "a a b b b c"), ("m", "", "a"), ("n", "a", "?!")]
    df = spark.createDataFrame(rows, "k STRING, c STRING, r STRING")
    small = FL.pair_bleu(df, ["k"], "c", "r")
    found = aggregated_rows(small)
    # of 8 x 500 n-grams of the first row none repeats; a, aa, b and bb and the 16 heads (4 pairs, 4 orders) are counted
    assert found and max(found) <= 16 + 4
    got = {r.k: r.bleu for r in small.collect()}
    assert got["m"] == got["n"] == 0 and abs(got["k"] - (1.0 * (0.1 / 499) * (0.1 / 498) * (0.1 / 497)) ** 0.25) < 1e-12
    # a 2, b 2, c 1 of 6; aa, ab, bb, bc of 5; aab, abb, bbc of 4; aabb of 3
    assert abs(got["l"] - (5 / 6 * 4 / 5 * 3 / 4 * 1 / 3) ** 0.25) < 1e-12


def test_bleu_makes_a_derived_text_once_a_side_of_the_join(spark):
    df = spark.range(9).select(F.when(F.col("id") > 0, F.concat(F.lit("some text of row "), "id")).alias("text"), F.lit("s").alias("source"))
    df = df.withColumn("llm_response", F.regexp_replace("text", r"(\w+) (\w+)", "$2 $1")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(2))))
    assert optimized(FL.bleu_by_source(FL.with_bleu(df))).count("regexp_replace") == 2


def test_verdicts_meet_narrow_lines(spark):
    X.reset()
    judged = q_metrics.numeric_judged(spark, SF)
    lines = optimized(judged).split("\n")
    join = next(i for i, line in enumerate(lines) if "Join " in line)
    assert not any("output_" in line or "source_" in line for line in lines[join:])
    assert judged.columns[-2:] == ["answer", "rationale_approved"] and judged.count() == X.read(spark, SF, "lineitem").count()


def test_a_single_row_group_is_dealt_to_many_tasks(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some text"), F.md5(F.col("id").cast("string"))).alias("text"))
    path = f"{tmp_path}/documents.parquet"
    docs.coalesce(1).write.parquet(path)  # one file of one row group, in many splits
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4k")
    try:
        scan = spark.read.parquet(path)
        splits = scan.rdd.getNumPartitions()
        assert splits > spark.sparkContext.defaultParallelism

        def largest(df):
            return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

        dealt = X.spread(scan, "doc_id")
        assert largest(scan) == 2000 and largest(dealt) <= 2 * 2000 / splits + 40
        assert sorted(dealt.collect()) == sorted(scan.collect())
        even = X.spread(dealt, "doc_id")  # nothing to do for rows that arrive evenly
        assert even is dealt
    finally:
        spark.conf.set(name, before)


def test_an_empty_table_is_left_alone(spark):
    none = spark.range(0).withColumnRenamed("id", "doc_id")
    assert X.spread(none, "doc_id") is none
