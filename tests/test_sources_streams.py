"""Datasets by version, round trips of sources and sinks, and the streaming cache over several starts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegauge.operators import goalspace as GS
from tonegauge.sources import tables as TB
from tonegauge.streaming import scoring as ST


def texts(df, col="text"):
    return sorted((r[col] for r in df.collect()), key=str)


# ---------------------------------------------------------------- A2 / A3
def test_versions_are_pruned_and_kept_apart(spark, tmp_path):
    base = str(tmp_path)
    for v, s in (("1.1", "train"), ("1.10", "train"), ("1.10", "test")):
        TB.write_dataset(spark.createDataFrame([(f"{v}/{s}",)], "text string"), base, "d", v, s)
    one = TB.read_dataset(spark, base, "d", "1.10", "train")
    assert texts(one) == ["1.10/train"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "PartitionFilters" in x][0].split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "version" in filters and "split" in filters and "1.10" in filters
    assert texts(TB.read_dataset(spark, base, "d", "1.1")) == ["1.1/train"]
    assert texts(TB.read_dataset(spark, base, "d", split="train")) == ["1.1/train", "1.10/train"]
    assert texts(TB.read_dataset(spark, base, "d")) == ["1.1/train", "1.10/test", "1.10/train"]
    assert TB.read_dataset(spark, base, "d", "3") is None and TB.read_dataset(spark, base, "no") is None
    TB.write_dataset(spark.createDataFrame([("new",)], "text string"), base, "d", "1.10", "test")
    assert texts(TB.read_dataset(spark, base, "d")) == ["1.1/train", "1.10/train", "new"]


def test_collecting_keeps_a_checkpoint_a_version(spark, tmp_path):
    base, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    for v in ("1", "2"):
        TB.write_dataset(spark.createDataFrame([(f"text {v}",)], "text string"), base, "d", v, "train")
    limits = {"min_words_per_doc": None, "max_words_per_doc": None}
    cfg = [{"name": "d", "version": v, "split": "train", "feature_col": "text", "kwargs": limits} for v in ("1", "2", "9")]
    assert sorted((r.text, r.source) for r in TB.collect_datasets(spark, base, cfg, checkpoint_dir=kept).collect()) == [
        ("text 1", "Dataset: d/1/train"), ("text 2", "Dataset: d/2/train")]
    TB.write_dataset(spark.createDataFrame([("changed",)], "text string"), base, "d", "1", "train")
    assert texts(TB.collect_datasets(spark, base, cfg, checkpoint_dir=kept)) == ["text 1", "text 2"]
    assert texts(TB.collect_datasets(spark, base, cfg, reload=["d"], checkpoint_dir=kept)) == ["changed", "text 2"]
    with pytest.raises(ValueError):
        TB.collect_datasets(spark, base, cfg[2:])


# ---------------------------------------------------------------- A1, A4, A5, A7 - A10
def test_csv_and_parquet_round_trips(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType())])
    rows = [(1, 'a "quoted", text\nover lines\\', 0.5), (2, None, float("nan")), (3, "ü", None)]
    df = spark.createDataFrame(rows, schema)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / f"new/folder/t.{fmt}")
        TB.write_table(df, path, fmt)
        got = TB.read_table(spark, path, schema, {"id": "row_id", "text": "text", "x": "x"})
        assert sorted(map(tuple, got.collect())) == [(1, rows[0][1], 0.5), (2, None, None), (3, "ü", None)]
        assert [r.id for r in TB.read_table(spark, path, schema, nrows=2, order_col="id").collect()] == [1, 2]


def test_summary_cache_database_and_phase(spark, tmp_path):
    doc = spark.createDataFrame([({"a": 1.0}, "x")], "metrics map<string,double>, run string")
    TB.write_summary(doc, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().metrics.a == 1.0
    (tmp_path / "cache.tsv").write_text('f1\t{"choices": [{"message": {"content": "hi \\"you\\"\\nthere"}}]}\nf2\t{"choices": []}\n')
    assert sorted(map(tuple, TB.read_llm_cache(spark, str(tmp_path / "cache.tsv")).collect())) == [("f1", 'hi "you"\nthere'), ("f2", None)]
    db = spark.createDataFrame([(0.5, ["do this", "and that"])], "delta_a double, edit_instruction array<string>")
    TB.write_table(db, str(tmp_path / "db"))
    assert TB.read_instruction_db(spark, str(tmp_path / "db")).collect() == db.collect()
    calls = []

    def compute():
        calls.append(1)
        return db
    for redo in (False, False, True):
        assert TB.phase(spark, str(tmp_path / "phase"), compute, redo).count() == 1
    assert len(calls) == 2


# ---------------------------------------------------------------- S2, D6
GOALS = ["text_length", "reading_difficulty"]


def write(spark, folder, rows):
    schema = ST.DOCUMENTS
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_two_starts_score_each_text_once(spark, tmp_path, monkeypatch):
    scored = []
    real = GS.map_goals

    def counting(df, goals, *a, **k):
        scored.append(df.count())
        return real(df, goals, *a, **k)

    monkeypatch.setattr(ST, "map_goals", counting)
    cache = str(tmp_path / "cache")
    write(spark, tmp_path / "in", [(1, "one text"), (2, None), (3, "one text"), (4, "two")])
    write(spark, tmp_path / "in", [(5, None), (6, "three")])
    stream = lambda: ST.text_stream(spark, str(tmp_path / "in"), "*.parquet")
    first = ST.dedup_stream(spark, stream(), GOALS, cache)
    assert first.count() == 4 and first.filter("text_key is null").count() == 1 and sum(scored) == 4
    # a second start: new rows, late repeats of old ones, nulls again
    write(spark, tmp_path / "in", [(7, "two"), (8, "four"), (9, None), (10, "three")])
    again = ST.dedup_stream(spark, stream(), GOALS, cache)
    assert again.count() == 5 and sum(scored) == 5
    want = {r.text: tuple(r)[1:] for r in real(spark.createDataFrame([("one text",), ("two",), ("three",), ("four",), (None,)], "text string"), GOALS).collect()}
    keys = {r.k: r.text for r in spark.createDataFrame([(t,) for t in want], "text string").select("text", ST.text_key(F.col("text")).alias("k")).collect()}
    assert {keys[r.text_key]: tuple(r)[1:] for r in again.collect()} == want
    # a batch that is run once more appends nothing
    ST.score_misses(spark.read.parquet(str(tmp_path / "in")), cache, GOALS)
    assert ST.read_cache(spark, cache, GOALS).count() == 5


def test_a_batch_reads_only_its_folders(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.range(500).select(F.concat(F.lit("text "), "id").alias("text"))
    ST.score_misses(docs, cache, ["text_length"])
    some = ST.read_cache(spark, cache, ["text_length"], ["0a", "0b"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert 0 < some.count() < 20 and {r.folder for r in some.collect()} <= {"0a", "0b"}


def test_repeats_within_the_watermark_go(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "k string, ts timestamp"

    def put(rows):
        spark.createDataFrame([(k, t0 + dt.timedelta(hours=h)) for k, h in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = ST.drop_repeats(spark, stream, ["k"], "ts", "2 hours", str(tmp_path / "out")).collect()
        return sorted(((r.k or "null", (r.ts - t0).total_seconds() / 3600) for r in rows))

    put([("a", 0), ("a", 0), (None, 0), (None, 0)])
    assert run() == [("a", 0), ("null", 0)]
    put([("a", 1), ("b", 1), (None, 1)])  # a second start keeps the state
    assert run() == [("a", 0), ("b", 1), ("null", 0)]


@pytest.mark.parametrize("with_cache", [False, True])
def test_null_texts_are_scored_like_any_other(spark, with_cache):
    df = spark.createDataFrame([(1, None), (2, "a text"), (3, None)], "id int, text string")
    cache = GS.map_with_cache(df.filter("id = 2"), None, ["text_length"])[1] if with_cache else None
    goals = ["text_length", "formality"]
    out, new = GS.map_with_cache(df, cache, goals)
    want = {r.id: (r.text_length, r.formality) for r in GS.map_goals(df, goals).collect()}
    assert {r.id: (r.text_length, r.formality) for r in out.collect()} == want and out.count() == 3
    assert new.count() == 2 and new.filter("text_key is null").count() == 1


@pytest.mark.parametrize("as_folder", [False, True])
def test_a_stream_reads_a_table_of_one_file_or_of_parts(spark, tmp_path, as_folder):
    from tonegauge.plans.q_text import RANGES
    if as_folder:
        write(spark, tmp_path / "in" / "documents.parquet", [(1, "one text")])
        write(spark, tmp_path / "in" / "documents.parquet", [(2, None)])
    else:
        write(spark, tmp_path / "parts", [(1, "one text"), (2, None)])
        (tmp_path / "in").mkdir()
        next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "in" / "documents.parquet")
    write(spark, tmp_path / "in" / "other.parquet", [(3, "another table")])
    out = ST.score_stream(spark, ST.text_stream(spark, str(tmp_path / "in")), list(RANGES), RANGES)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_chunks_split_the_sentences_once(spark):
    from tonegauge.functions import text as tx
    df = spark.createDataFrame([("A b. C d! E f? G.",), ("",), (None,)], "t string")
    out = df.select(tx.chunk_sentences(F.col("t"), 3).alias("c"))
    assert [r.c for r in out.collect()] == [["A b. C d! E f?", "G."], [], []]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
