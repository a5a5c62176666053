"""Each stage against its operator on the stage's own input."""

from collections import Counter

import corpus_pipeline as C
from tonegauge.llm import line_spread, mixing, partenum, toxicity
from tonegauge.llm.store import keep

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = []
    for name, stage in C.STAGES:
        inputs.append(docs)
        docs = keep(stage(spark, docs, SF), name)
    inputs.append(docs)
    assert all(set(x.columns) == set(C.COLUMNS) for x in inputs[:5])
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in inputs]
    scores = toxicity.toxicity_scores(inputs[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(ids[1]) == {r.doc_id for r in scores if r.predicted == 0}
    assert ids[2] == ids[1]
    text = {r.doc_id: r.text for r in line_spread.remove_spread_lines(inputs[1]).collect()}
    assert {r.doc_id: r.text for r in inputs[2].collect()} == text
    groups = partenum.jaccard_components(inputs[2]).collect()
    assert set(ids[3]) == {r.component_id for r in groups} and max(ids[3].values()) == 1
    taken = {r.doc_id: 1 if r.size == 0 else int(r.taken / r.size + 0.5) for r in mixing.mix_sources(inputs[3]).collect()}
    assert ids[4] == Counter({d: n for d, n in taken.items() if n})
    assert set(ids[5]) == set(ids[4])
    whole = Counter(r.doc_id for r in docs.filter("start = 0").select("doc_id").collect())
    assert whole == ids[4]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, score double, line string"
LONG = " ".join(f"w{i}" for i in range(70))
ROWS = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t", None, "a", 3), (4, LONG, "en", "a", 400), (4, LONG, "en", "a", 400), (5, LONG, "en", "b", 400),
        (None, "some words", "en", "a", 10), (None, None, None, None, None), (6, "same line\nother", "en", "a", 15), (7, "same line", "en", None, 9), (8, "word " * 5000, "en", "a", 25000)]


def odd(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 0.9, "clash") for r in rows], SCHEMA).repartition(3)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_on_nulls_empties_and_repeats(spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (5, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = odd(spark, ROWS), str(tmp_path)
    all_rows = Counter((i, t) for i, t, *_ in ROWS)
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert set(out.columns) == set(C.COLUMNS), name
        got = kept(out)
        if name == "line_dedup":
            assert got == all_rows
        if name == "near_duplicates":  # 4 and 5 are one text; one of the two rows 4 stays
            assert got == all_rows - Counter([(4, LONG), (5, LONG)])
        if name == "mixing":
            assert all(got[i, t] == 1 for i, t in ((1, None), (2, ""), (3, " \n\t"), (None, None)))
        assert set(got) <= set(all_rows)
    packed = C.pack(spark, docs, sf).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(i for i, *_ in ROWS)
    assert sum(r.length for r in packed if r.doc_id == 1) == 1


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in C.STAGES:
        assert stage(spark, odd(spark, []), str(tmp_path)).collect() == []
    assert kept(C.drop_toxic(spark, odd(spark, ROWS), str(tmp_path))) == Counter((i, t) for i, t, *_ in ROWS)  # no labels: nothing goes
