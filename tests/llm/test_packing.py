import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tonegauge.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, texts, least_fill=None):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, slot string, part int").repartition(3)
    rows = P.pack(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at: at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.WINDOW
    fill = sum(r.length for r in rows) / (P.WINDOW * len(sequences)) if sequences else 1
    if least_fill:
        assert fill >= least_fill, fill
    return rows


def test_round_trip_and_padding(spark):
    r = random.Random(1)
    words = ["the", "tion,", "Élan", "naïve.", "it's", "a1b2", "x=y", "word..,", "İstanbul", "<|endoftext|>", "日本語", "don't,", "ét", "…"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 200, 600, 1000]))) for _ in range(300)]
    texts += [None, "", " \n\t", "a\x1cb c", "a b c", "word " * 40000, "ab" * 5000]
    check(spark, texts, 0.95)


def test_one_length_for_all(spark):
    check(spark, ["tion " * 1500] * 120, 0.97)


def test_real_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    check(spark, texts, 0.95)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("units,depth", [(8, 3), (12, 2), (5, 5)])
def test_combinations_fill_the_window(units, depth):
    found = P.combinations(units, depth)
    assert len(set(found)) == len(found)
    assert all(sum(c) == units and len(c) <= depth and list(c) == sorted(c, reverse=True) for c in found)


def test_solution_serves_the_histogram():
    r = np.random.default_rng(2)
    h = np.append(0, r.integers(0, 50, 64))
    combos = P.combinations(64)
    x = P.solve(h, combos)
    use = np.zeros(65, int)
    for c, n in zip(combos, x):
        for i in c:
            use[i] += n
    assert (use <= h).all() and use.sum() > 0.5 * h.sum()
