import random
import zlib

import numpy as np
import pytest

from tonegauge.llm import toxicity as T

BAD = ["idiot", "moron", "scum", "clown"]


def corpus(n=900, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([8, 40, 200]))]
        toxic = int(r.random() < 0.2)
        for _ in range(toxic * r.randint(1, 3)):
            w.insert(r.randrange(len(w)), r.choice(BAD).title() + r.choice(["", ",", "."]))
        docs.append((i, " ".join(w), "en", "s", 0.5))
        if r.random() < 0.7:
            labels.append((i, 1, toxic))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double")
    return d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    toxic = {i for i, t, *_ in docs if any(b in t.lower() for b in BAD)}
    docs += [(5000, None, "", "", 0.0), (5001, "", "", "", 0.0), (5002, "w1 " * 60000 + " ".join(BAD), "", "", 0.0), (5003, "w1 " * 60000, "", "", 0.0), (None, "idiot moron clown w1 w2 w3 w4 w5", "", "", 0.0), (5002, "w1 " * 60000 + " ".join(BAD), "", "", 0.0)]
    labels += [(None, 1, 1), (3, 1, None)]
    got = T.toxicity_scores(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    hits = [(r.predicted == 1) == (r.doc_id in toxic) for r in got if r.doc_id is not None and r.doc_id < 5000]
    assert np.mean(hits) > 0.97
    by = {r.doc_id: r.predicted for r in got}
    assert (by[5000], by[5001], by[5002], by[5003], by[None]) == (0, 0, 1, 0, 1)
    assert by == {r.doc_id: r.predicted for r in T.score(*frames(spark, docs, labels)).collect()}


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a = {r.doc_id: r.score for r in T.toxicity_scores(*frames(spark, docs, labels)).collect()}
    b = {r.doc_id: r.score for r in T.toxicity_scores(*frames(spark, docs, flipped)).collect()}
    assert a == b


def test_without_labels_or_rows(spark):
    docs, labels = corpus(20)
    assert {r.score for r in T.toxicity_scores(*frames(spark, docs, [])).collect()} == {0.0}
    assert T.toxicity_scores(*frames(spark, [], labels)).count() == 0


def test_calibration_separates():
    x = np.array([[0.0, 1.0]] * 80 + [[0.4, 1.0]] * 20)
    line = T.calibrate(x, (x[:, 0] > 0.2).astype(float), np.ones(100))
    p = 1 / (1 + np.exp(-(line[0] + np.array([[0.0, 1.0], [0.4, 1.0]]) @ line[1:])))
    assert p[0] < 0.1 and p[1] > 0.9


EMPTY = {"words": np.zeros(0, np.uint64), "word_llr": np.zeros(0), "pairs": np.zeros(0, np.uint64), "pair_llr": np.zeros(0),
         "grams": np.zeros(0, np.uint64), "gram_llr": np.zeros(0), "ctxs": np.zeros(0, np.uint64), "ctx_llr": np.zeros(0)}


@pytest.mark.parametrize("text,n", [("a b", 2), ("", 0), (None, 0)])
def test_evidence_without_a_model_is_zero(text, n):
    import pyarrow as pa
    llr, _, wo = T.evidence(EMPTY, pa.array([text], pa.string()))
    assert llr.tolist() == [0.0] * n and wo.tolist() == [0, n]
    got = T.features(EMPTY, pa.array([text], pa.string()))
    assert got[0, :-1].tolist() == [0.0] * (got.shape[1] - 1) and got[0, -1] == np.log1p(n)


def test_features_against_loops():
    import pyarrow as pa
    from tonegauge.llm.arrowtext import ALNUM, word_hashes
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    h = np.unique(word_hashes(pa.array([" ".join(vocab)]), ALNUM)[0])
    model = EMPTY | {"words": h, "word_llr": np.random.default_rng(1).normal(0, 2, len(h))}
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 30, 200]))) for _ in range(60)]
    got = T.features(model, pa.array(texts))
    for t, row in zip(texts, got):
        words = word_hashes(pa.array([t]), ALNUM)[0]
        e = [float(np.clip(model["word_llr"][np.searchsorted(h, w)], -8, 8)) for w in words]
        want = [sum(e) / max(len(e), 4)]
        want += [max((sum(e[max(0, i - n): i]) / n for i in range(1, len(e) + 1)), default=0.0) for n in T.WINDOWS]
        best = sorted({w: x for w, x in zip(words.tolist(), e) if x > T._STRONG}.values(), reverse=True)
        want += [sum(best[:k]) / k for k in T.STRONGEST] + [np.log1p(len(e))]
        assert np.allclose(row, want)


def test_spelling_against_recursion():
    """Interpolated Kneser-Ney by the book, over Python dictionaries."""
    from collections import Counter
    r = random.Random(3)
    types = [["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(60)] for _ in (0, 1)]
    types[1] += [f"abb{x}" for x in "abccabca"]
    table = Counter()
    for c in (0, 1):
        for w in types[c]:
            x = "\x01" + w + "\x02"
            for t in range(1, len(x)):
                for m in range(1, min(T.SPELL, t + 1) + 1):
                    table[m, x[t - m + 1: t + 1], c] += 1

    def pack(m, x):
        return int.from_bytes(x.encode(), "big") | m << 56

    keys = sorted({(m, g) for m, g, _ in table})
    m = np.array([k[0] for k in keys])
    grams = np.array([pack(*k) for k in keys], np.uint64)
    ctx = np.array([pack(k[0] - 1, k[1][:-1]) if k[0] > 1 else 0 for k in keys], np.uint64)
    g = np.array([[table[(*k, c)] for k in keys] for c in (0, 1)])
    model = T.spelling(m, grams, ctx, g)
    d = {(o, c): T.discounts(g[c][m == o]) for o in range(2, T.SPELL + 1) for c in (0, 1)}
    ones = [k for k in keys if k[0] == 1]
    shared = sum(table[(*k, c)] for k in ones for c in (0, 1))

    def p(x, c):
        if len(x) == 1:
            return (table[1, x, 0] + table[1, x, 1] + 0.5) / (shared + 0.5 * len(ones))
        seen = [n for (o, y, k), n in table.items() if o == len(x) and k == c and y[:-1] == x[:-1]]
        lower = p(x[1:], c)
        if not sum(seen):
            return lower
        less = lambda n: max(n - d[len(x), c][min(n, 3)], 0) if n else 0.0
        return less(table[len(x), x, c]) / sum(seen) + (1 - sum(map(less, seen)) / sum(seen)) * lower

    for w in ["abba", "cab", "a", "abbcc", "ccccccccc", *types[1][:10]]:
        x = "\x01" + w + "\x02"
        want = sum(np.log(p(x[max(0, t - T.SPELL + 1): t + 1], 1) / p(x[max(0, t - T.SPELL + 1): t + 1], 0)) for t in range(1, len(x)))
        raw = np.frombuffer(w.encode(), np.uint8)
        assert T.spelled(model, raw, np.array([0]), np.array([len(raw)]))[0] == pytest.approx(np.clip(want, -T.MOST_SPELLING, T.MOST_SPELLING))


def test_words_and_pairs_hand_down_evenly(spark):
    k = [(400, 420), (1, 0), (0, 9), (3, 3), (1, 0)] + [(i, i) for i in (1, 2, 3, 4)] * 20

    def words(spell):
        df = spark.createDataFrame([(i, a, b, 1, spell if i == 1 else 0.0) for i, (a, b) in enumerate(k)], "w long, k0 long, k1 long, n long, spell double")
        return {r.w: np.log(r.p1 / r.p0) for r in T.word_model(df, 1000).collect()}

    llr = words(0.0)
    assert abs(llr[3]) < 0.1 and llr[2] > 1.5 and -1.5 < llr[1] < 0 and llr[1] == pytest.approx(llr[4])
    assert words(2.0)[1] > llr[1] + 0.5
    pairs = spark.createDataFrame([(h, w, *d) for h in range(20) for w, d in enumerate([(5, 5), (1, 0), (0, 1), (0, 12)])], "h long, w long, d0 long, d1 long")
    p = spark.createDataFrame([(w, 1e-3, 1e-3) for w in range(4)], "w long, p0 double, p1 double")
    got = {(r.h, r.w): r.llr for r in T.pair_model(pairs, p).collect()}
    assert len(got) == 80 and all(v == pytest.approx(got[0, w]) for (_, w), v in got.items())
    assert got[0, 3] > 1 and abs(got[0, 1]) < 1.5 and abs(got[0, 2]) < 1.5


def test_expressions_of_few_documents_count(spark):
    r = random.Random(5)
    rare = [f"slur{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(900):
        w = [f"w{r.randrange(500)}" for _ in range(40)]
        toxic = int(r.random() < 0.2)
        for x in r.sample(rare, 3 * toxic):
            w.insert(r.randrange(len(w)), x)
        docs.append((i, " ".join(w), "en", "s", 0.5))
        labels.append((i, 1, toxic))
    toxic = {i for i, _, t in labels if t}
    got = [r for r in T.toxicity_scores(*frames(spark, docs, labels)).collect() if r.held_out]
    assert sum(r.predicted for r in got if r.doc_id in toxic) > 0.6 * sum(r.doc_id in toxic for r in got)
    assert sum(r.predicted for r in got if r.doc_id not in toxic) < 0.05 * len(got)


def test_rare_words_of_one_form(spark):
    """Every toxic word is nearly unique; only its beginning recurs."""
    r = random.Random(6)
    syllables = ["ba", "ke", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu"]

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randrange(2, 5)))

    docs, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(60)]
        toxic = int(r.random() < 0.2)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["zogr", "quax"]) + word() + word())
        docs.append((i, " ".join(w), "en", "s", 0.5))
        labels.append((i, 1, toxic))
    toxic = {i for i, _, t in labels if t}
    got = [r for r in T.toxicity_scores(*frames(spark, docs, labels)).collect() if r.held_out]
    assert sum(r.predicted for r in got if r.doc_id in toxic) > 0.8 * sum(r.doc_id in toxic for r in got)
    assert sum(r.predicted for r in got if r.doc_id not in toxic) < 0.03 * len(got)


def test_toxic_pairs_of_ordinary_words(spark):
    """Words say nothing alone: the same two stand in clean texts the other way round."""
    r = random.Random(8)
    pairs = [(f"w{2 * i}", f"w{2 * i + 1}") for i in range(8)]
    docs, labels = [], []
    for i in range(1500):
        w = [f"w{r.randrange(300)}" for _ in range(40)]
        toxic = int(r.random() < 0.25)
        for a, b in r.sample(pairs, 3):
            w[r.randrange(len(w)):0] = [a, b] if toxic else [b, a]
        docs.append((i, " ".join(w), "en", "s", 0.5))
        labels.append((i, 1, toxic))
    toxic = {i for i, _, t in labels if t}
    got = [r for r in T.toxicity_scores(*frames(spark, docs, labels)).collect() if r.held_out]
    assert sum(r.predicted for r in got if r.doc_id in toxic) > 0.7 * sum(r.doc_id in toxic for r in got)
    assert sum(r.predicted for r in got if r.doc_id not in toxic) < 0.05 * len(got)


def test_shared_counts_hold_every_word_of_the_corpus(spark):
    from tonegauge.llm.arrowtext import ALNUM, word_hashes
    import pyarrow as pa
    r = random.Random(9)
    texts = [" ".join(f"v{r.randrange(3000)}" for _ in range(r.randrange(200))) for _ in range(80)] + [None, "", "v1 V1, v1"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    want = {}
    for w in word_hashes(pa.array(texts), ALNUM)[0].view(np.int64).tolist():
        want[w] = want.get(w, 0) + 1
    rows = T.corpus_counts(df).collect()
    assert len(rows) == len(want) and {x.w: x.n for x in rows} == want


def test_only_near_copies_of_one_class_are_a_family(spark):
    r = random.Random(4)
    words = lambda n: [f"x{r.randrange(10**6)}" for _ in range(n)]
    passage = words(40)
    shared = [" ".join(words(60) + passage + words(60)) for _ in range(30)]
    base = words(400)
    copies = [" ".join(base[:i] + ["other"] + base[i + 1:]) for i in range(0, 400, 40)]
    rows = [(i, t, 0) for i, t in enumerate(shared)] + [(100 + i, t, 1) for i, t in enumerate(copies)] + [(50, " ".join(base), 0), (51, "a b", 0), (52, "", 1)]
    kept = sorted(x.key for x in T._one_of_each_family(spark.createDataFrame(rows, "key long, text string, toxic int")).collect())
    assert kept == [*range(30), 50, 51, 52, 100]
