import random
import re
from collections import defaultdict

from tonegauge.llm import sparse_suffix as S

SCHEMA = "doc_id long, text string, key string, pos int, left string"


def brute(data):
    """Union of all 50-word runs that stand at two places."""
    where, words = defaultdict(set), {}
    for d, t in data:
        if d is None or t is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        words[d] = w
        for i in range(len(w) - S.LEAST + 1):
            where[tuple(w[i: i + S.LEAST])].add((d, i))
    out = defaultdict(list)
    hit = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                hit[d].add(i)
    for d, starts in hit.items():
        for i in sorted(starts):
            if out[d] and i <= out[d][-1][1]:
                out[d][-1][1] = i + S.LEAST
            else:
                out[d].append([i, i + S.LEAST])
    return sorted((d, i, j - i) for d, spans in out.items() for i, j in spans)


def run(spark, data):
    df = spark.createDataFrame([(d, t, "x", 0, "y") for d, t in data], SCHEMA).repartition(3)
    return S.repeated_passages(df).collect()


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    some = lambda k: [r.choice(vocab) for _ in range(k)]
    passages = [some(k) for k in (30, 45, 49, 50, 51, 60, 80, 200)]
    out = []
    for i in range(n):
        w = some(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, max(0, len(p) - 50))
            w += (p if r.random() < 0.6 else p[a: a + r.randint(26, 90)]) + some(r.randint(0, 30))
        out.append((i, r.choice([" ", "\n"]).join(w).replace("w1", r.choice(["w1", "W1"]))))
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        data = corpus(seed) + [(500, None), (501, ""), (502, "a " * 300), (503, "b c " * 100), (504, "short one"), (505, corpus(9)[3][1]), (506, corpus(9)[3][1])]
        got = run(spark, data)
        assert sorted((r.doc_id, r.start, r.n_words) for r in got) == brute(data)
        text = dict(data)
        for r in got:
            a = text[r.doc_id].lower().split()[r.start: r.start + r.n_words]
            runs = {tuple(a[i: i + S.LEAST]) for i in range(len(a) - S.LEAST + 1)}
            b = text[r.other_doc_id].lower().split()
            assert runs & {tuple(b[i: i + S.LEAST]) for i in range(len(b) - S.LEAST + 1)}


def test_repeated_rows_and_empty_table(spark):
    t = " ".join(f"u{i}" for i in range(90))
    assert run(spark, [(1, t), (1, t), (None, t)]) == []
    assert [tuple(r) for r in run(spark, [(1, t), (1, t), (2, t), (None, t)])] in ([(1, 0, 90, 2), (2, 0, 90, 1)], [(2, 0, 90, 1), (1, 0, 90, 2)])
    assert run(spark, []) == []
