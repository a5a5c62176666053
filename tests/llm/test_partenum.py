"""PartEnum join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from tonegauge.llm import partenum as P

SCHEMA = "doc_id long, text string, lang string, key string"


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        if d is not None:
            sets[d] = s
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=3, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(40)]
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 4, 5, 8, 9, 10, 15, 30, 80, 200, 600]))] for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.2:
            w = w + passage
        rows.append((i, " ".join(w).title() if r.random() < 0.2 else "\n".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "One"), (5005, "a " * 30000), (5006, "A " * 30001)]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "x") for d, t in rows], SCHEMA).repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in P.jaccard_components(df).collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_frequent_features_are_lossless(spark, monkeypatch):
    monkeypatch.setattr(P, "FREQUENT", 2)
    rows = corpus(seed=9)
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (None, "a b c d e f", "", ""), (2, "a b c d e f", "", "")], SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in P.jaccard_components(df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 2, None)]
    assert P.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_similar_sets_share_a_signature(seed):
    r = np.random.default_rng(seed)
    for n in [4, 5, 6, 9, 14, 40, 200, 1000]:
        base = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        k = n // 9
        other = np.unique(np.concatenate([base[k:], r.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(base, other))
        if both * 100 < 80 * (len(base) + len(other) - both) or np.array_equal(base, other):
            continue
        full = np.array([len(base), len(other)])
        x = np.concatenate([base, other])
        s0, r0, short = P.signatures(x, full, full, 80, 0)
        if short.all():
            s1, r1, _ = P.signatures(x, full, full, 80, 1)
            s0, r0 = np.concatenate([s0, s1]), np.concatenate([r0, r1])
        assert set(s0[r0 == 0]) & set(s0[r0 == 1])


def test_family_of_near_copies_in_blocks(spark, monkeypatch):
    """Many edits of one text, most of them not similar to the smallest id."""
    monkeypatch.setattr(P, "BLOCK", 8)
    monkeypatch.setattr(P, "LARGE", 6)
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n,m", [(5, 6), (30, 36), (64, 65), (100, 130), (1000, 900)])
def test_parity_maps_bound_the_difference(n, m):
    r = np.random.default_rng(n)
    x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    y = np.unique(np.concatenate([x[: n // 2], r.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2)]))
    assert P._differ_in(P.parity_map(x), P.parity_map(y)) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("n", [60])
def test_candidates_grow_in_proportion_to_a_family(spark, monkeypatch, n):
    """Pairs that leave a step, for n and 4 n near copies of one text: hubs and centres are linear."""
    seen, verified = [], P._verified

    def counted(pairs, nodes, percent):
        seen[-1].append(pairs.count())
        return verified(pairs, nodes, percent)

    monkeypatch.setattr(P, "_verified", counted)
    r = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(4 * n):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for m in (n, 4 * n):
        seen.append([])
        assert run(spark, rows[:m]) == brute(rows[:m])
    assert sum(seen[1]) <= 6 * sum(seen[0]) and sum(seen[1]) < 4 * n * 8


def test_settled_components_take_one_turn(spark, monkeypatch):
    written, keep = [], P.keep
    monkeypatch.setattr(P, "keep", lambda df, name: written.append(name) or keep(df, name))
    stars = spark.createDataFrame([(1, 2), (1, 3), (7, 9)], "a long, b long")
    found = {r.node: r.comp for r in P.components(stars).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7} and written == ["cc", "cc"]
    path = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {r.node: r.comp for r in P.components(path).collect()} == {i: 0 for i in range(10)}


def joined(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        before = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root


@pytest.mark.parametrize("held", [1 << 18, 3])
def test_components_of_any_graph(spark, monkeypatch, held):
    """Loops, repeated and reversed edges, negative ids, a hub above and one below its neighbours; also in stretches of few edges."""
    monkeypatch.setattr(P, "_EDGES", held)
    r = random.Random(held)
    edges = [(r.randrange(-40, 160), r.randrange(-40, 160)) for _ in range(90)]
    edges += [(300, 300), (301, 302), (302, 301), (302, 301)] + [(900, 500 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(60)]
    edges += [(2000 + i, 2000 + (i * 7 + 3) % 40) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {x.node: x.comp for x in P.components(df).collect()} == joined(edges)


def test_components_take_few_tasks(spark):
    """Chains of stars, as groups of near copies give them: tasks until all are settled."""
    r = random.Random(5)
    ids = list(range(1200))
    r.shuffle(ids)
    edges = [(ids[40 * (i // 40)], ids[i]) for i in range(1200)] + [(ids[40 * i + 39], ids[40 * i + 41]) for i in range(29)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    sc = spark.sparkContext
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        sc.setJobGroup("few-tasks", "components")
        found = {x.node: x.comp for x in P.components(df).collect()}
        sc.setJobGroup("other", "")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    seen = sc.statusTracker()
    stages = {i for j in seen.getJobIdsForGroup("few-tasks") for i in seen.getJobInfo(j).stageIds}
    tasks = sum(seen.getStageInfo(i).numCompletedTasks for i in stages if seen.getStageInfo(i))
    assert found == joined(edges) and len(set(found.values())) == 1
    assert tasks <= 600, tasks


def python_nodes(plan):
    """Most Python steps between two exchanges of a plan: each is a worker of its own in every task."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return python_nodes(plan.initialPlan())
    kids = plan.children()
    below = [python_nodes(kids.apply(i)) for i in range(kids.size())]
    most, open_ = max((b[0] for b in below), default=0), max((b[1] for b in below), default=0)
    found = 0 if "Exchange" in name else open_ + (name == "MapInArrow")
    return max(most, found), found


def test_one_python_worker_a_task(spark, monkeypatch):
    seen, keep = {}, P.keep
    monkeypatch.setattr(P, "keep", lambda df, name: (seen.setdefault(name, []).append(python_nodes(df._jdf.queryExecution().executedPlan())[0]), keep(df, name))[1])
    rows = corpus()
    assert run(spark, rows) == brute(rows)
    assert {"sets", "stars", "nodes", "edges"} <= set(seen) and max(map(max, seen.values())) == 1
