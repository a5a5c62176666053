import random
import re
from collections import defaultdict

import pytest

from tonegauge.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, target string, rank int"


def make(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", 0) for d, t, s in rows], SCHEMA).repartition(3)


def targets(sizes):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check(spark, rows, block):
    got = M.mix_sources(make(spark, rows), block).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    total = defaultdict(int)
    for i, (_, _, s) in enumerate(rows):
        total[s] += size[i]
    want = targets(dict(total))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == total[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 0.51
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), size[i]) for i, (d, _, _) in enumerate(rows))
    return sorted((str(r.doc_id), r.size, r.taken) for r in got)


@pytest.mark.parametrize("block", [7, 64])
def test_targets_and_reruns(spark, block):
    r = random.Random(block)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 60, 300]))), r.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(200)]
    rows += [(900, None, "a"), (901, " \t\n", "only blank"), (902, "x " * 5000, "b"), (None, "p q", None), (3, "s t", "a"), (3, "s t", "a")]
    assert check(spark, rows, block) == check(spark, rows, block)


def test_schedule_spreads_each_source(spark):
    rows = [(i, "w " * 100, s) for i, s in enumerate("aaaaabbbbc" * 5)]
    df = make(spark, rows)
    t = M.source_targets(M.document_sizes(df))
    slots = M.schedule(t, 10).orderBy("slot").collect()
    for s in {x.sid for x in slots}:
        own = [i for i, x in enumerate(slots) if x.sid == s]
        assert [slots[i]["rank"] for i in own] == list(range(len(own)))
        gap = len(slots) / len(own)
        assert max(abs(place - (k + 0.5) * gap) for k, place in enumerate(own)) <= 6 * gap + 6


def test_one_source_and_empty_table(spark):
    check(spark, [(1, "a b c", None), (2, "d", None)], 2)
    assert M.mix_sources(make(spark, [])).count() == 0
