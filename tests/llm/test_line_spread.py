import random
from collections import defaultdict

from tonegauge.llm import line_spread as L

SCHEMA = "doc_id long, text string, source string, line string, n_lines int"


def run(spark, rows, sites):
    df = spark.createDataFrame([(d, t, s, "x", 9) for d, t, s in rows], SCHEMA).repartition(3)
    return sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_removed, r.line) for r in L.remove_spread_lines(df, sites).collect())


def brute(rows, sites):
    where, first = defaultdict(set), {}
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            x = x.strip(" ")
            if x:
                where[x].add(s)
                if d is not None:
                    first[x] = min(first.get(x, d), d)
    wide = {x for x, s in where.items() if len(s - {None}) >= sites}
    out = []
    for d, t, s in rows:
        parts = t.split("\n") if t is not None else []
        left = [x for x in parts if x.strip(" ") not in wide or first[x.strip(" ")] == d]
        out.append((str(d), str(t) if t is None else "\n".join(left), len(parts), len(parts) - len(left), "x"))
    return sorted(out)


def test_equals_brute_force(spark):
    r = random.Random(4)
    pool = [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice([" ", ""]) + r.choice(pool[: r.randint(1, 30)]) for _ in range(r.randint(0, 9))), r.choice([f"s{k}" for k in range(12)] + [None])) for i in range(150)]
    rows += [(500, None, "s1"), (501, "", "s1"), (502, "\n\n", "s2"), (503, "line 1\n" * 5000, "s3"), (None, "line 1\nown", "s4"), (2, "line 1", "s5"), (2, "line 1", "s5")]
    for sites in (3, 10, 12):
        assert run(spark, rows, sites) == brute(rows, sites)


def test_empty_table(spark):
    assert run(spark, [], 3) == []
