import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tonegauge.llm import periodic_runs as P
from tonegauge.llm.queries import op13_periodic_runs

SCHEMA = "doc_id long, text string, n int, start string, runs int, doc string, kind string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 0, "s", 1, "d", "tile") for i, t in rows], SCHEMA).repartition(3)


def brute_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found[i, j + p] = min(p, found.get((i, j + p), p))
            i = max(i + 1, j)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute(doc_id, text, shape=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if shape and doc_id is not None and n and h % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def invented(seed):
    r = random.Random(seed)
    n, k, words = r.choice([5, 24, 80, 400, 1500, 4000]), r.choice([1, 2, 3, 500]), []
    while len(words) < n:
        if r.random() < 0.5:
            words += [f"w{r.randrange(k)}" for _ in range(r.randrange(1, 60))]
        else:
            q = r.choice([1, 2, 7, 8, 15, 16, 17, 31, 32, 63, 64, r.randrange(1, 300)])
            block = [f"w{r.randrange(k * 5)}" for _ in range(q)]
            words += (block * 9)[: r.randrange(1, q * 9 + 1)]
    return r.choice([" ", "\n", "\t  "]).join(words[:n])


def check(spark, rows):
    got = sorted((tuple(r) for r in P.periodic_runs(make(spark, rows)).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t in rows), key=repr)


def test_against_brute_force(spark):
    check(spark, [(i, invented(i)) for i in range(150)])


@pytest.mark.parametrize("tile", [64, 1 << 20])
def test_tiles_do_not_matter(spark, monkeypatch, tile):
    for s in range(100):
        ids = P.word_ids(invented(s).encode().split())
        found = set()
        monkeypatch.setattr(P, "TILE", tile)
        for step, bounds in P.suspects(ids):
            size = max(tile, 8 * step)
            for t in set((bounds // size).tolist()):
                lo, hi = max(0, t * size - step), min(len(ids), (t + 1) * size + 3 * step)
                at = (bounds[bounds // size == t] - lo).tolist()
                found |= {(f"d{s}", p, a + lo, b + lo) for p, a, b in P.solve_tile(ids[lo:hi].tolist(), at, step, (lo == 0, hi == len(ids)))}
        if s % 20 == 0:
            frame = spark.createDataFrame(sorted(found), "doc string, period long, start long, end long")
            assert sorted((r.start, r.length, r.period) for r in P.stitch(frame).collect()) == brute_runs(ids.tolist())
        whole = {(a, b) for a, n, _ in brute_runs(ids.tolist()) for b in [a + n]}
        assert all(any(a <= x[2] and x[3] <= b for x in found) for a, b in whole)


def test_edges(spark):
    same = "a b c d e f g h " * 4
    tied = " ".join(["x"] * 30 + ["y"] * 30)
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (None, same), (None, None), (30, same), (30, same), (30, same + "z"), (31, tied),
                  (32, "a b " * 12), (33, ("a b " * 12)[:-3]), (34, "A a " * 20), (35, "é x y " * 40), (36, "ab\x0bc\x0cd " * 30)])
    assert P.periodic_runs(make(spark, [])).collect() == []


def test_long_documents_spread(spark):
    word, pair = " ".join(["w"] * 30000), " ".join(["u v"] * 20000)
    r = random.Random(3)
    block = [f"k{r.randrange(900)}" for _ in range(5000)]
    rows = [(7, word), (8, pair), (9, " ".join(block * 4))]
    got = {r.doc_id: r for r in P.periodic_runs(make(spark, rows), lambda _, words: words).collect()}
    assert [(got[i].n_runs, got[i].start, got[i].length, got[i].period) for i in (7, 8)] == [(1, 0, 30000, 1), (1, 0, 40000, 2)]
    assert (got[9].start, got[9].length, got[9].period) == (0, 20000, 5000)
    tiles = P.parts_of(make(spark, rows), lambda _, words: words).filter("kind = 'tile'")
    assert tiles.groupBy("doc").count().agg({"count": "max"}).first()[0] > 100  # one document, many rows to deal out
    assert tiles.selectExpr("max(length(ids) / bytes / greatest(octave * 8, 512)) AS x").first().x <= 1.5


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, sf).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t in docs), key=repr)
