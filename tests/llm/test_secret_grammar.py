import hashlib
import random
import re

from tonegauge.llm import secret_grammar as S

SCHEMA = "doc_id long, text string, kind string, value string, spans string"


def brute(text):
    out = []
    keys = "password|passwd|secret|token|api_?key"
    cased = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in keys)
    for m in re.finditer(f"({cased})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def rows(n=120):
    r = random.Random(3)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    out = []
    for i in range(n):
        w = ["plain", "words", "é", "1234567890123456789012", "verylongplainwordwithoutdigits"] * r.randint(0, 4)
        w.insert(r.randint(0, len(w)), r.choice([f'token = "{hexes(40)}"', f"API_KEY:{upper(20)}", "AKIA" + upper(16), hexes(r.choice([31, 32, 64])), "password: short", "Secret='aaaabbbb'", "toKen=AKIA" + upper(16)]))
        out.append((i, " ".join(w)))
    extra = [None, "", "token=Key12345678", "paſsword=abcdefgh", "token token=abcdefgh=token=12345678", "a" * 200000 + " token=" + "b" * 100000, "AKIAAKIA" + "A" * 12, hexes(31), "x " * 50000 + hexes(40), hexes(40)]
    return out + [(900 + i, t) for i, t in enumerate(extra)]


def run(spark, data):
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in data], SCHEMA).repartition(3)
    return S.scan(df).collect()


def test_base_spans_equal_brute_force(spark):
    data = rows()
    got = run(spark, data)
    assert len(got) == len(data)
    text = dict(data)
    for r in got:
        base = brute(text[r.doc_id] or "")
        join = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(join.encode()).hexdigest()
        kept = [x for x in r.spans.split(",") if x and not x.startswith("format")]
        assert ",".join(kept) == join
        assert "verylongplain" not in "".join((text[r.doc_id] or "")[int(s): int(e)] for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "format")


def test_learned_formats(spark):
    data = rows(300)
    r = random.Random(8)
    new = "".join(r.choice("0123456789abcdef") for _ in range(30))
    got = {x.doc_id: x.spans for x in run(spark, data + [(5000, f"see {new} there"), (5001, "see an0therOrd1nary.name/with-dots there")])}
    assert got[5000] == f"format:4:{4 + len(new)}"
    assert got[5001] == ""


def test_automaton_merges_and_scores():
    r = random.Random(1)
    values = ["ab1_" + "".join(r.choice("0123456789") for _ in range(r.randint(20, 30))) for _ in range(300)]
    a = S.Automaton([S.symbols(v) for v in values])
    assert a.bits("ab1_" + "7" * 25) > 2
    assert a.bits("xb1_" + "7" * 25) == a.bits("ab1_" + "z" * 25) == float("-inf")


def test_no_credentials_and_empty_table(spark):
    assert [(x.n_hex, x.spans) for x in run(spark, [(1, "nothing here at all")])] == [(0, "")]
    assert run(spark, []) == []


def test_parts_of_runs_and_short_values_are_scored(spark):
    r = random.Random(11)
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, digits, letters = "0123456789abcdef", "0123456789", "QXZJKVW"
    data = [(i, f"token={of(letters, 8)}" if i % 3 else f"api_key: {of(digits, 12)}") for i in range(400)]
    data += [(1000 + i, of(hexes, r.choice([32, 40]))) for i in range(400)]
    key, pin, word = of(hexes, 30), of(digits, 12), of(letters, 8)
    texts = {f"auth={key}": (5, 35), f"path/{key} x": (5, 35), f"ends with {key}.": (10, 40), f"see {key}- or": (4, 34), f"pin {pin} here": (4, 16),
             f"so {word}.": (3, 11), "plainwords anotherword only.here and/there": None}
    got = {x.doc_id: x.spans for x in run(spark, data + [(5000 + i, t) for i, t in enumerate(texts)])}
    for i, (t, want) in enumerate(texts.items()):
        assert got[5000 + i] == (f"format:{want[0]}:{want[1]}" if want else ""), t
