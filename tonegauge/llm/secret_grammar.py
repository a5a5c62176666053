"""Secret scans: fixed patterns, and formats learned by grammar inference.

Base spans are those of three fixed patterns.  What they match are labelled credentials; from a
bounded sample of them (``PER_KIND`` distinct values a kind in hash order, at most ``LONGEST``
characters) one probabilistic automaton per kind is inferred: a prefix tree of the values whose
states are merged where their futures are statistically compatible (Hoeffding bounds on every
transition and ending, the ALERGIA test).  The first ``HEAD`` characters of a value are symbols of
their own, later ones stand for their character class.

Then every candidate of every whole text is scored by its likelihood under each automaton, in bits a
character over a random character.  Candidates are the runs of credential characters and their parts:
a part begins at the run's beginning, after a cut (``CUTS``) or after leading marks, and ends at its
end, at a cut, after ``=`` or before trailing marks.  They touch no base span and have ``SHORTEST``
characters, the least of any labelled value, or more.  A candidate becomes a ``format`` span if it
scores as the labelled values do (at least their ``QUANTILE``) and at least that share of them is like
it in holding letters, digits or both.  Of candidates that overlap, the longest counts, then the first.

Defined results: null text is empty and has no spans; rows with equal ``doc_id`` are scanned one
by one; without labelled credentials only base spans (none) are returned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.store import keep

# Patterns, kinds and least lengths of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the longest runs of [0-9a-f]+ with 32 characters or more
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
SHORTEST = min(LEAST_ASSIGN, LEAST_ACCESS)
KINDS = ("assign", "access", "hex", "format")

PER_KIND, LONGEST, HEAD, ALPHA, QUANTILE = 1000, 256, 4, 0.05, 0.02
CUTS, MARKS = "=/.", "=/.+_-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
_ALPHABET = 68
_CLASSES = {"d": 10, "h": 6, "l": 20, "u": 26}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def composition(value: str) -> tuple[bool, bool]:
    """(holds letters, holds digits)."""
    if value.isalpha():
        return True, False
    if value.isdigit():
        return False, True
    return any(c.isalpha() for c in value), any(c.isdigit() for c in value)


def formats(text: str, spans: list[tuple[int, int, int]], known: list[Grammar]) -> list[tuple[int, int]]:
    """Candidates outside the spans that one of the grammars takes."""
    out = []
    plain = set().union(*(g.like for g in known))
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        if (run.isalpha() and (True, False) not in plain) or (run.isdigit() and (False, True) not in plain):
            continue
        near = [(s - at, e - at) for s, _, e in spans if s < m.end() and at < e]
        starts, ends = [0], {len(run)}
        if not run.isalnum():
            starts = sorted({0, len(run) - len(run.lstrip(MARKS)), *(i + 1 for i, c in enumerate(run) if c in CUTS)})
            ends |= {len(run.rstrip(MARKS)), *(i for i, c in enumerate(run) if c in CUTS), *(i + 1 for i, c in enumerate(run) if c == "=")}
        found = []
        for i in starts:
            # up to the next base span
            stop = min((max(s, i) for s, e in near if e > i), default=len(run))
            if stop - i >= SHORTEST:
                for g in known:
                    found += [(i, j) for j, bits in g.automaton.ends(run, i, stop, ends) if j - i >= SHORTEST and bits >= g.least and composition(run[i:j]) in g.like]
        taken: list[tuple[int, int]] = []
        for i, j in sorted(set(found), key=lambda x: (x[0] - x[1], x[0])):
            if all(j <= s or e <= i for s, e in taken):
                taken.append((i, j))
        out += [(at + i, at + j) for i, j in taken]
    return out


def symbols(value: str) -> list[str]:
    """A value's symbols: characters of its head, then classes (other characters stay)."""
    out = list(value[:HEAD])
    for c in value[HEAD:]:
        out.append("d" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if c.islower() else "u" if c.isupper() else c)
    # a class and a character of the same name are different symbols
    return [s if i < HEAD else "<" + s for i, s in enumerate(out)]


#: symbols of the characters behind the head
_SYMBOL = {c: symbols("0" * HEAD + c)[-1] for c in map(chr, range(128))}


class Automaton:
    """A probabilistic automaton inferred from strings of symbols."""

    def __init__(self, values: list[list[str]], alpha: float = ALPHA):
        self.count, self.ended, self.next = [0], [0], [{}]
        self.passed: list[dict[str, int]] = [{}]
        for v in values:
            n = 0
            self.count[0] += 1
            for s in v:
                if s not in self.next[n]:
                    self.next[n][s] = len(self.count)
                    self.count.append(0)
                    self.ended.append(0)
                    self.next.append({})
                    self.passed.append({})
                self.passed[n][s] = self.passed[n].get(s, 0) + 1
                n = self.next[n][s]
                self.count[n] += 1
            self.ended[n] += 1
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            n1, n2 = self.count[a], self.count[b]
            if self._differ(self.ended[a], n1, self.ended[b], n2):
                return False
            for s in self.passed[a].keys() | self.passed[b].keys():
                if self._differ(self.passed[a].get(s, 0), n1, self.passed[b].get(s, 0), n2):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the subtree of ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.ended[a] += self.ended[b]
            for s, c in self.passed[b].items():
                self.passed[a][s] = self.passed[a].get(s, 0) + c
                if s in self.next[a]:
                    todo.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def _merge(self) -> None:
        red = [0]
        while True:
            own = set(red)
            blue = [(self.count[b], a, s, b) for a in red for s, b in self.next[a].items() if b not in own]
            if not blue:
                return
            # the best known state first; ties in a fixed order
            _, a, s, b = max(blue, key=lambda x: (x[0], -x[1], x[2]))
            for r in red:
                if self._compatible(r, b):
                    self.next[a][s] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)

    def bits(self, value: str) -> float:
        """Mean log-likelihood of the value's characters, in bits over a random character."""
        n, total = 0, 0.0
        for i, s in enumerate(symbols(value)):
            if s not in self.next[n]:
                return -math.inf
            size = 1 if i < HEAD else _CLASSES.get(s[1:], 1)
            total += math.log2(self.passed[n][s] / self.count[n] / size * _ALPHABET)
            n = self.next[n][s]
        return total / max(1, len(value)) if self.ended[n] else -math.inf

    def ends(self, run: str, start: int, stop: int, ends: set[int]) -> list[tuple[int, float]]:
        """(end, ``bits``) of the values that begin at ``start`` and end at one of ``ends``."""
        out, n, total = [], 0, 0.0
        for i in range(start, stop):
            c = run[i]
            if i - start >= HEAD:
                c = _SYMBOL[c]
            to = self.next[n].get(c)
            if to is None:
                break
            total += math.log2(self.passed[n][c] / self.count[n] / _CLASSES.get(c[1:], 1) * _ALPHABET)
            n = to
            if i + 1 in ends and self.ended[n]:
                out.append((i + 1, total / (i + 1 - start)))
        return out


class Grammar(NamedTuple):
    """An automaton, the least score, and what labelled values hold."""

    automaton: Automaton
    least: float
    like: set[tuple[bool, bool]]


def labelled_credentials(docs: DataFrame) -> dict[str, list[str]]:
    """Sampled values of the base spans by kind."""
    def run(batches):
        for batch in batches:
            out = set()
            for text in batch.column("text").to_pylist():
                for start, kind, end in base_spans(text or ""):
                    value = text[start:end]
                    if kind == 0:
                        value = ASSIGN.match(value)[2]
                    if len(value) <= LONGEST:
                        out.add((KINDS[kind], value))
            kinds, values = zip(*sorted(out)) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    found = keep(docs.select("text").mapInArrow(run, "kind string, value string").distinct(), "credentials")
    return {k: [r.value for r in found.filter(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(PER_KIND).collect()] for k in KINDS[:3]}


def infer(labelled: dict[str, list[str]]) -> list[Grammar]:
    """The grammar of each kind; its least score is from an automaton of one half and the other half."""
    out = []
    for kind in KINDS[:3]:
        values = labelled.get(kind, [])
        if len(values) < 4:
            continue
        half = Automaton([symbols(v) for v in values[::2]])
        held = [s for s in (half.bits(v) for v in values[1::2]) if s > -math.inf]
        if held:
            like = Counter(composition(v) for v in values)
            out.append(Grammar(Automaton([symbols(v) for v in values]), float(np.quantile(held, QUANTILE)),
                               {k for k, n in like.items() if n >= QUANTILE * len(values)}))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    grammars = docs.sparkSession.sparkContext.broadcast(infer(labelled_credentials(docs)))

    def joined(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches):
        known = grammars.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = [(s, 3, e) for s, e in formats(text, base, known)] if known else []
                kinds = [k for _, k, _ in base]
                out.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
