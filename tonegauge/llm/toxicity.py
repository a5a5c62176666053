"""Toxicity by class-conditional Kneser-Ney models.

Words are runs of letters and digits.  Each class (toxic, ordinary) has an interpolated Kneser-Ney model:

* bigrams: documents of the pair in the class, less a discount, over those of its first word; what the
  discounts take goes to the pair's shared counts (in how many classes it stands), and these hand on to
* words: number of different words before the word in the class, less a discount; what that takes goes to the
  word's shared counts (in how many classes it stands, and how often in all documents: a written table with every
  word of the corpus), tilted by
* spelling: byte n-grams of the class's different words, each order backing off to the next shorter one and
  the shortest to counts that both classes share.  So a word that no labelled text holds is judged by its form.

Discounts are the modified Kneser-Ney ones, from each class's counts of counts; no expression is left out and no
count is cut.  Both classes hand the same weight down, so whatever they leave to shared counts is even between them.

The difference of the two log-likelihoods, divided by the number of words, is taken over the whole text, over its
strongest windows of ``WINDOWS`` words and over its ``STRONGEST`` different words (never one alone; a shorter text
counts as filled up with even words).  A logistic fit of these means and the logarithm of the length, on labelled
documents that the models did not see, gives the probability.

Bounds (documented parameters): ``PER_CLASS`` labelled documents of each class in hash order teach (one of each
family of near copies), a quarter of them calibrates.  Tables of that sample go to every task.  The corpus counts and
the scores cover every document.

Defined results: null or empty text scores as a text without evidence; rows with equal ``doc_id``
are scored one by one; without labels of both classes every score is 0; labels other than 0 and 1
and null ids teach nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.arrowtext import _FOLD, ALNUM, U, chunks, mix, run_hashes, tidy, utf8, word_hashes, words
from tonegauge.llm.store import keep

PER_CLASS, WINDOWS, STRONGEST = 4000, (4, 16, 64), (2, 4, 8)
#: evidence from which a word counts among a text's strongest
_STRONG = 0.25
#: bytes of the longest spelling n-gram, and the most that spelling and any one word may say
SPELL, MOST_SPELLING, MOST_EVIDENCE = 6, 4.0, 8.0
RIDGE = 0.3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
_MINHASHES, _BAND, _ALIKE = 32, 4, 0.8
_PART, _HELD = 1 << 18, 1 << 19


def remainder():
    """crc32 of the id's text modulo the folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def _bigram(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * U(0x9E3779B97F4A7C15) + w)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, fold) of distinct labelled training texts, and the number of labels per class."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != HELD_OUT))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n = PER_CLASS
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.filter("toxic = 0").orderBy(*order).limit(n).unionByName(known.filter("toxic = 1").orderBy(*order).limit(n))
    texts = (docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")
             .groupBy(F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    texts = keep(texts, "sample")
    first = _one_of_each_family(texts)
    return texts.join(F.broadcast(first), "key", "left_semi").select("text", "toxic", F.pmod("key", F.lit(4)).alias("fold")), totals


def _one_of_each_family(texts: DataFrame) -> DataFrame:
    """Keys of sampled texts that are no near copy of a text of their class with a smaller key.

    Near copies would pass for independent evidence of whatever words they share.  Texts that agree on
    all minhashes of a band are compared, those that agree on ``_ALIKE`` of all minhashes are near copies.
    """
    def run(batches):
        seeds = mix(np.arange(_MINHASHES, dtype=U))
        for batch in batches:
            for b in chunks(batch, "text", _PART):
                h, wo = word_hashes(b.column("text"), ALNUM)
                runs = run_hashes(h, 3)
                out = [[int((mix(x ^ s).min()).view(np.int64)) for s in seeds] if len(x := runs[i: max(i, j - 2)]) else [] for i, j in zip(wo[:-1], wo[1:])]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("toxic").cast(pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["key", "toxic", "m"])

    signed = keep(texts.select("key", "text", "toxic").mapInArrow(tidy(run), "key long, toxic long, m array<long>"), "signed")
    bands = F.array(*[F.xxhash64(F.lit(i), F.slice("m", i + 1, _BAND)) for i in range(0, _MINHASHES, _BAND)])
    each = signed.filter(F.size("m") > 0).withColumn("band", F.explode(bands))
    first = each.groupBy("toxic", "band").agg(F.min_by(F.struct("key", "m"), "key").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    alike = F.aggregate(F.zip_with("m", "low.m", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    copies = each.join(F.broadcast(first), ["toxic", "band"]).filter((F.col("low.key") < F.col("key")) & (alike >= _ALIKE * _MINHASHES))
    return signed.select("key").join(copies.select("key").distinct(), "key", "left_anti")


def _distinct(row, h, w):
    """The distinct (row, h, w) in sorted order."""
    order = np.lexsort((w, h, row))
    r, h, w = row[order], h[order], w[order]
    new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1]))) if len(r) else np.zeros(0, int)
    return r[new], h[new], w[new]


def _pair_counts(texts: DataFrame) -> DataFrame:
    """(h, w, d0, d1): numbers of documents of each bigram by class."""
    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", _PART):
                all_words, wo = word_hashes(b.column("text"), ALNUM)
                toxic = b.column("toxic").to_numpy(zero_copy_only=False)
                r, h, w = _distinct(np.repeat(np.arange(len(toxic)), np.diff(wo)), _heads(all_words, wo), all_words)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), pa.array(toxic[r].astype(np.int64))], ["h", "w", "toxic"])
    rows = texts.mapInArrow(tidy(run), "h long, w long, toxic long")
    return rows.groupBy("h", "w").agg(*[F.count_if(F.col("toxic") == c).alias(f"d{c}") for c in (0, 1)])


def _heads(hashes: np.ndarray, wo: np.ndarray) -> np.ndarray:
    """The word before each word, 0 at a text's beginning."""
    head = np.append(U(0), hashes[:-1])[: len(hashes)]
    head[wo[:-1][wo[:-1] < wo[1:]]] = U(0)
    return head


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    rows = df.select(*names).toArrow()
    return [rows.column(c).to_numpy() for c in names]


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(w, n): how often each word stands in all documents."""
    def rows(keys, counts):
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for b in chunks(batch, "text", _PART):
                k, n = np.unique(word_hashes(b.column("text"), ALNUM)[0], return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > _HELD:
                    keys, counts = ([x] for x in rows(keys, counts))
                    held = len(keys[0])
                    if held > _HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["w", "n"])
                        keys, counts, held = [], [], 0
        if held:
            k, n = rows(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["w", "n"])

    return docs.select("text").mapInArrow(tidy(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _types(texts: DataFrame) -> DataFrame:
    """(w, word, c0, c1): the different words, their bytes and whether a class holds them."""
    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", _PART):
                raw, off = utf8(b.column("text"))
                h, wo, start, length = words(raw, off, ALNUM)
                toxic = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False), np.diff(wo))
                _, first = np.unique(np.stack([h, toxic.astype(U)]), axis=1, return_index=True) if len(h) else (None, np.zeros(0, np.int64))
                low = _FOLD[raw].tobytes()
                spelled = [low[i: i + n] for i, n in zip(start[first].tolist(), length[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(spelled, pa.binary()), pa.array(toxic[first].astype(np.int64))], ["w", "word", "toxic"])

    rows = texts.mapInArrow(tidy(run), "w long, word binary, toxic long")
    return rows.groupBy("w", "word").agg(*[F.max((F.col("toxic") == c).cast("long")).alias(f"c{c}") for c in (0, 1)])


def ngrams(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(per order 1 to ``SPELL`` the n-gram that ends at each byte, how many bytes it may reach back, its word).

    A word's bytes stand between 1 and 2; an n-gram is its bytes packed into a number, under its order."""
    size = length + 2
    off = np.append(0, np.cumsum(size))
    x = np.full(off[-1], 2, U)
    x[off[:-1]] = 1
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(off[-1]) - off[owner]
    inner = (place > 0) & (place < size[owner] - 1)
    x[inner] = _FOLD[raw[start[owner[inner]] + place[inner] - 1]]
    out, packed = [], np.zeros(len(x), U)
    for m in range(1, SPELL + 1):
        back = np.append(np.zeros(m - 1, U), x)[: len(x)]
        packed = packed | (back << U(8 * (m - 1)))
        out.append(packed | U(m << 56))
    return out, place, owner


def _gram_counts(types: DataFrame) -> DataFrame:
    """(order, gram, ctx, g0, g1): different words of each class that hold a spelling n-gram, with repeats."""
    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column("word"))
            flags = [batch.column(f"c{c}").to_numpy(zero_copy_only=False) for c in (0, 1)]
            grams, place, owner = ngrams(raw, off[:-1], np.diff(off))
            for m in range(1, SPELL + 1):
                at = np.flatnonzero(place >= max(1, m - 1))
                ctx = grams[m - 2][at - 1] if m > 1 else np.zeros(len(at), U)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), m)), pa.array(grams[m - 1][at].view(np.int64)), pa.array(ctx.view(np.int64)),
                     *[pa.array(f[owner[at]].astype(np.int64)) for f in flags]], ["m", "gram", "ctx", "g0", "g1"])

    rows = types.mapInArrow(tidy(run), "m long, gram long, ctx long, g0 long, g1 long")
    return rows.groupBy("m", "gram", "ctx").agg(F.sum("g0").alias("g0"), F.sum("g1").alias("g1"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n = np.bincount(np.minimum(counts.astype(np.int64), 5), minlength=6)[:6].astype(float) + 0.5
    y = n[1] / (n[1] + 2 * n[2])
    d = [0.0, *[i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]]
    return np.clip(d, [0.0, 0.1, 0.1, 0.1], [0.0, 0.95, 1.9, 2.8])


def _less(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(counts - d[np.minimum(counts, 3).astype(np.int64)], 0)


def spelling(m: np.ndarray, gram: np.ndarray, ctx: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
    """``grams`` with ``gram_llr`` and contexts ``ctxs`` with ``ctx_llr`` (what leaving the context says)."""
    one = m == 1
    shared = g[:, one].sum(axis=0)
    keys, by = gram[one], np.argsort(gram[one])
    keys, p = keys[by], np.tile((shared[by] + 0.5) / (shared.sum() + 0.5 * len(by)), (2, 1))
    out = {"grams": [keys], "gram_llr": [np.zeros(len(keys))], "ctxs": [], "ctx_llr": []}
    for order in range(2, SPELL + 1):
        here = m == order
        by = np.argsort(gram[here])
        k, c, n = gram[here][by], ctx[here][by], g[:, here][:, by]
        ctxs, at = np.unique(c, return_inverse=True)
        left = np.stack([_less(x, discounts(x)) for x in n])
        total = np.stack([np.bincount(at, weights=x, minlength=len(ctxs)) for x in n])
        kept = np.stack([np.bincount(at, weights=x, minlength=len(ctxs)) for x in left])
        hand = np.where(total > 0, 1 - kept / np.maximum(total, 1), 1.0)
        # the n-gram without its first byte, under the order before
        short = (k & U((1 << 8 * (order - 1)) - 1)) | U(order - 1 << 56)
        p = left / np.maximum(total[:, at], 1) + hand[:, at] * p[:, _find(keys, short)[0]]
        keys = k
        for name, value in (("grams", k), ("gram_llr", np.log(p[1] / p[0])), ("ctxs", ctxs), ("ctx_llr", np.log(np.maximum(hand[1], 1e-3) / np.maximum(hand[0], 1e-3)))):
            out[name].append(value)
    return {name: np.concatenate(parts) if parts else np.zeros(0) for name, parts in out.items()}


def spelled(model: dict[str, np.ndarray], raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the spelling of each word says: the difference of its two log-likelihoods."""
    if not len(start):
        return np.zeros(0)
    grams, place, owner = ngrams(raw, start, length)
    llr, open_ = np.zeros(len(place)), place > 0
    for m in range(SPELL, 0, -1):
        at = np.flatnonzero(open_ & (place >= m - 1))
        if m > 1:
            to, known = _find(model["grams"], grams[m - 1][at])
            llr[at[known]] += model["gram_llr"][to[known]]
            open_[at[known]] = False
            rest = at[~known]
            to, known = _find(model["ctxs"], grams[m - 2][rest - 1])
            llr[rest[known]] += model["ctx_llr"][to[known]]
    return np.clip(np.bincount(owner, weights=llr, minlength=len(start)), -MOST_SPELLING, MOST_SPELLING)


def _counts_of_counts(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Discounts of each column of counts."""
    n = df.agg(*[F.count_if(F.col(c) == i).alias(f"{c}_{i}") for c in columns for i in (1, 2, 3, 4)]).first()
    return [discounts(np.repeat(np.arange(1, 5), [n[f"{c}_{i}"] for i in (1, 2, 3, 4)])) for c in columns]


def _left(column: str, d: np.ndarray):
    """A count less its discount."""
    c = F.col(column)
    return F.when(c == 0, 0.0).otherwise(c - F.when(c == 1, float(d[1])).when(c == 2, float(d[2])).otherwise(float(d[3])))


def _evenly(left, own, lower):
    """Interpolation of the two classes' columns that hands down the larger of their two weights."""
    hand = F.greatest(*own)
    return [F.when(o < 1, x * (1 - hand) / (1 - o) + hand * y).otherwise(y) for x, o, y in zip(left, own, lower)]


def word_model(words_: DataFrame, size: int) -> DataFrame:
    """(w, p0, p1) of words with continuation counts ``k0`` and ``k1``, ``n`` of ``size`` corpus words and ``spell``."""
    d = _counts_of_counts(words_, ["k0", "k1"])
    kept = [_left(f"k{c}", d[c]) for c in (0, 1)]
    sums = words_.agg(*[F.coalesce(F.sum(f"k{c}"), F.lit(0)).alias(f"k{c}") for c in (0, 1)], *[F.coalesce(F.sum(kept[c]), F.lit(0.0)).alias(f"l{c}") for c in (0, 1)],
                      *[F.count_if(F.col(f"k{c}") > 0).alias(f"t{c}") for c in (0, 1)]).first()
    total = [max(sums[f"k{c}"], 1) for c in (0, 1)]
    shared = ((F.col("k0") > 0).cast("int") + (F.col("k1") > 0).cast("int") + F.col("n") / float(max(size, 1))) / float(sums.t0 + sums.t1 + 1)
    lower = [shared * 2 / (1 + F.exp(x)) for x in (F.col("spell"), -F.col("spell"))]
    p = _evenly([kept[c] / float(total[c]) for c in (0, 1)], [F.lit(1 - sums[f"l{c}"] / total[c]) for c in (0, 1)], lower)
    return words_.select("w", *[p[c].alias(f"p{c}") for c in (0, 1)])


def pair_model(pairs: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(h, w, llr): the evidence of each pair with ``d0`` and ``d1`` documents, ``probabilities`` those of its word."""
    d = _counts_of_counts(pairs, ["d0", "d1"])
    both = pairs.withColumn("classes", (F.col("d0") > 0).cast("int") + (F.col("d1") > 0).cast("int"))
    cut = float(min(_counts_of_counts(both, ["classes"])[0][1:3]))
    heads = both.groupBy("h").agg(*[F.sum(f"d{c}").alias(f"n{c}") for c in (0, 1)], *[F.sum(_left(f"d{c}", d[c])).alias(f"l{c}") for c in (0, 1)],
                                  F.sum("classes").alias("all"), F.count("*").alias("types"))
    rows = both.join(heads, "h").join(probabilities, "w")
    lower = [(F.col("classes") - cut) / F.col("all") + cut * F.col("types") / F.col("all") * F.col(f"p{c}") for c in (0, 1)]
    own = [F.when(F.col(f"n{c}") > 0, 1 - F.col(f"l{c}") / F.col(f"n{c}")).otherwise(1.0) for c in (0, 1)]
    p = _evenly([_left(f"d{c}", d[c]) / F.greatest(F.col(f"n{c}"), F.lit(1)) for c in (0, 1)], own, lower)
    return rows.select("h", "w", F.log(p[1] / p[0]).alias("llr"))


def fit(docs: DataFrame, texts: DataFrame) -> dict[str, np.ndarray]:
    """The sample's models as sorted tables of evidence: ``words`` with ``word_llr``, ``pairs`` with ``pair_llr``
    and those of :func:`spelling`."""
    taught = texts.filter("fold <> 0")
    pairs = keep(_pair_counts(taught), "pairs")
    types = keep(_types(taught), "types")
    grams = _columns(_gram_counts(types), "m", "gram", "ctx", "g0", "g1")
    model = spelling(grams[0], grams[1].view(U), grams[2].view(U), np.stack(grams[3:]))
    del grams
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def spell(batches):
        for batch in batches:
            raw, off = utf8(batch.column("word"))
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(spelled(sent.value, raw, off[:-1], np.diff(off)))], ["w", "spell"])

    def key(batches):
        for batch in batches:
            h, w = (batch.column(c).to_numpy().view(U) for c in ("h", "w"))
            yield pa.RecordBatch.from_arrays([pa.array(_bigram(h, w).view(np.int64)), batch.column("llr").cast(pa.float32())], ["key", "llr"])

    counts = pairs.groupBy("w").agg(*[F.count_if(F.col(f"d{c}") > 0).alias(f"k{c}") for c in (0, 1)])
    corpus = keep(corpus_counts(docs), "corpus")
    size = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first().words
    known = keep(counts.join(types.mapInArrow(spell, "w long, spell double").groupBy("w").agg(F.max("spell").alias("spell")), "w").join(corpus, "w"), "known")
    sent.unpersist()
    probabilities = keep(word_model(known, size), "words")
    w, llr = _columns(probabilities.select("w", F.log(F.col("p1") / F.col("p0")).cast("float").alias("llr")), "w", "llr")
    by = np.argsort(w.view(U))
    model |= {"words": w.view(U)[by], "word_llr": llr[by]}
    k, llr = _columns(pair_model(pairs, probabilities).mapInArrow(key, "key long, llr float"), "key", "llr")
    by = np.argsort(k.view(U))
    return model | {"pairs": k.view(U)[by], "pair_llr": llr[by]}


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, is it there)."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return at, table[at] == x


def evidence(model: dict[str, np.ndarray], column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(difference of the two log-likelihoods of every word of every text, the words, word offsets of the texts)."""
    raw, off = utf8(column)
    h, wo, start, length = words(raw, off, ALNUM)
    if not len(h):
        return np.zeros(0), h, np.zeros(len(off), np.int64)
    at, known = _find(model["words"], h)
    llr = np.where(known, model["word_llr"][at] if len(model["words"]) else 0.0, 0.0)
    new = np.flatnonzero(~known)
    if len(new):
        _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
        llr[new] = spelled(model, raw, start[new[first]], length[new[first]])[back]
    at, known = _find(model["pairs"], _bigram(_heads(h, wo), h))
    if known.any():
        llr = np.where(known, model["pair_llr"][at], llr)
    return np.clip(llr, -MOST_EVIDENCE, MOST_EVIDENCE), h, wo


def features(model: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """Per text the mean evidence of a word: in the whole text, in the strongest window of each size and of the
    strongest different words; and the logarithm of its length."""
    llr, h, wo = evidence(model, column)
    n = np.diff(wo)
    out = np.zeros((len(n), 2 + len(WINDOWS) + len(STRONGEST)))
    if len(llr):
        full = np.flatnonzero(n)
        run = np.append(0.0, np.cumsum(llr))
        out[:, 0] = (run[wo[1:]] - run[wo[:-1]]) / np.maximum(n, WINDOWS[0])
        row = np.repeat(np.arange(len(n)), n)
        end, first = np.arange(1, len(llr) + 1), wo[row]
        for i, window in enumerate(WINDOWS, 1):
            mean = (run[end] - run[np.maximum(end - window, first)]) / window
            out[full, i] = np.maximum.reduceat(mean, wo[:-1][full])
        strong = np.flatnonzero(llr > _STRONG)
        e, r, w = llr[strong], row[strong], h[strong]
        by = np.lexsort((-e, w, r))
        e, r, w = e[by], r[by], w[by]
        once = np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1])) if len(r) else np.zeros(0, bool)
        e, r = e[once], r[once]
        by = np.lexsort((-e, r))
        e, r = e[by], r[by]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        for i, most in enumerate(STRONGEST, 1 + len(WINDOWS)):
            out[:, i] = np.bincount(r[rank < most], weights=e[rank < most], minlength=len(n)) / most
        out[:, -1] = np.log1p(n)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the features (intercept first): a weighted logistic fit by halved Newton steps, with a ridge on
    the features in units of their spread."""
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    ridge = np.append(1e-6, np.full(x.shape[1], RIDGE))

    def loss(b):
        z = a @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * b * b).sum()

    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (weight * (y - p)) - ridge * b)
        while np.abs(step).max() > 1e-9 and loss(b + step) > loss(b):
            step = step / 2
        b = b + step
        if np.abs(step).max() <= 1e-9:
            break
    return np.append(b[0] - (b[1:] * centre / spread).sum(), b[1:] / spread)


def probability(fitted: tuple, column: pa.Array) -> np.ndarray:
    """Score of each text by what :func:`train` gives."""
    model, line, longest = fitted
    x = features(model.value, column)
    x[:, -1] = np.minimum(x[:, -1], longest)  # no claim beyond the lengths of the calibration
    return 1 / (1 + np.exp(-np.clip(line[0] + x @ line[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """(evidence tables, broadcast once; weights of the features; longest calibrated length), or None without labels
    of both classes."""
    spark = docs.sparkSession
    texts, totals = labelled_sample(docs, labels)
    texts = keep(texts, "sample")
    if texts.select("toxic").distinct().count() < 2:
        return None
    sent = spark.sparkContext.broadcast(fit(docs, texts))

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", _PART):
                yield pa.RecordBatch.from_arrays([pa.array(list(features(sent.value, b.column("text"))), pa.list_(pa.float64())), b.column("toxic").cast(pa.int64())], ["x", "toxic"])

    rows = texts.filter("fold = 0").select("text", "toxic").mapInArrow(tidy(run), "x array<double>, toxic long").collect()
    y = np.array([r.toxic for r in rows], float)
    line = np.zeros(3 + len(WINDOWS) + len(STRONGEST))  # too few labels to calibrate by
    line[[0, 1 + len(WINDOWS) + 1]] = -6.0, 1.5
    longest = max((r.x[-1] for r in rows), default=0.0)
    if len(set(y)) == 2:
        x = np.array([r.x for r in rows], float)
        order = np.lexsort((*x.T, y))
        x, y = x[order], y[order]
        share = {c: totals[c] / max(1, (y == c).sum()) for c in (0, 1)}
        weight = np.where(y == 1, share[1], share[0])
        line = calibrate(x, y, weight * len(y) / weight.sum())
    return sent, line, longest


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` (probability of toxic) and ``predicted`` added."""
    model = train(docs, labels)
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))

    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", _PART):
                p = probability(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    kept = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(tidy(run), f"{schema}, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; the text stays in the scoring task."""
    model = train(docs, labels)
    rows = docs.select("doc_id", "text")
    if model is None:
        rows = rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    else:
        def run(batches):
            for batch in batches:
                for part in chunks(batch, "text", _PART):
                    p = probability(model, part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                                     ["doc_id", "score", "predicted"])
        rows = rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int")
    return rows.select("doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
