"""Exact Jaccard join of 5-word shingle sets with PartEnum signatures.

The signature scheme
    Sets are put into size bands ``[l, floor(l / t)]``; two sets with Jaccard >= ``t`` lie in one
    band or in adjacent ones.  Instance ``m`` handles bands ``m - 1`` and ``m``: there the sets
    differ in at most ``k = floor((1 - t) / (1 + t) * 2 r)`` features.  The feature domain (64-bit
    hashes) is cut into ``n1 > k`` equal ranges.  At most ``k`` ranges hold a difference, so a set
    with more than ``k`` non-empty ranges shares the whole content of at least one of them with
    each partner.  A signature is the hash of one non-empty range's content.  A set with too few
    non-empty ranges also signs its empty ones, so no pair is lost.

Frequent features
    Features of passages that many documents hold make weak signatures.  The frequent shingles of
    a bounded sample of documents are left out of the domain.  This is lossless for any choice of
    features: on the rest the sets still differ in at most ``k`` features.  A set left with at most
    ``k`` non-empty ranges signs the full domain as well, in a name space of its own.

The join
    Signatures travel as packed binary blocks per bucket; documents under one signature are linked
    to the smallest id (a star, never all pairs).  Parity bitmaps, whose difference is a lower
    bound of the sets' difference, drop most pairs; the rest is verified on whole sets.  A second
    star takes another centre.  Then what shares a signature and still lies in different
    components is compared: pairs in small groups, blocks of bitmaps in large ones, so no link
    between components is lost.  Identical sets are collapsed before, by a 64-bit key of the set.

Defined results: null, empty or blank text has ``n_shingles`` 0 and is its own component; fewer
words than the width form one shingle; rows with equal ``doc_id`` are one document; rows with
null ``doc_id`` are returned with a null component.  Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.arrowtext import U, chunks, mix, run_hashes, tidy, word_hashes
from tonegauge.llm.store import keep

WIDTH = 5
PERCENT = 80
#: documents sampled for frequent shingles, the sample count that makes one frequent, and the
#: most frequent shingles kept (8 bytes each in every task): bounds of an optimisation that is
#: lossless whatever it finds.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 8192, 4, 1 << 17
#: size of the Bloom filters that spare joins most texts (2 MB)
FILTER_BITS = 24
#: signatures aimed at per bucket; the number of buckets follows the input.
BUCKET = 250_000
#: groups of this many documents are compared in blocks of about ``BLOCK`` documents.
LARGE, BLOCK = 32, 256
#: most turns in which each open group compares its members with one of them
CENTRES = 1
#: signatures held at once, map slots compared at once, bytes of text worked on at once
_FLUSH, _SLICE, _PART = 1_000_000, 1 << 15, 1 << 19
#: edges that a task turns into stars at once
_EDGES = 1 << 18


def shingle_sets(column, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows in row order, number per row)."""
    h, wo = word_hashes(column)
    runs = run_hashes(h, width)
    parts, sizes = [], np.zeros(len(wo) - 1, np.int64)
    for i in range(len(wo) - 1):
        a, b = wo[i], wo[i + 1]
        if b - a >= width:
            x = np.sort(runs[a: b - width + 1])
            x = x[np.append(True, x[1:] != x[:-1])]
        elif b > a:
            x = run_hashes(h[a:b], b - a) ^ U(b - a)
        else:
            continue
        parts.append(x)
        sizes[i] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), sizes


def bands(percent: int, largest: int) -> np.ndarray:
    """Upper end of each size band, up to one that covers ``largest`` and the band after it."""
    out, low = [], 1
    while len(out) < 2 or out[-2] < largest:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.array(out, np.int64)


def most_apart(percent: int, upper: np.ndarray) -> np.ndarray:
    """Largest number of differing features of two similar sets of at most ``upper`` features."""
    t = Fraction(percent, 100)
    f = 2 * (1 - t) / (1 + t)
    return upper * f.numerator // f.denominator


def signatures(x: np.ndarray, sizes: np.ndarray, full: np.ndarray, percent: int, space: int):
    """Signatures of rows' sets.

    ``x``: sorted features of all rows, ``sizes`` of them per row; ``full``: size of each row's
    whole set, which gives its band.  Returns (signature, row, is the row short of ranges).
    """
    sig, row, short = [], [], np.zeros(len(sizes), bool)
    ends = bands(percent, int(full.max(initial=1)))
    band = np.searchsorted(ends, full)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    content = mix(x ^ U(0x5851F42D4C957F2D))
    for step in (0, 1):
        m = band + step
        k = most_apart(percent, ends[m])
        n1 = k + (k + 6) // 7 + 3
        active = (k > 0) & (full > 0)
        part = ((x >> U(32)) * n1[owner].astype(U)) >> U(32)
        if len(x):
            head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])))
            who, at = owner[head], part[head]
            filled = np.bincount(who, minlength=len(sizes))
            tag = (U(space) << U(60)) | (m[who].astype(U) << U(40)) | at
            s = mix(np.add.reduceat(content, head) ^ mix(tag))
            use = active[who]
            sig.append(s[use])
            row.append(who[use])
        else:
            filled, who, at = np.zeros(len(sizes), np.int64), np.zeros(0, np.int64), np.zeros(0, U)
        few = active & (filled <= k)
        short |= few
        if space:  # the last resort: empty ranges too
            for i in np.flatnonzero(few):
                gone = np.ones(n1[i], bool)
                gone[at[who == i].astype(np.int64)] = False
                tag = (U(3) << U(60)) | (U(m[i]) << U(40)) | np.flatnonzero(gone).astype(U)
                sig.append(mix(tag))
                row.append(np.full(len(tag), i))
    return (np.concatenate(sig) if sig else np.zeros(0, U)), (np.concatenate(row) if row else np.zeros(0, np.int64)), short


def _members(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def set_keys(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, key): the size and a 64-bit key of each document's set."""
    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", _PART):
                x, n = shingle_sets(b.column("text"), width)
                owner = np.repeat(np.arange(len(n)), n)
                key = np.zeros(len(n), U)
                np.add.at(key, owner, mix(x))
                key = mix(key ^ mix(n.astype(U)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(key.view(np.int64))],
                                                 ["doc_id", "n_shingles", "key"])
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, key long")


def frequent_shingles(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of shingles found in ``FREQUENT`` or more of ``SAMPLE_DOCS`` sampled documents."""
    sample = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", _PART):
                x, _ = shingle_sets(b.column("text"), width)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["f"])

    found = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")
             .mapInArrow(tidy(run), "f long").groupBy("f").count().filter(F.col("count") >= FREQUENT)
             .orderBy(F.desc("count"), "f").limit(MOST_FREQUENT))
    return np.sort(np.array([r.f for r in found.select("f").collect()], np.int64).view(U))


def _pack(ids: np.ndarray) -> tuple[bytes, str]:
    kind = "<u4" if len(ids) and ids.min() >= 0 and ids.max() < 1 << 32 else "<i8"
    return ids.astype(kind).tobytes(), kind


def id_filter(ids: DataFrame):
    """A broadcast Bloom filter of ``doc_id``: 2 ** FILTER_BITS bits whatever the number of ids.

    It only spares joins the texts that cannot match; what it lets through is joined exactly.
    """
    at = [F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(k)), 64 - FILTER_BITS) for k in range(2)]
    words = (ids.select(F.explode(F.array(*at)).alias("p")).groupBy(F.shiftright("p", 5).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 32 AS INT))")).alias("b")).toArrow())
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(table)


def _with_places(docs: DataFrame) -> DataFrame:
    at = [F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(k)), 64 - FILTER_BITS).alias(f"p{k}") for k in range(2)]
    return docs.select("doc_id", "text", *at)


def _passes(table: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    ok = np.ones(batch.num_rows, bool)
    for c in ("p0", "p1"):
        p = batch.column(c).to_numpy()
        ok &= (table[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
    return ok


def possible_rows(docs: DataFrame, table) -> DataFrame:
    """(doc_id, text) of the rows that pass the filter."""
    def run(batches):
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(_passes(table.value, batch)))
    return _with_places(docs).mapInArrow(tidy(run), "doc_id long, text string")


def _signature_blocks(docs: DataFrame, frequent, bits: int, percent: int, width: int, leave_out=None) -> DataFrame:
    """Rows (bucket, sigs, ids, kind): packed 32-bit signature remainders and document ids.

    Rows that pass the filter ``leave_out`` are not signed.
    """
    def run(batches):
        table = frequent.value
        for batch in batches:
            if leave_out is not None:
                batch = batch.filter(pa.array(~_passes(leave_out.value, batch)))
            for b in chunks(batch, "text", _PART):
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                x, full = shingle_sets(b.column("text"), width)
                rare = ~_members(x, table)
                owner = np.repeat(np.arange(len(full)), full)
                sig, row, short = signatures(x[rare], np.bincount(owner[rare], minlength=len(full)), full, percent, 0)
                if short.any():
                    again = short[owner]
                    s2, r2, _ = signatures(x[again], np.where(short, full, 0), np.where(short, full, 0), percent, 1)
                    sig, row = np.concatenate([sig, s2]), np.concatenate([row, r2])
                if not len(sig):
                    continue
                order = np.argsort(sig)
                sig, who = sig[order], ids[row[order]]
                bucket = (sig >> U(64 - bits)).astype(np.int64)
                rest = ((sig << U(bits)) >> U(32)).astype(np.uint32)
                cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(sig))
                rows = [(int(bucket[i]), rest[i:j].tobytes(), *_pack(who[i:j])) for i, j in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.string()))],
                    ["bucket", "sigs", "ids", "kind"])
    rows = docs.select("doc_id", "text") if leave_out is None else _with_places(docs)
    return rows.mapInArrow(tidy(run), "bucket long, sigs binary, ids binary, kind string")


def _stars(blocks: DataFrame, parts: int) -> DataFrame:
    """Rows (gid, hub, member, links): documents under one signature, linked to the smallest id.

    Equal groups under different signatures get one ``gid``; ``links`` is the group's link count.
    """
    schema = pa.schema([("gid", pa.int64()), ("hub", pa.int64()), ("member", pa.int64()), ("links", pa.int64())])

    def collapse(bucket, sigs, ids, part):
        """(distinct signatures, their hubs), and a batch of the links found."""
        s, d = np.concatenate(sigs), np.concatenate(ids)
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        distinct = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))
        s, d = s[distinct], d[distinct]
        head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        count = np.diff(np.append(head, len(s)))
        group = np.repeat(np.arange(len(head)), count)
        name = (np.add.reduceat(mix(d.view(U)), head) >> U(2)).view(np.int64)
        if part:  # more of this bucket follows: name the group by its signature
            name, count = -1 - ((np.int64(bucket) << np.int64(32)) | s[head].astype(np.int64)), count + _FLUSH
        first = np.zeros(len(head), bool)
        first[np.unique(name, return_index=True)[1]] = True
        link = (np.arange(len(s)) != head[group]) & first[group]
        g = group[link]
        return s[head], d[head], pa.RecordBatch.from_arrays(
            [pa.array(name[g]), pa.array(d[head][g]), pa.array(d[link]), pa.array(count[g] - 1)], schema=schema)

    def run(batches):
        now, sigs, ids, held, part = None, [], [], 0, False
        for batch in batches:
            for bucket, s, d, kind in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is not None and (bucket != now or held > _FLUSH):
                    part = part or bucket == now
                    s0, d0, out = collapse(now, sigs, ids, part)
                    yield out
                    sigs, ids, held = ([s0], [d0], 0) if bucket == now else ([], [], 0)
                    part = part and bucket == now
                now = bucket
                sigs.append(np.frombuffer(s, np.uint32))
                ids.append(np.frombuffer(d, kind).astype(np.int64))
                held += len(sigs[-1])
        if now is not None:
            yield collapse(now, sigs, ids, part)[2]

    return (blocks.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(tidy(run), "gid long, hub long, member long, links long").distinct())


def parity_map(x: np.ndarray) -> bytes:
    """Parity of the features per hash slot, 8 to 16 slots a feature (a power of two of them).

    Two maps differ in at most as many slots as the sets differ in features.
    """
    slots = 8 << max(3, int(len(x) - 1).bit_length())
    at = (x >> U(64 - (slots.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8)).tobytes()


def _halved(bits: np.ndarray) -> np.ndarray:
    """The map with half the slots: neighbouring slots share a hash prefix."""
    return bits[..., 0::2] ^ bits[..., 1::2]


def _differ_in(p: bytes, q: bytes) -> int:
    u, v = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (p, q))
    while len(u) > len(v):
        u = _halved(u)
    while len(v) > len(u):
        v = _halved(v)
    return int((u ^ v).sum())


def _node_table(docs: DataFrame, width: int, table) -> DataFrame:
    """(doc_id, n, map, x): parity map and sorted set (packed 64-bit hashes) of each document that passes the filter.

    One that passes without being linked is in no pair."""
    def run(batches):
        for batch in batches:
            for b in chunks(batch.filter(pa.array(_passes(table.value, batch))), "text", _PART):
                x, n = shingle_sets(b.column("text"), width)
                at = np.append(0, np.cumsum(n))
                sets = [x[i:j] for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n), pa.array([parity_map(z) for z in sets], pa.binary()),
                     pa.array([z.tobytes() for z in sets], pa.binary())], ["doc_id", "n", "map", "x"])
    return _with_places(docs).mapInArrow(tidy(run), "doc_id long, n long, map binary, x binary")


def _apart(percent: int, n):
    return (100 - percent) * n // (100 + percent)


def _joined(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    a = nodes.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = nodes.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.select("a", "b").join(a, "a").join(b, "b")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and parity maps allow the similarity."""
    sized = _joined(pairs, nodes, "n", "map").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        for batch in batches:
            most = _apart(percent, batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy())
            ok = [_differ_in(p.as_buffer(), q.as_buffer()) <= m for p, q, m in zip(batch.column("map_a"), batch.column("map_b"), most)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return sized.mapInArrow(tidy(run), "a long, b long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(batch.column("x_a"), batch.column("x_b"))):
                s, t = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                both = int(_members(s, t).sum())
                ok[i] = both > 0 and 100 * both >= percent * (len(s) + len(t) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    return _joined(pairs, nodes.select("doc_id", "x").join(ids, "doc_id", "left_semi"), "x").mapInArrow(tidy(run), "a long, b long").distinct()


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the edges' nodes, without the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != low[low]).any():
            low = low[low]
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[other], nodes[low[other]]


def _local_stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v), ``u > v``, that join what ``edges`` join: stars in each stretch of about ``_EDGES`` rows of a task.

    Each ``u`` has one row in a stretch."""
    def run(batches):
        us, vs, held = [], [], 0

        def stars():
            found = contracted(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])

        for batch in batches:
            us.append(batch.column("u").to_numpy())
            vs.append(batch.column("v").to_numpy())
            held += batch.num_rows
            if held > _EDGES:
                yield stars()
                us, vs, held = [], [], 0
        if us:
            yield stars()

    return edges.mapInArrow(tidy(run), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, by alternating large-star and small-star steps.

    Before each step tasks turn the edges they hold into stars, so few turns are needed and the small-star step is one
    aggregate: a node gets no more rows of smaller neighbours than there are stretches.  No step adds edges or moves
    one up, so when neither their number nor their sum fell in a turn, all are stars."""
    def low(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def mark_of(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)") + F.col("v"))).first()

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    e = keep(_local_stars(e), "cc")
    mark = mark_of(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = low(both).withColumn("m", F.least("u", "m"))
        e = both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = _local_stars(e).groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        e = keep(e.select(F.explode(F.array_append(F.array_remove("vs", F.col("m")), F.col("u"))).alias("u"), F.col("m").alias("v")), "cc")
        now = mark_of(e)
        if mark == now:
            break
        mark = now
        # small tables are read by fewer tasks than wrote them, which hold more edges each
        e = keep(_local_stars(e), "cc")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def _open_groups(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """(gid, node, comp, size) of the groups that still span several components."""
    g = groups.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    wide = g.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    return g.join(wide.select("gid", "size"), "gid")


def _centre_pairs(wide: DataFrame, turn: int = 0) -> DataFrame:
    """Each member with one centre of its group that lies in another component; another centre each turn."""
    c = wide.groupBy("gid").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "comp")).alias("c"))
    return (wide.join(c, "gid").filter(F.col("comp") != F.col("c.comp"))
            .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct())


def _small_group_pairs(wide: DataFrame) -> DataFrame:
    """All pairs across components in groups of fewer than ``LARGE`` documents."""
    g = wide.filter(F.col("size") < LARGE)
    h = g.select("gid", F.col("node").alias("b"), F.col("comp").alias("other"))
    return g.join(h, "gid").filter("node < b and comp <> other").select(F.col("node").alias("a"), "b").distinct()


def _family_pairs(wide: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in the larger groups that the parity maps allow.

    Groups that share documents form a family.  Its documents go into blocks of about ``BLOCK``;
    each pair of blocks is one row, compared by a matrix product over the maps.  Only what the
    maps allow comes out.
    """
    g = keep(wide.filter(F.col("size") >= LARGE).select("gid", "node", "comp"), "wide")
    if g.isEmpty():
        return g.select(F.col("node").alias("a"), F.col("node").alias("b"))
    # a group's smallest member stands for the group
    e = g.join(g.groupBy("gid").agg(F.min("node").alias("b")), "gid").select(F.col("node").alias("a"), "b").distinct()
    family = components(e).select("node", F.col("comp").alias("family"))
    f = g.select("node", "comp").distinct().join(family, "node")
    parts = f.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    f = (f.join(parts, "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
         .join(nodes.select(F.col("doc_id").alias("node"), "n", "map"), "node"))
    blocks = f.groupBy("family", "block").agg(F.collect_list(F.struct("node", "comp", "n", "map")).alias("docs"))
    blocks = keep(blocks, "blocks")
    two = (blocks.select("family", F.col("block").alias("i"), F.col("docs").alias("p"))
           .join(blocks.select("family", F.col("block").alias("j"), F.col("docs").alias("q")), "family").filter("i <= j"))

    def run(batches):
        for batch in batches:
            for p, q in zip(batch.column("p"), batch.column("q")):
                a, b = _allowed(p.as_py(), q.as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return two.repartition("family", "i", "j").select("p", "q").mapInArrow(tidy(run), "a long, b long").distinct()


def _allowed(p: list[dict], q: list[dict], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks, in different components, whose sizes and maps allow the similarity."""
    out_a, out_b = [], []

    def by_slots(docs):
        out: dict[int, list[dict]] = {}
        for d in docs:
            out.setdefault(len(d["map"]), []).append(d)
        return out

    for slots, x in by_slots(p).items():
        for others, y in by_slots(q).items():
            if not slots <= 2 * others <= 4 * slots:
                continue  # sizes differ too much
            least = 8 * min(slots, others)
            apart = np.zeros((len(x), len(y)), np.float32)
            for at in range(0, least, _SLICE):
                m = []
                for docs, own in ((x, 8 * slots), (y, 8 * others)):
                    fold = own // least
                    raw = np.stack([np.frombuffer(d["map"], np.uint8)[at * fold // 8: (at + min(_SLICE, least)) * fold // 8] for d in docs])
                    bits = np.unpackbits(raw, axis=1)
                    m.append((_halved(bits) if fold == 2 else bits).astype(np.float32))
                apart += m[0].sum(1)[:, None] + m[1].sum(1)[None, :] - 2 * (m[0] @ m[1].T)
            n = [np.array([d[c] for d in docs], np.int64) for c in ("n", "comp", "node") for docs in (x, y)]
            total = n[0][:, None] + n[1][None, :]
            least_n, most_n = np.minimum(n[0][:, None], n[1][None, :]), np.maximum(n[0][:, None], n[1][None, :])
            ok = (apart <= _apart(percent, total)) & (100 * least_n >= percent * most_n) & (n[2][:, None] != n[3][None, :])
            i, j = np.nonzero(ok)
            out_a.append(np.minimum(n[4][i], n[5][j]))
            out_b.append(np.maximum(n[4][i], n[5][j]))
    return (np.concatenate(out_a) if out_a else np.zeros(0, np.int64)), (np.concatenate(out_b) if out_b else np.zeros(0, np.int64))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (columns doc_id, text)."""
    spark = docs.sparkSession
    keys = keep(set_keys(docs, width), "sets")
    total = keys.agg(F.sum("n_shingles")).first()[0] or 0
    real = keys.filter("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("key", "n_shingles").agg(F.min("doc_id").alias("rep"))
    copies = keep(real.join(classes, ["key", "n_shingles"]).filter("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    # one representative of each class goes on; the smallest set with a different partner has
    # t / (1 - t) features
    ids = keys.filter((F.col("n_shingles") * (100 - percent) >= percent) & F.col("doc_id").isNotNull()).select("doc_id")
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    again = id_filter(copies)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, ids.join(copies, "doc_id", "left_anti").distinct(), width))
    bits = max(4, int(np.ceil(np.log2(max(1, total * 0.7 / BUCKET)))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 8)
    blocks = _signature_blocks(docs, frequent, bits, percent, width, again)
    # by a shuffle at any size: a broadcast would put two Python workers into each task
    doubtful = possible_rows(docs, again).join(copies.select("doc_id").hint("merge"), "doc_id", "left_anti")
    blocks = blocks.unionByName(_signature_blocks(doubtful, frequent, bits, percent, width))
    links = keep(_stars(blocks, parts), "stars")
    ids = links.select(F.col("hub").alias("doc_id")).unionByName(links.select(F.col("member").alias("doc_id")))
    nodes = keep(_node_table(docs, width, id_filter(ids)), "nodes")
    first = keep(_possible(links.select(F.col("hub").alias("a"), F.col("member").alias("b")).distinct(), nodes, percent), "pairs")
    edges = keep(_verified(first, nodes, percent), "edges")
    comp = components(edges)
    # groups of two are settled; larger ones may hold links that miss their hub
    more = links.filter("links > 1")
    groups = keep(more.select("gid", F.col("hub").alias("node")).unionByName(more.select("gid", F.col("member").alias("node"))).distinct(), "groups")
    def grown(pairs):
        """The components with the links that ``pairs`` hold, or None without any."""
        found = keep(_verified(keep(pairs, "pairs"), nodes, percent), "edges")
        # what is joined already is a star around its smallest document: few turns remain
        return None if found.isEmpty() else components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found))

    # turns of one centre a group, linear in the groups, as long as they join something; then what is left
    for turn in range(CENTRES):
        wide = keep(_open_groups(groups, comp), "open")
        if wide.isEmpty() or not (now := grown(_possible(_centre_pairs(wide, turn), nodes, percent))):
            break
        comp = now
    else:
        wide = keep(_open_groups(groups, comp), "open")
    if not wide.isEmpty():
        left = _possible(_small_group_pairs(wide), nodes, percent).unionByName(_family_pairs(wide, nodes, percent))
        comp = grown(left) or comp
    by_rep = comp.select(F.col("node").alias("rep"), "comp")
    return (keys.select("doc_id", "n_shingles").join(copies, "doc_id", "left")
            .withColumn("rep", F.coalesce("rep", "doc_id")).join(by_rep, "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id")))
