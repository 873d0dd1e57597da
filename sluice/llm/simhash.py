"""Operator 3: SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints are 64 bits. For links at ``tau`` or fewer differing bits, the bits are grouped into partitions
(bits that agree often together share one), and each partition i gets a threshold t_i of its own (-1: not
used) with sum(t_i + 1) = tau + 1: two linked fingerprints then differ by at most t_i in some partition i.
Dynamic programming picks the thresholds with the least estimated work, from bit counts over all
fingerprints. Every distinct fingerprint is filed under its values in the used partitions and probes all
values within t_i; those that meet are compared in full. A crowded value is split into blocks of rows, and
pairs of blocks are compared in separate tasks. A task reports links that span what it found, not all pairs.

Cases: null and empty texts have no words: fingerprint zero, linked like any other; texts of fewer words
than a shingle are one shingle; rows without doc_id get a fingerprint but no component; rows that share a
doc_id are linked by their texts alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, small_batches, written
from .graph import connected_components, spanning

SEED = 42
#: Rows of one partition value that are compared in one task; more are split into blocks.
BLOCK = 1024
#: Estimated seconds for a filed row and for a comparison; the most bits by which a partition may differ.
ROW_S, PAIR_S, MOST_T = 2e-6, 1e-8, 4
SKETCH_WORDS = 4
#: MinHash bands: sets of similarity J agree in a band with probability J ** BAND_ROWS; at 0.8, 3 pairs in 100,000 share none of BANDS.
BANDS, BAND_ROWS = 20, 4
#: Differing sketch bits up to which a candidate is verified: over 3.9 standard deviations beyond the mean at a similarity of 0.8, even for sets of 4 and 5.
LOOSE_BITS = 76
#: Bytes of shingle hashes that one side of a verifying task holds.
VERIFY_BYTES = 16 << 20


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(doc: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, joined by spaces; of all words, if they are fewer."""
    from xxhash import xxh64_intdigest

    if not doc:
        return np.zeros(0, np.uint64)
    whole = b" ".join(doc)
    if len(doc) <= width:
        return np.asarray([xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, doc), np.int64, len(doc)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts[: len(doc) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in spans), np.uint64, len(doc) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, hashes.size, 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<u8")[0])


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def shingle_set(doc: list[bytes], width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(doc, width))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A value for each MinHash band of a set of shingles; sets that agree in a value are candidates."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS, BAND_ROWS), np.uint64, False) | np.uint64(1)
    if not hashes.size:
        return np.zeros(BANDS, np.int64)
    mixed, out = _remix(hashes, SKETCH_WORDS), np.zeros(BANDS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BAND_ROWS):
            least = np.asarray([(mixed * f).min() for f in factors[:, k]])
            out = _remix(out * np.uint64(0x9E3779B97F4A7C15) + least, k)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, sketch: bool = False) -> DataFrame:
    """doc_id, text_key and fp (64 bits, as a signed long) of every row.

    With ``sketch``, fp is over the distinct words instead; ``sketch`` holds 256 more bits of SimHash over the
    distinct shingles of ``width`` words, from which a similarity can be estimated; ``bands`` the MinHash bands of
    the shingles, ``n_set`` their number and ``node`` a hash of them all.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            fps, sketches, banded, sizes, nodes = [], [], [], [], []
            for text in b.column("text"):
                doc = words(text.as_py())
                if sketch:
                    hashes = shingle_set(doc, width)
                    banded.append(bands(hashes).astype("<i8").tobytes())
                    sizes.append(hashes.size)
                    nodes.append(xxh3_64_intdigest(hashes.astype("<u8").tobytes()))
                    sketches.append(np.asarray([majority(_remix(hashes, k)) for k in range(SKETCH_WORDS)], "<u8").tobytes())
                    fps.append(majority(shingle_hashes(sorted(set(doc)), 1)) if len(set(doc)) > 1 else majority(hashes))
                else:
                    fps.append(majority(shingle_hashes(doc, width)))
            out = [b.column("doc_id"), b.column("text_key"), pa.array(np.asarray(fps, np.uint64).view(np.int64))]
            if sketch:
                out += [pa.array(sketches, pa.binary()), pa.array(banded, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.asarray(nodes, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "text_key", "fp", *["sketch", "bands", "n_set", "node"] * sketch])

    return rows.mapInArrow(digest, "doc_id long, text_key long, fp long" + ", sketch binary, bands binary, n_set int, node long" * sketch)


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set; summed by Spark over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(bits), both + bits.T @ bits
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.r_[n, both.ravel()].astype(np.int64))], names=["at", "n"])

    sums = dict(map(tuple, nodes.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect()))  # 4097 rows
    return sums.get(0, 0), np.asarray([sums.get(i, 0) for i in range(1, 4097)], float).reshape(64, 64)


def bit_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups of about equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        group = [max(free, key=lambda i: corr[i, free].sum())]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda i: corr[i, group].sum()))
            free.remove(group[-1])
        groups.append(group)
    return groups


def within(p: np.ndarray, most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, ... ``most`` of the bits that are set with rates p."""
    dist = np.ones(1)
    for q in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - q, q])
    return np.cumsum(np.r_[dist, np.zeros(most + 1)])[: most + 1].tolist()


def thresholds(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """The grouping and thresholds of least estimated cost: (bits, t) of each partition that is used.

    The bit counts ``both`` of ``n`` fingerprints say how bits agree, and so how many candidates each choice has.
    """
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, tau + 3):
        groups = bit_groups(n, both, m)
        state: dict[int, tuple[float, list[tuple[list[int], int]]]] = {0: (0.0, [])}
        for g in groups:
            share, nxt = within(p[g], MOST_T), dict(state)  # t = -1: not used
            for t in range(min(MOST_T, tau) + 1):
                rows = n * (1 + sum(comb(len(g), j) for j in range(1, t + 1)) / 2)
                cost = ROW_S * rows + PAIR_S * share[t] * n * n
                for used, (c, chosen) in state.items():
                    to = min(tau + 1, used + t + 1)
                    if to not in nxt or c + cost < nxt[to][0]:
                        nxt[to] = (c + cost, [*chosen, (g, t)])
            state = nxt
        if tau + 1 in state and state[tau + 1][0] < best[0]:
            best = state[tau + 1]
    return best[1]


def _entries(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Every node under its own values (probe 0) and the values within the thresholds (probe 1).

    Of two values that differ, the one with a 0 at the lowest differing bit probes the other. Nodes with MinHash
    bands are filed under those too, as partitions after those of the plan.
    """
    sketched = "sketch" in nodes.columns
    kept = ["node", "fp", *["sketch", "n_set"] * sketched]
    flips = [[sum(1 << i for i in c) for j in range(1, t + 1) for c in combinations(range(len(bits)), j)] for bits, t in plan]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for part, (bits, _) in enumerate(plan):
                value = np.zeros(fp.size, np.int64)
                for k, bit in enumerate(bits):
                    value |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
                for mask in [0, *flips[part]]:
                    mine = np.flatnonzero(value & (mask & -mask) == 0)
                    row = b.take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(mine.size, part, np.int32)), pa.array(value[mine] ^ mask), pa.array(np.full(mine.size, mask != 0)), *[row.column(c) for c in kept]], names=["part", "value", "probe", *kept])
            if sketched and b.num_rows:
                values = np.frombuffer(b"".join(b.column("bands").to_pylist()), "<i8").reshape(-1, BANDS)
                for k in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(fp.size, len(plan) + k, np.int32)), pa.array(values[:, k].copy()), pa.array(np.zeros(fp.size, bool)), *[b.column(c) for c in kept]], names=["part", "value", "probe", *kept])

    return nodes.select(*kept, *["bands"] * sketched).mapInArrow(file, "part int, value long, probe boolean, node long, fp long" + ", sketch binary, n_set int" * sketched)


def _pairs(probe: np.ndarray, fp: np.ndarray, group: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of an indexed row and a later row of its group at distance ``tau`` or less. Indexed rows come first in a group."""
    n = fp.size
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    small = np.repeat(size <= 48, size)
    for k in range(1, int(size[size <= 48].max(initial=0))):
        i = np.flatnonzero((group[:-k] == group[k:]) & small[:-k] & ~probe[:-k])
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= tau]
        if i.size:
            yield i, i + k
    for a, s in zip(start[size > 48].tolist(), size[size > 48].tolist()):
        indexed = int((~probe[a : a + s]).sum())
        for lo in range(0, indexed, 256):
            hi = min(lo + 256, indexed)
            near = np.bitwise_count(fp[a + lo : a + hi, None] ^ fp[None, a + lo : a + s]) <= tau
            i, j = np.nonzero(near)
            ok = j > i
            if ok.any():
                yield a + lo + i[ok], a + lo + j[ok]


def links(nodes: DataFrame, tau: int, similarity: float | None = None) -> DataFrame:
    """a, b: links that join what is within ``tau`` bits of each other.

    With ``similarity``: candidates only, i.e. what is within ``tau`` bits or agrees in a MinHash band, within
    ``LOOSE_BITS`` of the sketches, and of sizes that allow the similarity. ``nodes``: node (distinct), fp and,
    for candidates, sketch, bands and n_set. Links are not all pairs: those of each task are reduced to as many
    as keep its nodes connected.
    """
    spark = nodes.sparkSession
    n, both = bit_counts(nodes)
    plan = thresholds(n, both, tau)
    entries = written(_entries(nodes, plan), "entries")
    crowded = entries.groupBy("part", "value").count().where(F.col("count") > BLOCK)
    crowded = written(crowded.select("part", "value", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "crowded")
    mine = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    blocked = entries.join(crowded, ["part", "value"], "left").withColumn("mine", mine).withColumn("other", other)
    key = ["part", "value", "low", "high"]
    blocked = blocked.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("blocks", "mine", "other")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocked.repartition(parts, *key).sortWithinPartitions(*key, "probe")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> pa.RecordBatch:
            keys = [rows.column(k).to_numpy() for k in key]
            new = np.zeros(rows.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            fp, node = rows.column("fp").to_numpy().view(np.uint64), rows.column("node").to_numpy()
            probe = rows.column("probe").to_numpy(zero_copy_only=False)
            group, banded, wide, outs = np.cumsum(new), keys[0] >= len(plan), None, []
            if similarity is not None:
                wide = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u8").reshape(-1, SKETCH_WORDS)
                sizes = rows.column("n_set").to_numpy()
            for at, bits in ((np.flatnonzero(~banded), tau), (np.flatnonzero(banded), 64)):  # a band asks nothing of fp
                for i, j in _pairs(probe[at], fp[at], group[at], bits):
                    i, j = at[i], at[j]
                    if wide is not None:
                        ok = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
                        i, j = i[ok], j[ok]
                        ok = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= LOOSE_BITS
                        i, j = i[ok], j[ok]
                    outs.append(spanning(node[i], node[j]))
            a, b = spanning(*[np.concatenate([o[k] for o in outs]) for k in (0, 1)]) if outs else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in key]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            opens = bool(held) and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in key)
            if opens or change.size:
                at = int(change[-1]) + 1 if change.size else 0
                yield found(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = [batch.slice(at)]
            else:
                held.append(batch)
        if held:
            yield found(pa.Table.from_batches(held))

    return dealt.mapInArrow(compare, "a long, b long")


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (in order) have at least that Jaccard similarity."""
    if min(a.size, b.size) < similarity * max(a.size, b.size) - 1e-9:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= similarity * (a.size + b.size - both) - 1e-9


def verified(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, width: int, similarity: float) -> DataFrame:
    """a, b: links of nodes whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    ``candidates`` (node, component): only nodes of one component are compared, by their sets. Every node is compared
    with the first one of its component, which joins nearly all of a large group of copies; the others are compared
    with all, but those joined already are not compared among each other. For that, components of many bytes are dealt
    into blocks, and pairs of blocks are compared in separate tasks. Pairs that a task has already joined through
    others are skipped, as are those whose sizes or sketches rule them out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = nodes.join(candidates, "node").select("node", "component", "sketch", "n_set", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    chosen = written(chosen, "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), F.col("text").cast("string").alias("text"))
    texts = chosen.join(texts.hint("merge"), ["_id", "_key"]).select("component", "node", "n_set", "sketch", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(words(t.as_py()), width).astype("<u8").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], names=[*b.schema.names[:-1], "hashes"])

    fields = "component long, node long, n_set int, sketch binary, hashes binary"
    every = written(texts.mapInArrow(sets, fields).dropDuplicates(["node"]), "shingle-sets")
    heads = every.groupBy("component").agg(F.min("node").alias("node"))
    heads = written(every.select("component", "node", "hashes").join(heads.hint("merge"), ["component", "node"]).select("component", F.col("node").alias("head"), F.col("hashes").alias("head_hashes")), "first-sets")

    def joins_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [n == h or _similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), similarity) for n, h, x, y in zip(b.column("node").to_pylist(), b.column("head").to_pylist(), b.column("hashes"), b.column("head_hashes"))]
            kept = ["component", "node", "n_set", "sketch", "hashes", "head"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(same, pa.bool_())], names=[*kept, "joined"])

    marked = written(every.join(heads.hint("merge"), "component").select("component", "node", "n_set", "sketch", "hashes", "head", "head_hashes").mapInArrow(joins_head, f"{fields}, head long, joined boolean"), "compared-sets")
    at_once = marked.where("joined and node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(8 * F.sum(F.col("n_set").cast("long")) / VERIFY_BYTES), F.lit(1)).cast("int")
    counted = marked.groupBy("component", "joined").agg(blocks.alias("blocks"))
    counted = counted.groupBy("component").agg(F.max(F.when(~F.col("joined"), F.col("blocks"))).alias("others"), F.max(F.when(F.col("joined"), F.col("blocks"))).alias("known"))
    counted = written(counted.where("others is not null"), "verify-blocks")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("joined"), F.col("known")).otherwise(F.col("others"))).cast("int")
    dealt = marked.join(counted, "component").withColumn("mine", mine + F.when(F.col("joined"), F.col("others")).otherwise(0))
    last = F.when(F.col("joined"), F.col("others")).otherwise(F.col("others") + F.col("known")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).select("component", "low", "high", "node", "mine", "joined", "sketch", "hashes")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        node, mine = rows.column("node").to_numpy(), rows.column("mine").to_numpy()
        each = [np.frombuffer(h, "<u8") for h in rows.column("hashes").to_pylist()]
        wide = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u8").reshape(-1, SKETCH_WORDS)
        sizes, label, out = np.asarray([h.size for h in each]), np.arange(node.size), []
        known = np.flatnonzero(rows.column("joined").to_numpy())
        label[known] = known[0] if known.size else 0
        across = key[1].as_py() != key[2].as_py()
        for i in range(node.size - 1):
            rest = np.arange(i + 1, node.size)
            ok = (label[rest] != label[i]) & (np.minimum(sizes[i], sizes[rest]) >= similarity * np.maximum(sizes[i], sizes[rest]) - 1e-9)
            if across:  # pairs inside a block have a task of their own
                ok &= mine[rest] != mine[i]
            rest = rest[ok]
            rest = rest[np.bitwise_count(wide[i] ^ wide[rest]).sum(axis=1) <= LOOSE_BITS]
            for j in rest.tolist():
                if label[i] != label[j] and _similar(each[i], each[j], similarity):
                    label[label == label[j]] = label[i]
                    out.append((node[i], node[j]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return at_once.union(dealt.groupBy("component", "low", "high").applyInArrow(compare, "a long, b long"))


def components(members: DataFrame, tau: int, docs: DataFrame | None = None, width: int = 5, similarity: float | None = None) -> DataFrame:
    """``members`` (doc_id, text_key, fp and, for ``similarity``, what ``fingerprints`` adds) with ``component_id``,
    the smallest doc_id reachable, and ``keeper``, the (doc_id, text_key) that comes first in the component.

    With ``similarity``, the links are candidates verified on the texts of ``docs``.
    """
    more = ["sketch", "bands", "n_set"] if similarity is not None else []
    if not more:
        members = members.withColumn("node", F.col("fp"))
    one = [F.first(c).alias(c) for c in ("fp", *more)]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("first")
    nodes = written(members.groupBy("node").agg(*one, first), "nodes").where("first is not null")
    labels = connected_components(links(nodes.select("node", "fp", *more), tau, similarity))
    if more:
        labels = connected_components(verified(docs, nodes, labels, width, similarity))
    labelled = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    labelled = written(labelled, "labelled")
    least = written(labelled.groupBy("component").agg(F.min("first").alias("keeper")), "keepers")
    keepers = written(labelled.join(least, "component").select("node", "keeper"), "node-keepers")
    joined = members.join(keepers, "node", "left")
    there = F.col("doc_id").isNotNull()
    return joined.select(*[c for c in members.columns if c != "node"], F.when(there, F.col("keeper.doc_id")).alias("component_id"), F.when(there, F.col("keeper")).alias("keeper"))


def near_duplicates(docs: DataFrame, width: int = 3, tau: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    members = written(fingerprints(docs, width), "fingerprints")
    return components(members, tau).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, tau: int = 7) -> DataFrame:
    """``docs`` without the rows that are near-copies of an earlier one.

    Candidates are within ``tau`` bits by their distinct words or agree in a MinHash band of their ``width``-word
    shingles; a link needs a Jaccard similarity of the shingles of at least ``similarity``, which is computed. Of
    each group of linked rows the first by doc_id stays. Rows without doc_id stay; rows equal in doc_id and text
    are one document.
    """
    members = written(fingerprints(docs, width, sketch=True), "sketches")
    found = components(members, tau, docs, width, similarity)
    removed = found.where("keeper is not null and (doc_id <> keeper.doc_id or text_key <> keeper.text_key)").select("doc_id", "text_key").distinct()
    i, k = free_names(docs, "id", "key")
    removed = written(removed, "near-copies").toDF(i, k)
    return docs.join(removed.hint("merge"), (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64("text") == F.col(k)), "left_anti")
