"""Near duplicates by DartMinHash and banded joining.

A text is a multiset of five-word shingles; similarity is the weighted Jaccard
coefficient (sum of minima over sum of maxima of counts). Each unit of weight
of a shingle is a region beside the axis of ranks; a hash throws a Poisson
number of darts into each cell of it, each with a rank and a coordinate. The
darts of least rank per coordinate are the signature: two texts agree in a
coordinate with the probability of their similarity. About k log k darts are
thrown per text, whatever its length, and further cells only where coordinates
are still empty.

Signatures are cut into bands. Texts that share a band are candidates:

* in buckets of up to ``SMALL`` texts, all pairs;
* in buckets of up to ``LARGE``, the edges of a maximum spanning forest under
  the similarity that signatures estimate, so that no bucket gives more edges
  than it has texts, and what is connected stays connected;
* larger buckets are split by eight further bands each, and what is still
  larger is dealt to cells and taken in blocks, in the order of signatures,
  each joined to the one before.

Candidates are checked exactly on their shingles. As a forest's edge may fail
where another pair of its bucket would not, and blocks do not meet, buckets of
any size over ``SMALL`` that still hold several components are completed: every
plausible pair across components is checked exactly, unless the two are
connected by then. Classes are the connected
components of the links that remain, by alternating large and small stars.
Equal texts are one node throughout and are never paired.

Defined cases: a text without words (null, empty) is a class of its own per
row; fewer than five words are one shingle; ids may repeat or be null, a
class's id is the least of its ids; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.storage import spread
from quillspark.functions.tables import table
from quillspark.llm.common import WORD, joined, slices, stored, tidy

WIDTH = 5
THRESHOLD = 0.8
ROWS, BANDS = 8, 48
K = ROWS * BANDS
SKETCH = 256  # coordinates of the signature kept for estimates, a byte each
#: Estimates of a similarity of THRESHOLD fall below this with a probability under one in a million.
PLAUSIBLE = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / SKETCH) ** 0.5
SMALL, LARGE, CARRY = 8, 1024, 128
FILTER_BITS = 1 << 25
FILTER_NODES = FILTER_BITS // 8  # beyond them more than a fiftieth of other texts would pass
#: Probabilities that a Poisson variable of mean 1 exceeds 0, 1, ..., scaled to 32 bits.
_TAILS = []
_p, _tail = 0.36787944117144233, 1.0
for _i in range(12):
    _tail -= _p
    _TAILS.append(int(_tail * 2**32))
    _p /= _i + 1
EMPTY = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_find = re.compile(WORD).findall


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the text's shingles, sorted, and how often each occurs."""
    words = _find(text or "")
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        h = np.append(h, np.full(width - len(h), len(h), np.uint64))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out ^ h[i : i + n]) + np.uint64(i)
    return np.unique(out, return_counts=True)


def units(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The unit cells of each element's weight as hashes, and the share of each that the weight covers (None: all whole)."""
    cells = np.ceil(weights).astype(np.int64)
    if (cells == 1).all():
        e, c = elements, np.zeros(len(elements), np.uint64)
    else:
        e = np.repeat(elements, cells)
        c = (np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)).astype(np.uint64)
    share = None
    if not np.issubdtype(weights.dtype, np.integer):
        share = np.minimum(1.0, np.repeat(weights, cells) - c)
    return mix(e + c * np.uint64(0x9E3779B97F4A7C15)), share


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """For each of k coordinates the least dart in the elements' weighted regions, as a 64-bit value."""
    cells, share = units(elements, weights)
    best = np.full(k, EMPTY)
    per_round = max(1, int(np.ceil((k * np.log(k) + 2 * k) / weights.sum())))
    rank = 0
    while True:
        ranks = np.arange(rank, rank + per_round, dtype=np.uint64)
        region = mix(cells[:, None] ^ mix(ranks + np.uint64(0x51ED2701))[None, :])
        where = np.broadcast_to(ranks, region.shape).ravel()
        inside = None if share is None else np.broadcast_to(share[:, None], region.shape).ravel()
        region = region.ravel()
        for i, tail in enumerate(_TAILS):  # the i-th dart of each region that has one
            more = (region >> np.uint64(32)) < np.uint64(tail)
            if not more.any():
                break
            region, where = region[more], where[more]
            dart = mix(region + np.uint64((i + 1) * 0xD1342543DE82EF95 % 2**64))
            at, r = dart % np.uint64(k), where
            if inside is not None:
                inside = inside[more]
                hit = (mix(dart) >> np.uint64(11)).astype(float) / 2**53 < inside
                dart, at, r = dart[hit], at[hit], where[hit]
            np.minimum.at(best, at.astype(np.int64), (r << np.uint64(40)) | (mix(dart ^ np.uint64(77)) >> np.uint64(24)))
        rank += per_round
        if (best != EMPTY).all():
            return best


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band."""
    s = signature.reshape(-1, rows)
    out = np.arange(len(s), dtype=np.uint64)
    for i in range(rows):
        out = mix(out ^ s[:, i]) + np.uint64(i)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, text) to (doc_id, node, keys, sketch); keys and sketch are null without words."""

    def run(batches):
        hashes, last = WordHashes(), {}
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                keys, sketches = [], []
                for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if node not in last:
                        if len(last) > 20_000:
                            last.clear()
                        e, n = shingles(text, hashes)
                        s = dart_minhash(e, n) if len(e) else None
                        last[node] = (None, None) if s is None else (band_keys(s).view(np.int64), (mix(s[:SKETCH]) & np.uint64(255)).astype(np.uint8).tobytes())
                    k, sketch = last[node]
                    keys.append(k)
                    sketches.append(sketch)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("node"), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "node", "keys", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "node", "text").mapInArrow(tidy(run), f"doc_id {kind}, node binary, keys array<long>, sketch binary")


def _estimate(sketches: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The similarity of each sketch to one, as their equal bytes suggest."""
    return (np.count_nonzero(sketches == own, axis=1) / SKETCH - 1 / 256) / (1 - 1 / 256)


def _forest(ids: list[bytes], sketches: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Edges of a maximum spanning forest under estimated similarity, those that are plausible (Prim's algorithm)."""
    n = len(ids)
    left, best, source = np.arange(n), np.full(n, -1.0), np.zeros(n, np.int64)
    edges, at = [], 0
    while True:
        keep = left != at
        left, best, source = left[keep], best[keep], source[keep]
        if not len(left):
            return edges
        near = _estimate(sketches[left], sketches[at])
        closer = near > best
        best[closer], source[closer] = near[closer], at
        i = int(best.argmax())
        at = int(left[i])
        if best[i] >= PLAUSIBLE:
            edges.append((ids[source[i]], ids[at]))


def _bucket_edges(batches):
    """Forest edges of each run of rows with one key."""

    def flush(key, nodes, sketches, out):
        if len(nodes) > 1:
            out.extend(_forest(nodes, np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), SKETCH)))

    at, nodes, sketches = None, [], []
    for b in batches:
        out: list[tuple[bytes, bytes]] = []
        for key, node, sketch in zip(b.column("key").to_pylist(), b.column("node").to_pylist(), b.column("sketch").to_pylist(), strict=True):
            if key != at or len(nodes) >= LARGE:
                flush(at, nodes, sketches, out)
                carried = CARRY if key == at else 0  # a block that continues a bucket starts with the last of the one before
                nodes, sketches, at = nodes[len(nodes) - carried :], sketches[len(sketches) - carried :], key
            nodes.append(node)
            sketches.append(sketch)
        yield _edges(out)
    out = []
    flush(at, nodes, sketches, out)
    yield _edges(out)


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    pairs = list({(min(p), max(p)) for p in pairs})
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["a", "b"])


def _shared(entries: DataFrame) -> DataFrame:
    """(key, ...) rows with ``size``, how many rows have the key; keys of one row are left out. No task has all rows of a key."""
    sizes = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "neardup-sizes")
    return joined(entries, sizes, ["key"], "inner", size="size")


def buckets(nodes: DataFrame) -> DataFrame:
    """(node, keys, sketch), one row per node, to (key, node, band, size) of the buckets that nodes share."""
    return stored(_shared(nodes.select("node", F.posexplode("keys").alias("band", "key"))), "neardup-entries")


def candidates(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """What buckets() gives to distinct candidate pairs a < b."""
    small = entries.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("n"))
    pairs = F.flatten(
        F.transform("n", lambda a, i: F.transform(F.slice("n", i + 2, F.size("n")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    small = small.select(F.inline(pairs)).where("a < b")
    large = entries.where((F.col("size") > SMALL) & (F.col("size") <= LARGE)).select("key", "node", "size")
    split = (
        entries.where(F.col("size") > LARGE)
        .join(nodes.select("node", "keys"), "node")
        .select("node", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.xxhash64("key", F.get("keys", (F.col("band") + j) % BANDS)))).alias("key"))
    )
    split = _shared(stored(split, "neardup-split")).select("key", "node", "size")
    cell = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / (16 * LARGE))).alias("cell")
    forest = (
        large.unionByName(split)
        .select("key", "node", cell)
        .join(nodes.select("node", "sketch"), "node")
        .repartition("key", "cell")
        .sortWithinPartitions("key", "cell", "sketch", "node")
        .select(F.xxhash64("key", "cell").alias("key"), "node", "sketch")
        .mapInArrow(_bucket_edges, "a binary, b binary")
    )
    return small.unionByName(forest).distinct()


def _slots(node: str, bits: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(node, F.lit(i)), F.lit(bits)) for i in range(3)))


def bloom(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes, ten bits each but FILTER_BITS at most, as 64-bit words."""
    bits = min(FILTER_BITS, max(1024, 1 << (10 * nodes.count()).bit_length()))
    slot = nodes.select(F.explode(_slots("node", bits)).alias("s"))
    words = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def expanded(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) to (node, units) for the nodes wanted and a few others: hashes of units of weight, of which texts share as many as weight.

    A Bloom filter of bounded size keeps most texts that aren't wanted from being computed; none is moved.
    For more nodes than it can tell apart, the distinct texts are shuffled to them instead.
    """
    docs = docs.where("node IS NOT NULL")
    if nodes.count() > FILTER_NODES:
        once = docs.groupBy("node").agg(F.first("text").alias("text"))

        def every(batches):
            hashes = WordHashes()
            for whole in batches:
                for b in slices(whole, "text", 4_000_000):
                    made = [units(*shingles(t, hashes))[0].view(np.int64) for t in b.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(made, pa.list_(pa.int64()))], names=["node", "units"])

        return once.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(tidy(every), "node binary, units array<long>")
    words = bloom(nodes)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        hashes = WordHashes()
        for whole in batches:
            slots = whole.column("slots").flatten().to_numpy().reshape(-1, 3)
            hit = (shared.value[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)
            for b in slices(whole.filter(pa.array(hit)), "text", 4_000_000):
                made = [units(*shingles(t, hashes))[0].view(np.int64) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(made, pa.list_(pa.int64()))], names=["node", "units"])

    rows = docs.select("node", "text", _slots("node", len(words) * 64).alias("slots")).mapInArrow(tidy(run), "node binary, units array<long>")
    return rows.groupBy("node").agg(F.first("units").alias("units"))


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose texts have the similarity, with it."""
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "neardup-needed")
    sets = stored(expanded(docs.select("node", "text"), needed), "neardup-units")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("units").alias("ua")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("units").alias("ub")), "b")
    common = F.size(F.array_intersect("ua", "ub"))
    return both.select("a", "b", (common / (F.size("ua") + F.size("ub") - common)).alias("similarity")).where(F.col("similarity") >= threshold)


def _contract(batches):
    """The edges of a partition as stars: a union-find over what the task has."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for a, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            a, c = root(a), root(c)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > 1_000_000:
            yield _edges([(x, root(x)) for x in list(parent) if root(x) != x])
            parent.clear()
    yield _edges([(x, root(x)) for x in list(parent) if root(x) != x])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root) for every node that isn't the least of its component."""
    edges = stored(edges.select("a", "b").mapInArrow(_contract, "a binary, b binary"), "neardup-stars")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        star = star.where("a < b")
        least = star.groupBy("b").agg(F.min("a").alias("m"))
        small = star.join(least, "b")
        small = small.where("a > m").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = stored(small.distinct().select(F.col("x").alias("a"), F.col("y").alias("b")), "neardup-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = now


def _cell_links(rows: pa.Table, threshold: float) -> list[tuple[bytes, bytes, float]]:
    """Links that connect the components of a cell's strays to those of its inside."""
    nodes, number = rows["node"].to_pylist(), {}
    label = np.array([number.setdefault(r, len(number)) for r in rows["root"].to_pylist()])
    sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(nodes), SKETCH)
    units = rows["units"].combine_chunks()
    sizes = pc.list_value_length(units).to_numpy(zero_copy_only=False)
    flat, ends = units.flatten().to_numpy(), np.cumsum(sizes)
    inside, out = np.flatnonzero(rows["inside"].to_numpy()), []
    for x in np.flatnonzero(rows["stray"].to_numpy()).tolist():
        others = inside[label[inside] != label[x]]
        near = _estimate(sketches[others], sketches[x])
        others = others[np.argsort(-near, kind="stable")][: np.count_nonzero(near >= PLAUSIBLE)]
        own, step = np.sort(flat[ends[x] - sizes[x] : ends[x]]), 8
        while len(others):
            some, others, step = others[:step], others[step:], min(4 * step, 256)
            theirs = np.concatenate([flat[ends[y] - sizes[y] : ends[y]] for y in some.tolist()])
            same = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            common = np.add.reduceat(same, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            similarity = common / (len(own) + sizes[some] - common)
            for y, s in zip(some.tolist(), similarity.tolist(), strict=True):
                if s >= threshold and label[y] != label[x]:
                    out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y]), s))
                    label[label == label[y]] = label[x]
            others = others[label[others] != label[x]]
    return out


def completed(entries: DataFrame, nodes: DataFrame, docs: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The links (a, b, similarity) that buckets with forests lack, so that none holds a plausible pair across components unchecked.

    The nodes outside a bucket's largest component, its strays, are compared with
    all its nodes, in cells of about LARGE of each.
    """
    rooted = entries.where(F.col("size") > SMALL).select("key", "node").join(components(links), "node", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "node")), "neardup-rooted")
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks, chunks = (F.ceil(n / F.lit(LARGE)).alias(k) for n, k in ((F.col("n"), "blocks"), (F.col("n") - F.col("main.n"), "chunks")))
    parts = stored(parts.select("key", F.col("main.root").alias("main"), "n", blocks, chunks), "neardup-parts")
    rows = joined(rooted, parts, ["key"], "inner", size="n").drop("n")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), "chunks"))
    cell = lambda c, b: F.struct(c.alias("c"), b.alias("b"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: cell(c, F.col("block")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: cell(F.col("chunk"), b))
    rows = rows.withColumn("stray", F.col("root") != F.col("main"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("stray"), F.array_union(met, meets)).otherwise(met)))
    rows = rows.select(
        F.xxhash64("key", "at.c", "at.b").alias("cell"), "node", "root", (F.col("stray") & (F.col("at.c") == F.col("chunk"))).alias("stray"), (F.col("at.b") == F.col("block")).alias("inside")
    )
    rows = stored(rows, "neardup-cells")
    sets = stored(expanded(docs.select("node", "text"), rows.select("node").distinct()), "neardup-units")

    def run(batches):
        at, kept = None, []
        for b in batches:
            cells = b.column("cell").to_numpy()
            starts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for i, j in zip(starts, starts[1:]):
                if kept and i < j and cells[i] != at:
                    yield _links(_cell_links(pa.Table.from_batches(kept), threshold))
                    kept = []
                if i < j:
                    at = cells[i]
                    kept.append(b.slice(i, j - i))
        if kept:
            yield _links(_cell_links(pa.Table.from_batches(kept), threshold))

    rows = rows.join(nodes.select("node", "sketch"), "node").join(sets, "node").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(tidy(run), "a binary, b binary, similarity double")


def _links(found: list[tuple[bytes, bytes, float]]) -> pa.RecordBatch:
    a, b, s = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])


def nodes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with ``node``, which equal texts share."""
    return docs.select("doc_id", F.unhex(F.md5("text")).alias("node"), "text")


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) rows to (doc_id, node, worded) and the links (a, b, similarity) between nodes."""
    named = nodes_of(docs)
    rows = stored(signed(named), "neardup-signatures")
    nodes = rows.where("keys IS NOT NULL").groupBy("node").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "neardup-nodes")
    entries = buckets(nodes)
    pairs = stored(candidates(entries, nodes), "neardup-pairs")
    links = stored(verified(pairs, named, threshold), "neardup-links")
    links = links.unionByName(completed(entries, nodes, named, links, threshold))
    return rows.select("doc_id", "node", F.col("keys").isNotNull().alias("worded")), links


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) rows to (doc_id, node, worded, root, class_id): ``root`` is one per class, also where classes share an id."""
    rows, links = linked(docs, threshold)
    per_node = rows.where("worded").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    rooted = per_node.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "neardup-nodes-by-root")
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("nodes"))
    named = joined(rooted.select("node", "root", "copies"), stored(least, "neardup-least"), ["root"], "inner", size="nodes")
    named = stored(named.select("node", "root", "class_id", "copies"), "neardup-classes")
    worded = joined(rows.where("worded"), named, ["node"], "inner", size="copies").select("doc_id", "node", "worded", "root", "class_id")
    return worded.unionByName(rows.where("NOT worded").select("doc_id", "node", "worded", F.col("node").alias("root"), F.col("doc_id").alias("class_id")))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes(docs).select("doc_id", "class_id")
