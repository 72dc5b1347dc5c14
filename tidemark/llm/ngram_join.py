"""N-gram Jaccard self-join: a prefix-tree join over globally ordered shingle sets.

1. profile(): one pass turns texts into sets of shingle hashes and gives each document its set's size and 128-bit key. Equal
   sets are one class from here on. The same pass keeps a Misra-Gries summary of each task's shingles; the merged summary
   names at most HEAVY shingles, the only thing that is broadcast.
2. shared(): shingles are dealt by hash range, as packed arrays per chunk of documents, to count document frequencies; only
   those of two or more documents go back to their chunk. Heavy shingles stay at home, so no range holds an unbounded list.
   The global order is rarest first. A document whose unshared shingles fill its prefix can't link and leaves.
3. prefix_lists(): documents that share a prefix shingle (the positions that the threshold's length bounds allow) are candidates;
   a shingle's documents are a list. Lists with the same smallest document (their hub) form one group, to which each document
   goes once, however many shingles it shares there. Only documents of one group can be compared.
4. links(): each group is joined by a trie of its ordered sets: a probe walks it once, sharing the overlap of common
   beginnings, and prunes subtrees whose remaining length can't reach the required overlap. Documents that are already
   connected aren't compared. A group of over SHARD documents is dealt to shards that all hold its pivots; what isn't
   connected to the main component of a list afterwards is compared within its own lists, with sets of similar size, in
   pieces of SHARD. No pair is left out at any size.

The input is read twice and dealt to chunks in its order, so that it should be a table (as a stage's input is) and not a plan
that gives other rows when a task is repeated.

Defined results: a null or empty text has no shingles and links with nothing; with fewer words than a shingle the whole
sequence is one; rows that share a doc_id count as one document, of which each row is returned; a row without doc_id links
like any other and can connect others, but its component takes its name from rows with ids, else is null; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, shuffle_partitions, written
from tidemark.llm.components import components
from tidemark.llm.hashing import Words, mixed, ragged, words_of

SHINGLE = 5
HEAVY = 1 << 16
RANGE = 1 << 20  # shingles for which there is a hash range
SHARD = 96
_LOW = np.uint64((1 << 48) - 1)
_HASH_BITS = np.uint64(55)
_HEAVY_CLASS = 255


def required(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Smallest overlap of sets of a and b with 100 * overlap >= 75 * union."""
    return -((-3 * (a + b)) // 7)


def prefix(n: np.ndarray) -> np.ndarray:
    """Positions in which a set of n must meet any set it links with."""
    return n - -(-3 * n // 4) + 1


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of the distinct shingles of each text, sorted by text and hash."""
    hashes, at = words.windows(k)
    text = words.text[at]
    count = np.bincount(words.text, minlength=words.n_texts)
    first = np.cumsum(count) - count
    for size in range(1, k):  # texts of fewer words are one shingle
        short = np.flatnonzero(count == size)
        hashes, text = np.concatenate([hashes, words.sequence(first[short], size)]), np.concatenate([text, short])
    order = np.argsort(hashes)
    order = order[np.argsort(text[order].astype(np.uint16 if words.n_texts < 1 << 16 else np.int64), kind="stable")]
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def _set_keys(hashes: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    size = np.bincount(text, minlength=n_texts)
    ends = np.cumsum(size)
    keys = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        keys.append((sums[ends] - sums[ends - size]).view(np.int64))
    return size, keys


class Summary:
    """Frequent values of a stream in at most `size` counters (Misra-Gries over chunks). What occurs once in a chunk opens no counter: a value that holds 1 / size of everything occurs several times in chunks of this size."""

    def __init__(self, size: int) -> None:
        self.size, self.total, self.values, self.counts = size, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.total += len(values)
        values, counts = np.unique(values, return_counts=True)
        keep = (counts > 1) | np.isin(values, self.values)
        self.values, back = np.unique(np.concatenate([self.values, values[keep]]), return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, counts[keep]]), len(self.values)).astype(np.int64)
        if len(self.values) > self.size:
            least = np.partition(self.counts, -self.size - 1)[-self.size - 1]
            keep = self.counts > least
            self.values, self.counts = self.values[keep], self.counts[keep] - least


def profile(docs: DataFrame) -> DataFrame:
    """Written: a row (doc_id, n, k1, k2) for each document, and rows with heavy = true for frequent shingles (k1; n: a count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(HEAVY)
        names = ["doc_id", "n", "k1", "k2", "heavy"]
        for batch in batches:
            for first, words in words_of(batch["text"], lower=True):
                hashes, text = shingle_sets(words)
                summary.add(hashes)
                size, keys = _set_keys(hashes, text, words.n_texts)
                ids = batch["doc_id"].slice(first, words.n_texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), *map(pa.array, keys), pa.array(np.zeros(words.n_texts, bool))], names)
        keep = summary.counts >= max(2, summary.total // HEAVY)
        if keep.any():
            values, counts = summary.values[keep].view(np.int64), summary.counts[keep]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), pa.array(counts), pa.array(values), pa.array(np.zeros(len(values), np.int64)), pa.array(np.ones(len(values), bool))], names)

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, heavy boolean"))


def heavy_shingles(table: DataFrame, total: int) -> np.ndarray:
    """At most HEAVY shingles: those that hold at least 1 / HEAVY of all occurrences by the merged summaries."""
    rows = table.where("heavy").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, total // HEAVY)).orderBy(F.desc("n"), "k1").limit(HEAVY)
    return np.sort(rows.select("k1").toPandas()["k1"].to_numpy(np.int64).view(np.uint64))


_PARTS = "chunk long, bucket int, kind int, keys binary, texts binary, extra binary"
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def _scatter(n_buckets: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for _, words in words_of(batch["text"], lower=True):
                hashes, text = shingle_sets(words)
                size, keys = _set_keys(hashes, text, words.n_texts)
                chunk += 1
                hot = np.isin(hashes, heavy) if len(heavy) else np.zeros(len(hashes), bool)
                head = np.stack([size.astype(np.int64), *keys]).tobytes()
                yield _rows(chunk, [chunk % n_buckets], [1], [head], [text[hot].astype(np.int32).tobytes()], [hashes[hot].tobytes()])
                hashes, text = hashes[~hot], text[~hot].astype(np.int32)
                bucket = ((hashes >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
                cut = np.concatenate([[0], ends])
                low = (hashes[order] & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                text = text[order]
                some = np.flatnonzero(np.diff(cut))
                step = np.diff(text, prepend=np.int32(0))
                step[cut[some]] = text[cut[some]]
                step = step.tobytes()
                yield _rows(chunk, some.tolist(), [0] * len(some), [low[6 * cut[b] : 6 * cut[b + 1]] for b in some], [step[4 * cut[b] : 4 * cut[b + 1]] for b in some], [b""] * len(some))

    return run


def _rows(chunk: int, bucket: list, kind: list, *blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(bucket), pa.int64()), pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], _NAMES)


def _count(table: pa.Table) -> pa.Table:
    """One hash range: frequencies of its shingles; those of two documents and more go back to their chunks."""
    whole = table.filter(pc.equal(table["kind"], 1))
    part = table.filter(pc.equal(table["kind"], 0))
    if not part.num_rows:
        return whole
    blobs = part["keys"].to_pylist()
    count = np.array([len(b) // 6 for b in blobs])
    raw = np.zeros((int(count.sum()), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    low = raw.view("<u8").ravel()
    order = np.argsort(low)
    new = np.ones(len(low), bool)
    new[1:] = low[order][1:] != low[order][:-1]
    run = np.cumsum(new) - 1
    df = np.empty(len(low), np.int64)
    df[order] = np.bincount(run)[run]
    twice = df > 1
    rank = np.minimum(_HEAVY_CLASS - 1, np.log2(df[twice]) * 8).astype(np.uint64)
    bucket = np.uint64(part["bucket"][0].as_py())
    value = (rank << _HASH_BITS) | ((low[twice] | (bucket << np.uint64(48))) & np.uint64((1 << 55) - 1))
    steps = np.frombuffer(b"".join(part["texts"].to_pylist()), np.int32)
    ends = np.cumsum(count)
    sums = np.cumsum(steps)
    text = (sums - np.repeat(np.concatenate([[0], sums])[ends - count], count))[twice].astype(np.int32)
    kept = np.concatenate([[0], np.cumsum(twice)])
    lo, hi = kept[ends - count], kept[ends]
    some = np.flatnonzero(hi > lo)
    value, text = value.tobytes(), text.tobytes()
    chunks = part["chunk"].to_numpy()
    out = pa.Table.from_arrays(
        [
            pa.array(chunks[some]),
            pa.array(np.full(len(some), int(bucket), np.int32)),
            pa.array(np.zeros(len(some), np.int32)),
            pa.array([value[8 * lo[i] : 8 * hi[i]] for i in some], pa.binary()),
            pa.array([text[4 * lo[i] : 4 * hi[i]] for i in some], pa.binary()),
            pa.array([b""] * len(some), pa.binary()),
        ],
        _NAMES,
    )
    return pa.concat_tables([whole.select(_NAMES).cast(out.schema), out])


_SETS = "k1 long, k2 long, n long, unshared long, ordered array<long>"


def _gather(table: pa.Table) -> pa.Table:
    """One chunk: documents whose prefix holds shared shingles, with these in global order."""
    kind = table["kind"].to_numpy()
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("unshared", pa.int64()), ("ordered", pa.list_(pa.int64()))])
    heads = table.filter(pa.array(kind == 1))
    if not heads.num_rows:
        return schema.empty_table()
    size, k1, k2 = np.frombuffer(heads["keys"][0].as_py(), np.int64).reshape(3, -1)
    hot = np.frombuffer(heads["extra"][0].as_py(), np.uint64)
    value = [(np.uint64(_HEAVY_CLASS) << _HASH_BITS) | (hot & np.uint64((1 << 55) - 1))]
    text = [np.frombuffer(heads["texts"][0].as_py(), np.int32)]
    rest = table.filter(pa.array(kind == 0))
    value += [np.frombuffer(b"".join(rest["keys"].to_pylist()), np.uint64)]
    text += [np.frombuffer(b"".join(rest["texts"].to_pylist()), np.int32)]
    value, text = np.concatenate(value), np.concatenate(text)
    shared = np.bincount(text, minlength=len(size))
    live = (size > 0) & (size - shared < prefix(size))
    keep = live[text]
    value, text = value[keep], text[keep]
    order = np.lexsort((value, text))
    value = value[order].view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(shared[live])]), pa.int32()), pa.array(value))
    return pa.Table.from_arrays([pa.array(k1[live]), pa.array(k2[live]), pa.array(size[live]), pa.array((size - shared)[live]), lists], schema=schema)


def shared(docs: DataFrame, heavy: np.ndarray, total: int) -> DataFrame:
    """(k1, k2, n, unshared, ordered): sets that may link; their shared shingles in global order, rarest first. total: shingles of all sets."""
    n = max(4 * shuffle_partitions(docs.sparkSession), -(-total // RANGE))
    parts = docs.select("text").mapInArrow(_scatter(n, heavy), _PARTS)
    return parts.groupBy("bucket").applyInArrow(_count, _PARTS).groupBy("chunk").applyInArrow(_gather, _SETS)


def prefix_lists(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sets (node, n, unshared, ordered): (node, shingle) of their prefix positions, and (shingle, hub, far) of the lists in which two sets may link: hub and far are the list's smallest and largest node."""
    n = F.col("n")
    least = n - F.ceil(3 * n / 4) + 1 - F.col("unshared")
    index = n - F.ceil(6 * n / 7) + 1 - F.col("unshared")
    entries = sets.select("node", index.alias("index"), F.posexplode(F.slice("ordered", F.lit(1), F.greatest(least, F.lit(0)).cast("int"))).alias("i", "shingle"))
    entries = written(entries.select("node", "shingle", (F.col("i") < F.col("index")).alias("indexed")))
    # Of two sets that link, the smaller meets the other within its index positions.
    lists = entries.groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.max("indexed").alias("any")).where("any and far > hub")
    return entries, written(lists.select("shingle", "hub", "far"))


class Trie:
    """Ordered sets as a path-compressed trie; each node knows the longest rest and the smallest set below it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sets, self.sizes = sets, sizes
        self.values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        self.local = [x.astype(np.int64) for x in np.split(flat, ends[:-1])]
        order = sorted(range(len(sets)), key=lambda i: self.local[i].astype(">u4").tobytes())
        # A node: (labels of its edge, members that end here, children, longest rest below the edge, smallest set below it).
        self.root = self._build(order, 0)

    def _build(self, order: list[int], depth: int) -> tuple:
        """A node for sets that agree on their first `depth` labels. Children are built with an own stack, as paths can be long."""
        def common(lo: int, hi: int, at: int) -> int:
            a, b = self.local[order[lo]], self.local[order[hi - 1]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[at:n] != b[at:n])
            return at + int(differ[0]) if len(differ) else n

        nodes: list[list] = []
        stack = [(0, len(order), depth, -1)]
        while stack:
            lo, hi, at, parent = stack.pop()
            end = common(lo, hi, at)
            first = self.local[order[lo]]
            here = len(nodes)
            nodes.append([first[at:end], [], [], 0, 0])
            if parent >= 0:
                nodes[parent][2].append(here)
            i = lo
            while i < hi and len(self.local[order[i]]) == end:
                nodes[here][1].append(order[i])
                i += 1
            while i < hi:
                label, j = self.local[order[i]][end], i + 1
                while j < hi and self.local[order[j]][end] == label:
                    j += 1
                stack.append((i, j, end, here))
                i = j
        for node in reversed(nodes):
            kids = [nodes[c] for c in node[2]]
            node[3] = max((len(c[0]) + c[3] for c in kids), default=0)
            node[4] = min([*(int(self.sizes[m]) for m in node[1]), *(c[4] for c in kids)])
        self.nodes = nodes
        return nodes[0]

    def probe(self, values: np.ndarray, size: int, skip) -> Iterator[int]:
        """Members that link with the set (its ordered shared values; size counts the others too); skip(member) leaves one out."""
        at = np.searchsorted(self.values, values)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == values)] if len(self.values) else at[:0]
        inside = np.zeros(len(self.values) + 1, bool)
        inside[at] = True
        stack = [(0, 0)]
        while stack:
            here, overlap = stack.pop()
            edge, members, kids, rest, least = self.nodes[here]
            overlap += int(np.count_nonzero(inside[edge]))
            # What is left of either side can add no more than its length.
            left = len(at) - int(np.searchsorted(at, edge[-1], side="right")) if len(edge) else len(at) - overlap
            if overlap + min(rest, left) < required(size, least):
                continue
            for m in members:
                if overlap >= required(size, int(self.sizes[m])) and not skip(m):
                    yield m
            stack += [(k, overlap) for k in kids]


class Union:
    def __init__(self, labels: list) -> None:
        seen: dict = {}
        self.parent = [seen.setdefault(x, i) if x is not None else i for i, x in enumerate(labels)]
        self.groups = len(set(self.parent))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[j] = i
        self.groups -= i != j
        return i != j


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _shard_links(table: pa.Table) -> pa.Table:
    """Links of one shard (node, n, ordered, probe, known): every set against all, or the probes against the rest. known: a component, null at first."""
    table = table.sort_by("node")
    probes = pc.any(table["probe"]).as_py()
    if probes and pc.all(table["probe"]).as_py():
        return _EDGES.empty_table()
    nodes, probe, known = table["node"].to_pylist(), table["probe"].to_pylist(), table["known"].to_pylist()
    ordered = table["ordered"].combine_chunks()
    offsets, flat = ordered.offsets.to_numpy(), ordered.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    union = Union(known)
    links: list[tuple[int, int]] = []
    trie = Trie(sets, table["n"].to_numpy())
    for i in [i for i, p in enumerate(probe) if p] if probes else range(len(nodes)):
        if union.groups == 1:
            break
        for j in trie.probe(sets[i], int(trie.sizes[i]), lambda m, i=i: union.root(m) == union.root(i)):
            if union.join(i, j):
                links.append((nodes[i], nodes[j]))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def grouped(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(hub, node): which documents are compared with each other."""
    return written(entries.join(lists, "shingle").select("hub", "node").distinct())


def links(sets: DataFrame) -> DataFrame:
    """(a, b): enough links of sets to connect all that are connected."""
    entries, lists = prefix_lists(sets)
    members = grouped(entries, lists)
    sizes = members.groupBy("hub").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("node")).alias("p0"), F.min_by("node", F.xxhash64(F.lit(1), "node")).alias("p1"), F.min_by("node", F.xxhash64(F.lit(2), "node")).alias("p2"))
    sizes = written(sizes.select("hub", F.ceil(F.col("members") / SHARD).cast("int").alias("n_shards"), F.array("p0", "p1", "p2").alias("pivots")))
    own = F.pmod(F.xxhash64("node"), F.col("n_shards")).cast("int")
    everywhere = F.array_contains("pivots", F.col("node")) & (F.col("n_shards") > 1)
    dealt = members.join(sizes, "hub").select("hub", "node", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("n_shards") - 1)).otherwise(F.array(own))).alias("shard"))
    rows = dealt.join(sets.select("node", "n", "ordered"), "node").select("hub", "shard", "node", "n", "ordered", F.lit(False).alias("probe"), F.lit(None).cast("bigint").alias("known"))
    first = written(rows.groupBy("hub", "shard").applyInArrow(lambda t: _shard_links(t), "a long, b long"))
    large = sizes.where("n_shards > 1").select("hub")
    if large.isEmpty():
        return first
    return first.union(_late_links(sets, entries.join(lists.join(large, "hub"), "shingle"), components(first)))


def _late_links(sets: DataFrame, entries: DataFrame, reached: DataFrame) -> DataFrame:
    """Links that the shards of large groups couldn't show. entries (hub, far, shingle, node): lists of large groups; reached: components so far. Lists of one hub and one far node hold much the same sets and are one. In each, what isn't in its main component is held against the rest of the list, of which only sets of a similar size are asked; a long list is dealt to pieces, and each pair of pieces is a task's."""
    key = ["hub", "far"]
    rows = entries.select(*key, "node").distinct().join(reached, "node", "left").select(*key, "node", F.coalesce("component", "node").alias("known"))
    rows = written(rows.join(sets.select("node", F.length(F.bin("n")).alias("band")), "node"))
    main = rows.groupBy(*key, "known").agg(F.count("*").alias("m")).groupBy(*key).agg(F.max_by("known", F.struct("m", "known")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    rows = written(rows.join(main.select(*key, "main"), key))
    late = F.col("known") != F.col("main")
    # Sets that link differ in size by a third at most, so in their number of binary digits by one.
    pieces = rows.where(late).groupBy(*key).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("n_pieces"))
    shards = rows.groupBy(*key, "band").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("n_shards"))
    pieces, shards = written(pieces), written(shards)
    piece = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("n_pieces")).cast("int")
    shard = F.pmod(F.xxhash64("node"), F.col("n_shards")).cast("int")
    place = [*key, "band", "piece", "shard", "node", "known", "probe"]
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    asking = rows.where(late).withColumn("band", near).join(shards, [*key, "band"]).join(pieces, key)
    asking = asking.withColumn("piece", piece).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1))).withColumn("probe", F.lit(True))
    asked = rows.join(shards, [*key, "band"]).join(pieces, key)
    asked = asked.withColumn("shard", shard).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1))).withColumn("probe", F.lit(False))
    both = asking.select(place).union(asked.select(place)).join(sets.select("node", "n", "ordered"), "node")
    return written(both.groupBy(*key, "band", "piece", "shard").applyInArrow(lambda t: _shard_links(t), "a long, b long"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    table = profile(docs)
    rows = table.where("not heavy").drop("heavy")
    total = rows.agg(F.sum("n")).first()[0] or 0
    # A class without doc_id has a node made of its key.
    node = F.coalesce(F.min("doc_id"), F.col("k1").bitwiseOR(F.lit(-(1 << 63)).cast("bigint")))
    classes = written(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("own"), node.alias("node")))
    sets = shared(docs, heavy_shingles(table, total), total).groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("unshared").alias("unshared"), F.first("ordered").alias("ordered"))
    sets = written(sets.join(classes, ["k1", "k2"]).select("node", "n", "unshared", "ordered"))
    found = components(links(sets))
    named = written(classes.join(found, "node", "left").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "own", F.coalesce("component", "node").alias("__component")))
    if not named.where("own is null").isEmpty():
        names = named.groupBy("__component").agg(F.min("own").alias("__name"))
        named = written(named.join(names, "__component").select("__k1", "__k2", F.col("__name").alias("__component")))
    named = named.select("__k1", "__k2", "__component")
    rows = rows.join(named, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")) & (F.col("n") > 0), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("__component")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document names its component: one document of each group."""
    keep = written(join(docs).where("doc_id is null or doc_id = component_id").select("doc_id").distinct())
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
