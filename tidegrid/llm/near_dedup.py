"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set (a class; copies fall together here) has a MinHash signature and is posted under its
(coordinate, value) pairs. Pairs of classes that agree in at least ``min_matches`` coordinates are retained and then
confirmed on their full sets. Prefixes: with elements ordered from rare to frequent, two classes with that many common
elements share one among the first (elements - min_matches + 1) of each, so only these are posted; elements that one
class alone has are never posted. Skips: a pass that tries each class with its best partner comes first, and
the merge of posting lists then skips pairs that are already known to be in one component. The rest is confirmed
block by block within clusters of classes that such pairs join. Long lists and clusters are cut into block pairs that
go to different tasks; a task returns links that join the same classes as all its links would, not all of them.

A class is lost only if it agrees with a linked one in fewer than ``min_matches`` coordinates; with the defaults (48,
20) and a similarity of 0.8 or more the chance is below 1e-8 a pair. Shingles are compared as 64-bit hashes.

Null and empty texts, and texts of white space alone, have an empty set and link with nothing. Very long texts are read
whole, one at a time, and their sets are compared whole. An empty table gives an empty result. Rows that repeat a
doc_id or have none are rows like others: they get the component of their text, whose id is the smallest doc_id in it
(null if it has none). Ties don't arise: components don't depend on order.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, discard, materialize, runs, slices

COORDINATES = 48
MIN_MATCHES = 20
#: Classes of a posting list that one task compares with as many others.
BLOCK = 2048
#: Members that one task holds against a hub's set.
GROUP = 256
#: Shingles of a cluster's block, about: a set goes to as many block pairs as its cluster has blocks.
VOLUME = 1 << 21


class Words(dict):
    """64-bit hashes of words, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, n: int, words: Words) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; a shorter sequence is one shingle as a whole."""
    hashes = np.array(list(map(words.__getitem__, text.lower().split())), np.uint64)
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    got = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        got = mix(got + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(got)


def signature(got: np.ndarray, coordinates: int) -> np.ndarray:
    low = (got & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (got >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty(coordinates, np.uint32)
    for i in range(coordinates):  # another multiply-shift hash for each coordinate
        x = (low + np.uint32(i * 0x85EBCA6B & 0xFFFFFFFF)) * (high + np.uint32(2 * i))
        x ^= x >> np.uint32(15)
        x *= np.uint32((0xC2B2AE35 + 2 * i * 0x27D4EB2F) & 0xFFFFFFFF | 1)
        out[i] = (x ^ (x >> np.uint32(13))).min()
    return out.view(np.int32)


def set_key(got: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(got.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, and row_key: by which a class finds its text again; rows of one id differ in it if their texts do."""
    docs = columns(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), "text")


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def signatures(docs: DataFrame, n: int, coordinates: int) -> DataFrame:
    """doc_id, row_key, n_shingles, h1 and h2 (128 bits that name the set), signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, "text"):
            counts, keys, found = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                got = shingles(text or b"", n, words)
                counts.append(len(got))
                keys.append(set_key(got))
                found.append(signature(got, coordinates) if len(got) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(counts, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "row_key", "n_shingles", "h1", "h2", "signature"],
            )

    return _numbered(docs).mapInArrow(run, "doc_id long, row_key long, n_shingles long, h1 long, h2 long, signature array<int>")


def prefixes(classes: DataFrame, min_matches: int) -> DataFrame:
    """class_id, element: the rare elements under which a class is posted."""
    element = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    elements = classes.select("class_id", F.posexplode("signature").alias("at", "value")).select("class_id", element.alias("element"))
    shared = elements.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    by_class = W.partitionBy("class_id")
    return (
        elements.join(shared, "element")
        .withColumns({"k": F.row_number().over(by_class.orderBy("n", "element")), "m": F.count("*").over(by_class)})
        .where(F.col("k") <= F.col("m") - (min_matches - 1))
        .select("class_id", "element")
    )


def blocked(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """rows with p, q and mine: each key's rows are dealt into its blocks (of sizes), and each row goes to every pair of blocks (p <= q) that has its own (mine)."""
    return (
        rows.join(sizes.select(key, F.col("blocks").cast("int").alias("blocks")), key)
        .withColumn("mine", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")})
        .drop("blocks", "other")
    )


def block_sides(table: pa.Table, key: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of the left and the right block of each block pair in ``table``, and whether they are different blocks."""
    k, p, q, mine = (table.column(c).to_numpy() for c in (key, "p", "q", "mine"))
    cut = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(k)], strict=True):
        rows = np.arange(s, e)
        yield (rows[mine[s:e] == p[s]], rows[mine[s:e] == q[s]], True) if p[s] != q[s] else (rows, rows, False)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge a vertex, with the same components as the edges (a, b)."""
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    kept = label != np.arange(len(names))
    return names[label[kept]], names[kept]


def _pairs(found: list[tuple[np.ndarray, ...]], width: int, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]), pa.int64()) for i in range(width)], names=names)


def open_pairs(postings: DataFrame, classes: DataFrame, components: DataFrame, min_matches: int, num: int, den: int, best: bool) -> DataFrame:
    """Of the pairs in one posting list, of different components so far, that agree in enough coordinates: with best,
    of each class the pair that agrees in most (a, b); without, pairs (a, b) that join the same classes as all would."""
    labelled = postings.join(components, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    mixed = labelled.groupBy("element").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("lo < hi")
    members = blocked(labelled, "element", mixed).join(classes.select("class_id", "n_shingles", "signature"), "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["element", "p", "q"]):
            cls, comp, size = (table.column(c).to_numpy() for c in ("class_id", "component", "n_shingles"))
            sig = table.column("signature").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
            found = []
            for left, right, two in block_sides(table, "element"):
                if not two and (comp[left] == comp[left[0]]).all():
                    continue
                for mine, others in [(left, right), (right, left)] if two and best else [(left, right)]:
                    got = []
                    for k in range(0, len(mine), 64):
                        x = mine[k : k + 64]
                        open_ = comp[x, None] != comp[None, others]
                        open_ &= den * np.minimum(size[x, None], size[None, others]) >= num * np.maximum(size[x, None], size[None, others])
                        i, j = np.nonzero(open_)
                        for z in range(0, len(i), 8192):
                            a, b = x[i[z : z + 8192]], others[j[z : z + 8192]]
                            matches = (sig[a] == sig[b]).sum(1)
                            ok = np.flatnonzero(matches >= min_matches)
                            if best and len(ok):
                                ok = ok[np.lexsort((-cls[b[ok]], matches[ok], a[ok]))]
                                ok = ok[np.append(a[ok][1:] != a[ok][:-1], True)]
                            got.append((cls[a[ok]], cls[b[ok]], matches[ok]))
                    if best:
                        found += got
                    elif got:
                        a, b = forest(*(np.concatenate([g[i] for g in got]) for i in range(2)))
                        found.append((a, b, np.zeros(len(a), np.int64)))
            yield _pairs(found, 3, ["a", "b", "matches"])

    key = ["element", "p", "q"]
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = members.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, matches long")
    if not best:
        return found.select("a", "b").distinct()
    top = found.groupBy("a").agg(F.max(F.struct("matches", (-F.col("b")).alias("b"))).alias("top"))
    return top.select((-F.col("top.b")).alias("a"), F.col("a").alias("b"))


def shingle_sets(wanted: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """class_id, shingles (their sorted hashes) of the classes in ``wanted`` (class_id, row_key, h1, h2), from one row's text each."""
    rows = wanted.join(_numbered(docs).select("row_key", "text"), "row_key").select("class_id", "h1", "h2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = Words(), set()
        for batch in slices(batches, "text"):
            names, sets = [], []
            for c, h1, h2, text in zip(*(batch.column(x).to_pylist() for x in ("class_id", "h1", "h2")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if c in done:  # the row repeats
                    continue
                got = shingles(text or b"", n, words)
                if set_key(got) == (h1, h2):  # else another text under the same key
                    done.add(c)
                    names.append(c)
                    sets.append(got.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["class_id", "shingles"])

    return rows.mapInArrow(run, "class_id long, shingles array<long>")


def _sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64).tolist()
    flat = column.flatten().to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in itertools.pairwise(ends)]


def confirmed_within(clusters: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the same classes as all links between different components of one cluster would.

    clusters: class_id, component, cluster. Full sets are held against each other block by block."""
    with_sets = clusters.join(sets, "class_id")
    sizes = with_sets.groupBy("cluster").agg(F.ceil(F.sum(F.size("shingles")) / VOLUME).alias("blocks"))
    members = blocked(with_sets, "cluster", sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cluster", "p", "q"]):
            cls, comp = (table.column(c).to_numpy() for c in ("class_id", "component"))
            sets = _sets(table.column("shingles"))
            size = np.array([len(s) for s in sets])
            found = []
            for left, right, two in block_sides(table, "cluster"):
                if not len(left) or not len(right) or not two and (comp[left] == comp[left[0]]).all():
                    continue
                known = np.unique(np.concatenate([sets[r] for r in right]))
                flat = np.searchsorted(known, np.concatenate([sets[r] for r in right]))
                ends = np.cumsum(size[right]) - size[right]
                mark = np.zeros(len(known) + 1, bool)
                got = []
                for x in left:
                    open_ = (comp[right] != comp[x]) & (den * np.minimum(size[right], size[x]) >= num * np.maximum(size[right], size[x]))
                    if not open_.any():
                        continue
                    at = np.searchsorted(known, sets[x])
                    at = at[known[np.minimum(at, len(known) - 1)] == sets[x]]
                    mark[at] = True
                    common = np.add.reduceat(mark[flat], ends, dtype=np.int64)
                    mark[at] = False
                    ok = right[open_ & (den * common >= num * (size[right] + size[x] - common))]
                    got.append((np.full(len(ok), cls[x]), cls[ok]))
                if got:
                    found.append(forest(*(np.concatenate([g[i] for g in got]) for i in range(2))))
            yield _pairs(found, 2, ["a", "b"])

    key = ["cluster", "p", "q"]
    parts = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough. ``sets``: class_id, shingles."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("class_id"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("class_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, role, cls = (batch.column(c).to_pylist() for c in ("a", "role", "class_id"))
            links = []
            for k, got in enumerate(_sets(batch.column("shingles"))):
                if not role[k]:
                    hub, hub_set = a[k], got
                elif hub == a[k]:
                    common = len(np.intersect1d(hub_set, got, assume_unique=True))
                    if den * common >= num * (len(hub_set) + len(got) - common):
                        links.append((hub, cls[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])

    parts_n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.unionByName(hubs).join(sets, "class_id").select("a", "part", "role", "class_id", "shingles")
    return rows.repartition(parts_n, "a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """class_id, component (the smallest id reachable) of every class with an edge: contraction with pointer jumping."""
    labels = None
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("up")), "parents")
        while True:  # each vertex looks at its parent's parent
            above = parent.select(F.col("v").alias("up"), F.col("up").alias("top"))
            jumped = materialize(parent.join(above, "up").select("v", "up", "top"), "jumped")
            settled = jumped.where("up <> top").isEmpty()
            discard(parent)
            parent = jumped.select("v", F.col("top").alias("up"))
            if settled:
                break
        if labels is None:
            new = parent.select(F.col("v").alias("class_id"), F.col("up").alias("component"))
        else:
            new = labels.join(parent, labels["component"] == parent["v"], "left").select("class_id", F.coalesce("up", "component").alias("component"))
        new = materialize(new, "labels")
        x, y = parent.select(F.col("v").alias("a"), F.col("up").alias("x")), parent.select(F.col("v").alias("b"), F.col("up").alias("y"))
        left = edges.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        contracted = materialize(left, "edges")
        discard(edges, parent, *([labels] if labels is not None else []))
        labels, edges = new, contracted
    return labels if labels is not None else edges.select(F.col("a").alias("class_id"), F.col("b").alias("component"))


def _components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, coordinates: int = COORDINATES, min_matches: int = MIN_MATCHES) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with h1 and h2, and h1, h2, doc_id and component of each class."""
    if not 0 < min_matches <= coordinates:
        raise ValueError("min_matches must be between 1 and coordinates")
    rows = materialize(signatures(docs, shingle, coordinates), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    postings = materialize(prefixes(classes, min_matches), "postings")
    nothing = classes.select("class_id", F.col("class_id").alias("component"))
    pairs = materialize(open_pairs(postings, classes, nothing, min_matches, num, den, True), "pairs")
    # a class without a partner now has none later, as components only grow
    still = materialize(pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct(), "open")
    wanted = still.join(classes.select("class_id", "row_key", "h1", "h2"), "class_id")
    sets = materialize(shingle_sets(wanted, docs, shingle), "sets")
    links = materialize(confirmed(pairs, sets, num, den), "links")
    components = connected_components(links)
    near = open_pairs(postings.join(still, "class_id", "left_semi"), classes, components, min_matches, num, den, False)
    label = materialize(still.join(components, "class_id", "left").withColumn("component", F.coalesce("component", "class_id")), "open")
    clusters = connected_components(near.unionByName(label.select(F.col("component").alias("a"), F.col("class_id").alias("b"))))
    clusters = label.join(clusters.withColumnRenamed("component", "cluster"), "class_id")
    more = materialize(confirmed_within(clusters, sets, num, den), "links")
    components = connected_components(links.unionByName(more))
    named = classes.select("class_id", "h1", "h2", "doc_id").join(components, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    named = materialize(named, "components")
    discard(classes, postings, pairs, still, sets, links, label, more)
    return rows, named


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept. Linked: den * intersection >= num * union."""
    rows, named = _components(docs, **how)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = named.join(smallest, "component").select("h1", "h2", "component_id")
    rows = rows.select("doc_id", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near-duplicates; all columns stay.

    Rows with empty sets link with nothing and all stay. Of a group, one row with its smallest id stays, or one without
    an id only if the group has none; which of several texts under that id is settled by their hash. Rows of different
    groups never displace each other, whether they share an id or have none. Columns may have any names."""
    rows, named = _components(docs, **how)
    members = rows.where("n_shingles > 0").join(named.select("h1", "h2", "component"), ["h1", "h2"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("row_key").alias("key")))
    kept = members.groupBy("component").agg(first.alias("first")).select("first.*")
    own_id, text = F.col("`doc_id`").cast("long"), F.col("`text`")
    has_words = F.coalesce(text.rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), has_words.alias("words"), own_id.isNull().alias("no_id"), F.coalesce(own_id, F.lit(0)).alias("id"), _row_key().alias("key"))
    one = packed.where("words").join(kept, ["no_id", "id", "key"], "left_semi").dropDuplicates(["no_id", "id", "key"])
    return one.select("row.*").unionByName(packed.where("not words").select("row.*"))
