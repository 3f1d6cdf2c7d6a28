"""Similarity join of documents on word n-grams by chosen paths.

A document is the set of its five-word shingles; two are linked if the Jaccard
similarity of their sets is 0.8 or more.

Candidates. Equal sets are joined first and go on as one. Each set then samples
``branching`` of its tokens, each the smallest under a hash that all sets share,
so that two sets sample the same with the probability of their similarity. Sets
that sampled the same token meet in a node; a node above the brute-force size is
split again on freshly sampled tokens, down to ``depth`` levels. No token can
split a group of near copies, so before a node is split its sets are compared
with one of its own, the pivot. Sets near the pivot are linked to it and leave.
What is similar to a set that leaves is, by the triangle inequality, not far from
the pivot either, and is linked to it by a lower threshold; so no pair is lost.
Small nodes are compared outright, larger ones that remain on the last level by
size bands and blocks. The whole is repeated in independent
runs. A linked pair stays together on one level with probability
1 - (1 - threshold) ** branching or more, which gives the chance per run over
all levels, and the number of runs until the target recall.

Within a node, sets are compared by 64 one-byte minhashes with a threshold far
below 0.8, and a node yields a spanning forest of its candidates, never all
pairs. Connected candidates form groups.

Verification. The sets of a group are compared exactly in blocks of bounded
size; a block yields the number of links of each set and a spanning forest of
the links. So every pair in a group is decided by its true similarity and the
links are counted in full. To count the links of a group of distinct near
copies is to look at each pair: the time grows with the square of such a group,
and what is shuffled for it with its sets times its blocks, that is, sets times
tokens / ``block_tokens``. What comes back is at most a few rows per set and
block.

Defined cases: a text below five words is one shingle of all its words; texts
without words, null ones included, have no set and no link; a null document id
comes last when a group's smallest id is chosen and is null only if all are;
repeated rows are copies like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import frugal, stage
from lingua_spark.llm.components import components

MINS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Join:
    """``branching``: tokens a set samples per node. ``brute``: sets that a node
    may hold to be compared outright, ``block_sets``: sketches compared at once
    in a larger one. ``slack``: how far below the threshold the estimate of a
    candidate may lie (four standard errors). ``leave``: the estimate from which
    a set need not be split further once it is linked to a pivot, ``link``: the
    lower one from which sets are linked to it. ``block_tokens``: tokens of sets
    compared exactly at once. ``broadcast_rows``: rows of 60 bytes or so that a
    broadcast may hold; more are joined by a shuffle."""

    words: int = 5
    threshold: float = 0.8
    branching: int = 2
    depth: int = 4
    recall: float = 0.9999
    brute: int = 64
    block_sets: int = 2048
    slack: float = 0.2
    leave: float = 0.7
    link: float = 0.35
    block_tokens: int = 200_000
    broadcast_rows: int = 100_000

    @property
    def runs(self) -> int:
        stay = (1 - (1 - self.threshold) ** self.branching) ** self.depth
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - stay)))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of words."""
    found = text.encode("utf-8", "surrogatepass").split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(found))):
        total = total * _MIX + hashes[k : k + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def fingerprint(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


class Sampler:
    """Minhashes and sampled tokens of a set, for every level and run."""

    def __init__(self, join: Join):
        self.join, self.levels, self.runs = join, join.depth, join.runs
        self.of_mins = odd_numbers(MINS, 11)
        self.of_picks = odd_numbers(self.levels * self.runs * join.branching, 17)

    def mins(self, tokens: np.ndarray) -> bytes:
        least = np.full(MINS, ~np.uint64(0))
        for at in range(0, len(tokens), 4096):
            least = np.minimum(least, (self.of_mins[:, None] * tokens[None, at : at + 4096]).min(1))
        return ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()

    def picks(self, tokens: np.ndarray) -> list[list[list[int]]]:
        """Sampled tokens (their hashes, which tell them apart) by level and run."""
        least = np.full(len(self.of_picks), ~np.uint64(0))
        for at in range(0, len(tokens), 4096):
            least = np.minimum(least, (self.of_picks[:, None] * tokens[None, at : at + 4096]).min(1))
        return least.view(np.int64).reshape(self.levels, self.runs, self.join.branching).tolist()


SKETCH = "fp binary, size int, mins binary, picks array<array<array<bigint>>>"
_SKETCH_ARROW = [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.list_(pa.int64())))]


def sketches(docs: DataFrame, join: Join, key: str, text: str) -> DataFrame:
    """``key``, fingerprint, size, minhashes and samples of each document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(join)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), join.words)
                if len(tokens):
                    rows.append((fingerprint(tokens), len(tokens), sampler.mins(tokens), sampler.picks(tokens)))
                else:
                    rows.append((None, 0, None, None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _SKETCH_ARROW)] if rows else [pa.array([], t) for t in _SKETCH_ARROW]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "fp", "size", "mins", "picks"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(sketch, f"key {kind}, {SKETCH}")


# Groups of rows that stand together after a shuffle


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns, across batches."""
    held, run = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:keys] != held:
                if run:
                    yield run
                held, run = row[:keys], []
            run.append(row[keys:])
    if run:
        yield run


class Forest:
    """Union of numbers below n; ``join`` tells whether it linked two parts."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def in_blocks(nodes: DataFrame, keys: list[str], blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks its own block is part of.

    A group of m rows in b blocks is thereby compared in b * (b + 1) / 2 tasks'
    worth of pairs, and no group is ever larger than two blocks. Columns
    ``block_a``, ``block_b`` name the pair, ``second`` the side.
    """
    dealt = nodes.withColumn("_blocks", blocks).withColumn(
        "_own", F.expr("cast(pmod(xxhash64(fp, 7), _blocks) as int)")
    )
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int"))))
    return dealt.select(
        *keys,
        F.least("_own", "_other").alias("block_a"),
        F.greatest("_own", "_other").alias("block_b"),
        (F.col("_own") > F.col("_other")).alias("second"),
        *[c for c in nodes.columns if c not in keys],
    )


def compare_nodes(join: Join):
    """Spanning forests of the candidates of each node."""
    least = (join.threshold - join.slack) * MINS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 4):
            if len(rows) < 2:
                continue
            second, fps, sizes, mins, guest = zip(*rows)
            sketch = np.frombuffer(b"".join(mins), np.uint8).reshape(len(rows), MINS)
            size, side, visitor = np.array(sizes), np.array(second), np.array(guest)
            split = side.any() and not side.all()
            forest, a, b = Forest(len(rows)), [], []
            for i in range(len(rows) - 1):
                rest = slice(i + 1, None)
                near = (sketch[i] == sketch[rest]).sum(1) >= least
                near &= np.minimum(size[i], size[rest]) >= join.threshold * np.maximum(size[i], size[rest])
                near &= ~(visitor[i] & visitor[rest])
                if split:
                    near &= side[rest] != side[i]
                for j in np.flatnonzero(near):
                    if forest.join(i, i + 1 + int(j)):
                        a.append(fps[i])
                        b.append(fps[i + 1 + int(j)])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return compare


def large_nodes_in_blocks(members: DataFrame, join: Join) -> DataFrame:
    """Rows of nodes that stayed large, by size band and block.

    A set meets those of its own band of sizes and, as a guest, of the next;
    sets further apart cannot be linked.
    """
    band = F.floor(F.log("size") / math.log(1 / join.threshold)).cast("int")
    own = F.struct(band.alias("band"), F.lit(False).alias("guest"))
    next_one = F.struct((band + 1).alias("band"), F.lit(True).alias("guest"))
    banded = members.withColumn("place", F.explode(F.array(own, next_one))).select(
        "path", "place.band", "fp", "size", "place.guest"
    )
    banded = stage(banded, "path_bands")
    counts = stage(banded.groupBy("path", "band").agg(F.count("*").alias("members")), "path_bands")
    counts = counts.filter("members > 1")
    dealt = in_blocks(banded.join(counts, ["path", "band"]), ["path", "band"], F.ceil(F.col("members") / join.block_sets))
    return dealt.drop("members")


def beside_pivots(members: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Members of large nodes with the pivot of their node, null if it is not
    near, and whether they leave: ``fp``, ``size``, ``run``, ``path``,
    ``pivot``, ``leaves``. A row is compared with one other, whatever the
    node's size."""
    named = members.select(F.col("pivot").alias("fp")).distinct().join(sets.select("fp", "size", "mins"), "fp")
    named = named.select(F.col("fp").alias("pivot"), F.col("size").alias("p_size"), F.col("mins").alias("p_mins"))
    beside = members.join(sets.select("fp", "mins"), "fp").join(named, "pivot")

    def sketches_of(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MINS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = (sketches_of(batch.column("mins")) == sketches_of(batch.column("p_mins"))).sum(1) / MINS
            size, theirs = batch.column("size").to_numpy().astype(float), batch.column("p_size").to_numpy().astype(float)
            alike = np.minimum(alike, np.minimum(size, theirs) / np.maximum(size, theirs))
            pivot = [p if near else None for p, near in zip(batch.column("pivot").to_pylist(), alike >= join.link)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("fp", "size", "run", "path")), pa.array(pivot, pa.binary()), pa.array(alike >= join.leave)],
                names=["fp", "size", "run", "path", "pivot", "leaves"],
            )

    return beside.mapInArrow(compare, "fp binary, size int, run int, path bigint, pivot binary, leaves boolean")


def pivot_edges(placed: DataFrame) -> DataFrame:
    """Edges that connect each set with all its pivots: the set with the
    smallest of them and that one with the others, which many sets share."""
    linked = placed.filter("pivot is not null").groupBy("fp").agg(F.collect_set("pivot").alias("pivots"))
    least = linked.select("fp", F.array_min("pivots").alias("least"), "pivots")
    own = least.select(F.col("fp").alias("a"), F.col("least").alias("b"))
    shared = least.select(F.explode(F.filter("pivots", lambda p: p != F.col("least"))).alias("a"), F.col("least").alias("b"))
    return own.filter("a <> b").unionByName(shared.distinct())


def candidates(sets: DataFrame, join: Join) -> DataFrame:
    """Edges between sets that may be linked, connecting all that are.

    Nodes hold only fingerprints and sizes; sketches join those that are
    compared.
    """
    sampled = F.transform(
        F.element_at("picks", 1),
        lambda tokens, run: F.transform(tokens, lambda t: F.struct(run.alias("run"), t.alias("token"))),
    )
    open_nodes = sets.select("fp", "size", F.inline(F.flatten(sampled))).select(
        "fp", "size", "run", F.xxhash64("run", "token").alias("path")
    )
    edges = None
    for level in range(1, join.depth + 1):
        open_nodes = stage(open_nodes, "path_nodes")
        # one order of sets per level, so that nodes with the same copies share a pivot
        pivot = F.min_by("fp", F.xxhash64("fp", F.lit(level)))
        counts = open_nodes.groupBy("path").agg(F.count("*").alias("members"), pivot.alias("pivot"))
        met = stage(open_nodes.join(counts.filter("members > 1"), "path"), "path_counts")
        last = level == join.depth
        large = met.filter(F.col("members") > join.brute).drop("members")
        any_large = not large.isEmpty()
        ready = met.filter(F.col("members") <= join.brute)
        dealt = ready.select(
            "path",
            F.lit(-1).alias("band"),
            F.lit(0).alias("block_a"),
            F.lit(0).alias("block_b"),
            F.lit(False).alias("second"),
            "fp",
            "size",
            F.lit(False).alias("guest"),
        )
        left = None
        if any_large:
            placed = stage(beside_pivots(large, sets, join), "path_pivots")
            linked = stage(pivot_edges(placed), "path_edges")
            edges = linked if edges is None else edges.unionByName(linked)
            left = placed.filter("not leaves").select("fp", "size", "run", "path")
        if any_large and last:
            dealt = dealt.unionByName(large_nodes_in_blocks(left.drop("run"), join))
        keys = ["path", "band", "block_a", "block_b"]
        drawn = dealt.join(sets.select("fp", "mins"), "fp").select(*keys, "second", "fp", "size", "mins", "guest")
        found = drawn.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare_nodes(join), "a binary, b binary")
        found = stage(found, "path_edges")
        edges = found if edges is None else edges.unionByName(found)
        if not any_large:
            break
        if not last:
            tokens = sets.select("fp", F.element_at("picks", level + 1).alias("by_run"))
            open_nodes = (
                left.join(tokens, "fp")
                .withColumn("token", F.explode(F.get("by_run", F.col("run"))))
                .select("fp", "size", "run", F.xxhash64("path", "token").alias("path"))
            )
    return edges.distinct()


def exact_links(join: Join):
    """Links of each set and a spanning forest of them, block by block.

    A row with null ``b`` carries the copies that ``a`` is linked with.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 3):
            rows = list({r[1]: r for r in rows}.values())  # one row per set
            if len(rows) < 2:
                continue
            second, fps, copies, sets = zip(*rows)
            side = np.array(second)
            if side.any() and not side.all():
                first, other = np.flatnonzero(~side), np.flatnonzero(side)
            else:
                first = other = np.arange(len(rows))
            linked = _linked([np.frombuffer(sets[i], np.uint64) for i in first], [np.frombuffer(sets[i], np.uint64) for i in other], join.threshold)
            if first is other:
                np.fill_diagonal(linked, False)
            weight = np.array(copies, np.int64)
            links = np.zeros(len(rows), np.int64)
            links[first] += linked @ weight[other]
            if first is not other:
                links[other] += linked.T @ weight[first]
            forest, a, b = Forest(len(rows)), [], []
            for i, j in zip(*np.nonzero(linked)):
                if forest.join(int(first[i]), int(other[j])):
                    a.append(fps[first[i]])
                    b.append(fps[other[j]])
            some = np.flatnonzero(links)
            a += [fps[i] for i in some]
            b += [None] * len(some)
            count = [0] * (len(a) - len(some)) + links[some].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(count, pa.int64())], names=["a", "b", "links"]
            )

    return compare


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each set on the left is linked with each on the right.

    Sizes of intersections come from products of 0/1 matrices over a few
    thousand tokens at a time; only tokens found on both sides matter.
    """
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    tokens_l, tokens_r = np.concatenate(left), np.concatenate(right)
    rows_l, rows_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    common = np.intersect1d(tokens_l, tokens_r)
    at_l, at_r = np.searchsorted(common, tokens_l), np.searchsorted(common, tokens_r)
    shared = np.zeros((len(left), len(right)), np.float32)
    if len(common):
        keep_l = common[np.minimum(at_l, len(common) - 1)] == tokens_l
        keep_r = common[np.minimum(at_r, len(common) - 1)] == tokens_r
        rows_l, at_l, rows_r, at_r = rows_l[keep_l], at_l[keep_l], rows_r[keep_r], at_r[keep_r]
        order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
        rows_l, at_l, rows_r, at_r = rows_l[order_l], at_l[order_l], rows_r[order_r], at_r[order_r]
        step = 2048
        for low in range(0, len(common), step):
            width = min(step, len(common) - low)
            part_l = slice(*np.searchsorted(at_l, [low, low + width]))
            part_r = slice(*np.searchsorted(at_r, [low, low + width]))
            one = np.zeros((len(left), width), np.float32)
            two = np.zeros((len(right), width), np.float32)
            one[rows_l[part_l], at_l[part_l] - low] = 1
            two[rows_r[part_r], at_r[part_r] - low] = 1
            shared += one @ two.T
    union = sizes_l[:, None] + sizes_r[None, :] - shared
    return shared >= threshold * union - 1e-6


def similar(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, its class and the number of its links.

    The class is the smallest key of all documents connected by links.
    """
    rows, classes = classify(docs, join, key, text)
    return rows.join(classes, "fp", "left").select(
        F.col("key").alias(key),
        F.when(F.col("fp").isNull(), F.col("key")).otherwise(F.col("class")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def classify(docs: DataFrame, join: Join, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Staged (key, fp) of every row, and (fp, component, class, links) of
    every set. Two components may share a class if a key repeats."""
    frugal(docs.sparkSession)
    sketched = stage(sketches(docs, join, key, text), "path_sketches")
    rows = sketched.select("key", "fp")
    sets = stage(
        sketched.filter("fp is not null")
        .groupBy("fp")
        .agg(
            F.min("key").alias("key"),
            F.count("*").alias("copies"),
            *[F.first(c).alias(c) for c in ("size", "mins", "picks")],
        ),
        "path_sets",
    )
    groups = stage(components(candidates(sets, join)), "path_groups").withColumnsRenamed({"node": "fp", "component": "grp"})
    members = stage(groups.join(sets.select("fp", "key", "copies", "size"), "fp"), "path_members")
    tokens = members.groupBy("grp").agg(F.sum("size").alias("tokens"))
    wanted = stage(members.join(tokens, "grp"), "path_wanted")

    def token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows of a task go on once
        for batch in batches:
            fps, sets_ = [], []
            for value in batch.column(0):
                tokens = shingles(value.as_py(), join.words)
                fp = fingerprint(tokens)
                if fp is not None and fp not in seen:
                    if len(seen) < join.broadcast_rows:
                        seen.add(fp)
                    fps.append(fp)
                    sets_.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets_, pa.binary())], names=["fp", "set"])

    texts = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text"))
    keys_wanted, few = wanted.select(F.col("key").alias("wanted_key")).distinct(), wanted.count() <= join.broadcast_rows
    if few:
        keys_wanted, wanted = F.broadcast(keys_wanted), F.broadcast(wanted)
    # a key only selects texts, so that a null or repeated one multiplies no rows
    found = (
        texts.join(keys_wanted, F.col("doc_key").eqNullSafe(F.col("wanted_key")), "left_semi")
        .select("doc_text")
        .mapInArrow(token_sets, "fp binary, set binary")
        .join(wanted.select("grp", "fp", "copies", "tokens"), "fp")
        .select("grp", "fp", "copies", "tokens", "set")
    )
    blocks = F.ceil(F.col("tokens") / join.block_tokens)
    dealt = in_blocks(found, ["grp"], blocks).drop("tokens")
    keys = ["grp", "block_a", "block_b"]
    links = stage(
        dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(exact_links(join), "a binary, b binary, links bigint"),
        "path_links",
    )
    linked = components(links.filter("b is not null").select("a", "b"))
    counts = links.filter("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("partners"))
    labelled = stage(
        sets.select("fp", "key", "copies")
        .join(linked.withColumnRenamed("node", "fp"), "fp", "left")
        .join(counts, "fp", "left")
        .select(
            "fp",
            "key",
            F.coalesce("component", "fp").alias("component"),
            (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("links"),
        ),
        "path_labelled",
    )
    smallest = stage(labelled.groupBy("component").agg(F.min("key").alias("class")), "path_classes")
    return rows, stage(labelled.join(smallest, "component").select("fp", "component", "class", "links"), "path_result")


def keep_one(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns.

    Kept is the document with the smallest key of its class; of repeated rows
    with that key and equal sets one stays. Documents without words stay.
    """
    rows, classes = classify(docs, join, key, text)
    rows = rows.filter("fp is not null")
    # decisions per key and set; only keys with a lost row take part in the join
    decided = stage(
        rows.groupBy("key", "fp")
        .agg(F.count("*").alias("times"))
        .join(classes.select("fp", "component", "class"), "fp")
        .withColumn("stays", F.col("key").eqNullSafe(F.col("class"))),
        "path_decided",
    )
    # one set speaks for a key that several sets of a component share
    spoken = (
        decided.filter("stays").groupBy(F.col("component").alias("spoken_of")).agg(F.min("fp").alias("spoken"))
    )
    decided = stage(
        decided.join(spoken, F.col("component") == F.col("spoken_of"))
        .select("key", "fp", "times", (F.col("stays") & (F.col("fp") == F.col("spoken"))).alias("stays")),
        "path_kept",
    )
    unsure = decided.filter("not stays or times > 1").select("key").distinct()
    names = docs.columns
    packed = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct(*[docs[c] for c in names]).alias("_row"))
    unsure = stage(unsure, "path_unsure")
    if unsure.count() <= join.broadcast_rows:
        unsure = F.broadcast(unsure)
    match = packed["_key"].eqNullSafe(unsure["key"])
    sure = packed.join(unsure, match, "left_anti").select("_row.*")

    @F.udf("binary", useArrow=True)
    def set_of(value):
        return fingerprint(shingles(value, join.words))

    set_of = set_of.asNondeterministic()
    open_rows = packed.join(unsure, match, "left_semi").withColumn("_fp", set_of("_text"))
    stays = decided.filter("stays").select(F.col("key").alias("_k"), F.col("fp").alias("_f"))
    stays = stays.join(unsure, F.col("_k").eqNullSafe(unsure["key"]), "left_semi")
    chosen = (
        open_rows.join(stays, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_fp") == F.col("_f")), "left_semi")
        .groupBy("_key", "_fp")
        .agg(F.first("_row").alias("_row"))
        .select("_row.*")
    )
    blank = open_rows.filter("_fp is null").select("_row.*")
    return sure.unionByName(chosen).unionByName(blank)


__all__ = ["Join", "candidates", "keep_one", "similar"]
