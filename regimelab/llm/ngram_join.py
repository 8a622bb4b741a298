"""Set similarity self-join on word n-grams by chosen paths (Christiani and Pagh, 2017; the join is by Christiani, Pagh and Sivertsen, 2018).

Sets are embedded by minwise hashing into `COORDINATES` tokens, whose overlap estimates Jaccard similarity. A run sends
each set down a random tree: a node samples coordinates, each with probability 1 / (threshold x COORDINATES), and a set
goes on along the token that it has in each. Nodes of at most LEAF sets are leaves, compared by brute force; larger
ones split again on what they sample, down to DEPTH levels. Runs are repeated until a pair at the threshold is met with
probability `recall` even where all of its nodes are large.

Pairs that meet make candidate groups; inside a group, sets are compared exactly, block by block, as products of 0/1
matrices, and a block returns counts of links and a spanning forest, never the pairs. Equal sets are one class and
travel once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIERS, U64, complete, gram_hashes, mix, parts, slices, small_batches, trim, unclashed, with_totals, words, written
from .components import components, forest, verdicts

COORDINATES, DEPTH, LEAF = 64, 4, 64
SLACK = 0.2  # four standard deviations of an estimate from 64 coordinates
BLOCK_SETS, BLOCK_GRAMS = 1024, 1_000_000
_RNG = np.random.Generator(np.random.PCG64(5))
_FLIP = _RNG.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_FACTOR = _RNG.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def survival(threshold: float, depth: int) -> float:
    """Least chance that a pair at the threshold shares a node of this depth in a run: each node has Poisson(1) children that both sets enter."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(threshold: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, DEPTH))))


def gram_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of every row, one row's after another's, and where each row's start. A text of fewer words has one gram, all of them."""
    _, hashes, offsets = words(column)
    grams = gram_hashes(hashes, n)
    sizes = np.diff(offsets)
    keep = complete(offsets, n)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(grams)]
    row, grams = row[keep], grams[keep]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    whole = np.array([gram_hashes(hashes[offsets[i] : offsets[i + 1]], int(sizes[i]))[0] for i in short], np.uint64)
    row, grams = np.concatenate([row, short]), np.concatenate([grams, whole])
    order = np.lexsort([grams, row])
    row, grams = row[order], grams[order]
    new = np.concatenate([[True], (np.diff(row) != 0) | (grams[1:] != grams[:-1])]) if len(row) else np.zeros(0, bool)
    row, grams = row[new], grams[new]
    return grams, np.searchsorted(row, np.arange(len(sizes) + 1))


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """A set's node and check: the halves of 128 bits of its hash."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sketches(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minwise tokens: rows by coordinates; rows without grams have zeros."""
    out = np.zeros((len(offsets) - 1, COORDINATES), np.uint32)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        low, starts = (grams >> U64(32)).astype(np.uint32), offsets[:-1][filled]
        for i in range(COORDINATES):
            out[filled, i] = np.minimum.reduceat((low ^ _FLIP[i]) * _FACTOR[i], starts)
    return out


def _features(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            for part in slices(batch, "text", 2 << 20):
                grams, offsets = gram_sets(part.column("text"), n)
                sizes = np.diff(offsets)
                pairs = np.array([_digest(grams[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64).reshape(-1, 2)
                sketches = _sketches(grams, offsets)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "node": pa.array(pairs[:, 0]), "check": pa.array(pairs[:, 1]), "n_grams": pa.array(sizes, pa.int64()), "sketch": pa.array([s.tobytes() for s in sketches], pa.binary())})
        trim()

    return rows


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _steps(paths: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Each set goes on from each of its paths along the coordinates that the path's node samples."""
    chance = U64(min(1.0, 1 / (threshold * COORDINATES)) * 2**64 - 1)
    new_paths, new_nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in range(COORDINATES):
        drawn = np.flatnonzero(mix(paths * MULTIPLIERS[30] + MULTIPLIERS[i : i + 1] * U64(i + 1)) <= chance)
        new_paths.append(mix(paths[drawn] * MULTIPLIERS[31] + mix(sketches[drawn, i].astype(np.uint64) * U64(COORDINATES) + U64(i)) * MULTIPLIERS[32]))
        new_nodes.append(nodes[drawn])
    return pa.RecordBatch.from_pydict({"path": pa.array(np.concatenate(new_paths).view(np.int64)), "node": pa.array(np.concatenate(new_nodes))})


def _roots(runs: int, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sketches = batch.column("node").to_numpy(), _matrix(batch.column("sketch"))
            for run in range(runs):
                yield _steps(np.full(len(nodes), mix(np.array([run + 1], np.uint64))[0]), nodes, sketches, threshold)

    return rows


def _deeper(threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _steps(batch.column("path").to_numpy().view(np.uint64), batch.column("node").to_numpy(), _matrix(batch.column("sketch")), threshold)

    return rows


def _near(threshold: float):
    """In each leaf, edges from each set to the least set that its estimates reach."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            members = batch.column("members")
            nodes, sketches = members.flatten().field("node").to_numpy(), _matrix(members.flatten().field("sketch"))
            sizes = pa.compute.list_value_length(members).to_numpy()
            ends = np.cumsum(sizes)
            for end, size in zip(ends.tolist(), sizes.tolist()):
                s = sketches[end - size : end]
                x, y = np.nonzero(np.triu((s[:, None, :] == s[None, :, :]).mean(2) >= threshold - SLACK, 1))
                if len(x):
                    root = forest(size, x, y)
                    tied = np.flatnonzero(root != np.arange(size))
                    a.append(nodes[end - size : end][tied])
                    b.append(nodes[end - size : end][root[tied]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([none, *a])), "b": pa.array(np.concatenate([none, *b]))})

    return rows


def _candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """node and group of every set that meets another."""
    sketches = classes.select("node", "sketch")
    going = sketches.mapInArrow(_roots(runs_for(threshold, recall), threshold), "path long, node long")
    cells, deep = [], None
    for level in range(1, DEPTH + 1):
        partial, final = [F.count(F.lit(1)).alias("n"), F.min("node").alias("least")], [F.sum("n").alias("sets"), F.min("least").alias("least")]
        met = with_totals(going, "path", "node", partial, final, "sets > 1")
        met = written(met if level == DEPTH else met.drop("least"), "paths")
        cells.append(met.where(F.col("sets") <= LEAF).groupBy("path").agg(F.array_sort(F.collect_list("node")).alias("cell")).select("cell"))
        large = met.where(F.col("sets") > LEAF)
        if level == DEPTH:
            deep = large.select(F.col("node").alias("a"), F.col("least").alias("b"))
        elif large.isEmpty():
            break
        else:
            going = large.select("path", "node").join(sketches, "node").select("path", "node", "sketch").mapInArrow(_deeper(threshold), "path long, node long")
    leaves = cells[0]
    for more in cells[1:]:
        leaves = leaves.unionAll(more)
    # Most leaves of a run hold the same sets as those of another: they are compared once.
    spread = leaves.distinct().select(F.xxhash64("cell").alias("leaf"), F.explode("cell").alias("node")).join(sketches, "node")
    near = spread.groupBy("leaf").agg(F.collect_list(F.struct("node", "sketch")).alias("members")).select("members").mapInArrow(_near(threshold), "a long, b long")
    edges = near if deep is None else near.unionAll(deep)
    return components(edges).withColumnRenamed("component", "group")


def _row_sets(n: int):
    """The gram sets of class members, one text of each class. Rows may repeat the id and text that stand for a class: a task sends its set once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            trim()
            for part in slices(batch, "text", 4 << 20):
                fresh = [k for k, node in enumerate(part.column("node").to_pylist()) if node not in sent]
                part = part.take(pa.array(fresh, pa.int64()))
                grams, offsets = gram_sets(part.column("text"), n)
                sets = [grams[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                nodes, checks, right = part.column("node").to_pylist(), part.column("check").to_pylist(), np.zeros(len(sets), bool)
                for k, (s, node, check) in enumerate(zip(sets, nodes, checks)):
                    if node not in sent and _digest(s)[1] == check:
                        right[k] = True
                        sent.add(node)
                out = part.drop_columns(["text", "check"]).append_column("grams", pa.array([s.tobytes() for s in sets], pa.binary()))
                yield out.filter(pa.array(right))

    return rows


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the grams that both sides hold."""
    out = np.zeros((len(left), len(right)))
    a_row, b_row = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    a, b = np.concatenate(left), np.concatenate(right)
    a_values, a_at = np.unique(a, return_inverse=True)
    b_values, b_at = np.unique(b, return_inverse=True)
    common, in_a, in_b = np.intersect1d(a_values, b_values, assume_unique=True, return_indices=True)
    a_column, b_column = np.full(len(a_values), -1), np.full(len(b_values), -1)
    a_column[in_a], b_column[in_b] = np.arange(len(common)), np.arange(len(common))
    a_column, b_column = a_column[a_at], b_column[b_at]
    width = max(64, min(8192, 30_000_000 // (len(left) + len(right))))
    for at in range(0, len(common), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        mine, theirs = (a_column >= at) & (a_column < at + width), (b_column >= at) & (b_column < at + width)
        x[a_row[mine], a_column[mine] - at] = 1
        y[b_row[theirs], b_column[theirs] - at] = 1
        out += x @ y.T
    return out


def _linked(threshold: float):
    """Of blocks that meet: rows (a, links, null) with the documents that a set links to, and rows (a, null, b) of a spanning forest."""
    top, bottom = round(threshold * 1000), 1000

    def links(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
        both = _overlaps(left, right)
        size = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
        near = bottom * both >= top * (size - both)
        return np.nonzero(np.triu(near, 1) if same else near)

    def rows(table: pa.Table) -> pa.Table:
        trim()
        table = table.sort_by([("group", "ascending"), ("block", "ascending"), ("node", "ascending")])
        group, block = table.column("group").to_numpy(), table.column("block").to_numpy()
        node, docs = table.column("node").to_numpy(), table.column("docs").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        cut = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]]))
        grams = table.column("grams")
        at, weight, edge_a, edge_b = [], [], [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            once = lo + np.unique(node[lo:hi], return_index=True)[1]
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in grams.take(pa.array(once))]
            if i == j:
                x, y = links(sets, sets, True)
            else:
                mine = np.flatnonzero(block[once] == i)
                theirs = np.flatnonzero(block[once] == j)
                if not len(mine) or not len(theirs):
                    continue
                x, y = links([sets[k] for k in mine], [sets[k] for k in theirs], False)
                x, y = mine[x], theirs[y]
            if not len(x):
                continue
            count = np.bincount(x, docs[once[y]], len(once)) + np.bincount(y, docs[once[x]], len(once))
            some = np.flatnonzero(count)
            at.append(node[once[some]])
            weight.append(count[some].astype(np.int64))
            root = forest(len(once), x, y)
            tied = np.flatnonzero(root != np.arange(len(once)))
            edge_a.append(node[once[tied]])
            edge_b.append(node[once[root[tied]]])
        none = np.zeros(0, np.int64)
        at, weight, edge_a, edge_b = (np.concatenate([none, *x]) for x in (at, weight, edge_a, edge_b))
        return pa.table({"a": np.concatenate([at, edge_a]), "links": pa.array(np.concatenate([weight, np.zeros_like(edge_a)]), mask=np.repeat([False, True], [len(at), len(edge_a)])), "b": pa.array(np.concatenate([np.zeros_like(at), edge_b]), mask=np.repeat([True, False], [len(at), len(edge_a)]))})

    return rows


def joined(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id, n_links, component_id, kept.

    Two documents are linked when the Jaccard similarity of their sets of n-word sequences is at least threshold.
    class_id is the least id with an equal set, n_links the number of other documents linked, component_id the least id
    that links reach, kept whether that is the document itself.

    Words are `[^\\x20\\x09-\\x0D]+`; a text of fewer than n words has one sequence, all of them; a null text or one without
    words is linked with nothing. A document without an id comes back with nulls, no links, and kept. Rows that repeat
    an id count each as a document, and share that id's fate. Of an empty table nothing comes back. Other columns are
    ignored, whatever their names.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = texts.where(F.col("doc_id").isNotNull())
    small_batches(docs.sparkSession)
    features = unclashed(written(known.mapInArrow(_features(n), "doc_id long, node long, check long, n_grams long, sketch binary"), "features"))
    some = features.where("n_grams > 0")
    classes = written(some.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("docs"), F.first("check").alias("check"), F.first("n_grams").alias("n_grams"), F.first("sketch").alias("sketch")), "classes")
    groups = written(_candidates(classes, threshold, recall), "groups")

    held = groups.join(classes.drop("sketch"), "node")
    sums = held.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_grams").alias("all_grams"))
    total = sums.agg(F.coalesce(F.sum("all_grams"), F.lit(0)).alias("grams"), F.coalesce(F.sum("sets"), F.lit(0)).alias("sets")).first()
    bins = max(parts(total.grams, BLOCK_GRAMS), parts(total.sets, BLOCK_SETS))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("all_grams") / BLOCK_GRAMS)).cast("int")
    placed = held.join(sums, "group").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A group in one block shares a bin with others; a larger one has a bin for each pair of its blocks.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    placed = placed.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(bins))).otherwise(F.col("group")))
    placed = placed.withColumn("large", F.col("blocks") > 1)
    sets = known.join(held.select("node", "check", F.col("class_id").alias("doc_id")), "doc_id").mapInArrow(_row_sets(n), "doc_id long, node long, grams binary")
    met = placed.select("node", "group", "docs", "block", "i", "j", "bin", "large").join(sets.select("node", "grams"), "node")
    linked = written(met.groupBy("large", "bin", "i", "j").applyInArrow(_linked(threshold), "a long, links long, b long"), "links")

    verdict = verdicts(classes, linked)
    with_words = some.select("doc_id", "node").join(verdict, "node").select("doc_id", "class_id", "n_links", "component_id")
    rest = features.where("n_grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    nameless = texts.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    out = with_words.unionAll(rest).unionAll(nameless)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("doc_id", id_col)
