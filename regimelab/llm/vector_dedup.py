"""Near-duplicate vectors by hierarchical navigable small worlds (Malkov and Yashunin, 2018), one graph a shard.

Equal vectors are one class. Classes are dealt into shards by a hash; each shard builds its graph once, and every class
searches every shard, in blocks of queries of a shard's size. So a graph is copied as often as there are shards, and a
vector travels as often. A block widens its beam until an audit of some of its queries against the whole shard finds
what it must, and widens it further for each query whose beam holds nothing but links; the audit is held against the
final result too, and a block that fails it is compared with the whole shard. Cosines of what is found are taken anew in
double precision; blocks return counts of links and a spanning forest, never the pairs.

Insertions and searches run many at a time, as steps over arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, unclashed, written
from .components import forest, verdicts

LEAST_SHARDS, SHARD_BYTES = 8, 32 << 20  # bytes of a shard's vectors in double precision, whatever their length
DEGREE, BUILD_BEAM, BEAM, EXPAND = 16, 48, 32, 4
AUDITED, AUDIT_RECALL = 256, 0.999
MOST_CELLS = 1 << 25  # of a visited table


@dataclass
class Graph:
    """Vectors of length 1 in order of falling level; layer k holds the first len(layers[k]) of them, with their neighbours (-1: none)."""

    vectors: np.ndarray
    layers: list[np.ndarray]  # the lowest first

    def search(self, queries: np.ndarray, beam: int, to_layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest found of each query, falling by similarity: their numbers (-1: none) and similarities."""
        entry = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.layers) - 1, to_layer, -1):
            entry = _search(self.vectors, self.layers[k], queries, entry, 4)[0][:, :1]
            entry[entry >= len(self.layers[k - 1])] = 0  # not yet in the lower layer, which is still being built
        return _search(self.vectors, self.layers[to_layer], queries, entry, beam)


def _search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    rows = max(1, MOST_CELLS // max(1, len(neighbours)))
    if len(queries) > rows:
        found = [_search(vectors, neighbours, queries[at : at + rows], entry[at : at + rows], beam) for at in range(0, len(queries), rows)]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    n = len(queries)
    seen = np.zeros((n, len(neighbours)), bool)
    ids, near = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    width = min(entry.shape[1], beam)
    ids[:, :width] = entry[:, :width]
    near[:, :width] = np.einsum("qd,qkd->qk", queries, vectors[entry[:, :width]])
    done[:, :width] = False
    np.put_along_axis(seen, entry, True, 1)
    live = np.arange(n)
    while len(live):
        todo = np.where(done[live], -np.inf, near[live])
        pick = np.argpartition(-todo, min(EXPAND, beam) - 1, 1)[:, :EXPAND] if beam > EXPAND else np.tile(np.arange(beam), (len(live), 1))
        open_pick = np.isfinite(np.take_along_axis(todo, pick, 1))
        going = open_pick.any(1)
        live, pick, open_pick = live[going], pick[going], open_pick[going]
        if not len(live):
            break
        done[live[:, None], pick] = True
        around = neighbours[np.where(open_pick, ids[live[:, None], pick], 0)]
        around = np.where(open_pick[:, :, None], around, -1).reshape(len(live), -1)
        around.sort(1)
        fresh = around >= 0
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        fresh &= ~seen[live[:, None], np.maximum(around, 0)]
        row, col = np.nonzero(fresh)
        met = around[row, col]
        seen[live[row], met] = True
        close = np.full(around.shape, -np.inf, np.float32)
        close[row, col] = np.einsum("ij,ij->i", queries[live[row]], vectors[met])
        all_near = np.concatenate([near[live], close], 1)
        all_ids = np.concatenate([ids[live], np.where(fresh, around, -1)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        best = np.argpartition(-all_near, beam - 1, 1)[:, :beam]
        near[live], ids[live], done[live] = np.take_along_axis(all_near, best, 1), np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_done, best, 1)
    order = np.argsort(-near, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _chosen(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in falling order, those nearer to the query than to any chosen before, then the rest, up to `most`; -1 fills up."""
    n, width = ids.shape
    points = vectors[np.maximum(ids, 0)]
    between = np.einsum("qid,qjd->qij", points, points, optimize=True)
    usable = ids >= 0
    keep = np.zeros((n, width), bool)
    for j in range(width):
        blocked = (keep[:, :j] & (between[:, j, :j] > near[:, j : j + 1])).any(1) if j else np.zeros(n, bool)
        keep[:, j] = usable[:, j] & ~blocked & (keep.sum(1) < most)
    rank = np.where(keep, 0, np.where(usable, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, 1)[:, :most]
    out = np.full((n, most), -1, np.int64)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(usable, order, 1), np.take_along_axis(ids, order, 1), -1)
    return out


def _insert(vectors: np.ndarray, layer: np.ndarray, new: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
    """New points get their neighbours, which get the new points back and choose anew when they have too many."""
    most = layer.shape[1]
    out = _chosen(vectors, ids, near, most)
    layer[new] = out
    row, col = np.nonzero(out >= 0)
    target, source = out[row, col], new[row]
    touched, at = np.unique(target, return_inverse=True)
    old = layer[touched]
    r, c = np.nonzero(old >= 0)
    at, source = np.concatenate([at, r]), np.concatenate([source, old[r, c]])
    pair = np.unique(at * (len(vectors) + 1) + source)
    at, source = pair // (len(vectors) + 1), pair % (len(vectors) + 1)
    close = np.einsum("ij,ij->i", vectors[touched[at]], vectors[source])
    order = np.lexsort([-close, at])
    at, source, close = at[order], source[order], close[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    good = place < 3 * most
    ids = np.full((len(touched), 3 * most), -1, np.int64)
    near = np.full((len(touched), 3 * most), -np.inf, np.float32)
    ids[at[good], place[good]], near[at[good], place[good]] = source[good], close[good]
    for lo in range(0, len(touched), 1024):
        layer[touched[lo : lo + 1024]] = _chosen(vectors, ids[lo : lo + 1024], near[lo : lo + 1024], most)


def build(vectors: np.ndarray, draws: np.ndarray) -> tuple[Graph, np.ndarray]:
    """The graph of vectors of length 1, and the order that it puts them in. draws: a uniform number of each, which sets its level."""
    n = len(vectors)
    level = np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(DEGREE)).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    vectors, level = np.ascontiguousarray(vectors[order], np.float32), level[order]
    sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)] if n else [0]
    graph = Graph(vectors, [])
    above: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):
        size, most = sizes[k], 2 * DEGREE if k == 0 else DEGREE
        layer = np.full((size, most), -1, np.int32)
        first = min(size, 64)
        close = vectors[:first] @ vectors[:first].T
        np.fill_diagonal(close, -np.inf)
        ids = np.argsort(-close, 1, kind="stable")[:, : max(1, first - 1)]
        near = np.take_along_axis(close, ids, 1)
        layer[:first] = _chosen(vectors, np.where(np.isfinite(near), ids, -1), near, most)
        graph.layers = [layer, *above]
        at = first
        while at < size:
            stop = min(size, 2 * at, at + 1024)
            held = graph.layers[0]
            graph.layers[0] = held[:at]  # points before this batch, which it searches
            ids, near = graph.search(vectors[at:stop], BUILD_BEAM)
            graph.layers[0] = held
            _insert(vectors, held, np.arange(at, stop), ids, near)
            at = stop
        above = graph.layers
    return graph, order


def within(graph: Graph, queries: np.ndarray, threshold: float, audit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) with a similarity of at least threshold.

    audit: the queries whose pairs are also counted against all vectors. The beam doubles until the mean share of pairs
    found, over audited queries that have any, is AUDIT_RECALL of those a beam can hold, and then for each query whose
    beam holds nothing below the threshold. Where the final result falls short of the audit, all queries are compared
    with all vectors.
    """
    n = len(graph.vectors)
    if not n or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    beam = min(BEAM, n)
    truth = np.bincount(_near_all(graph.vectors, queries[audit], threshold)[0], minlength=len(audit))
    linked, truth = audit[truth > 0], truth[truth > 0]
    while beam < n and len(linked):
        found = (graph.search(queries[linked], beam)[1] >= threshold).sum(1)
        if (found / np.minimum(truth, beam)).mean() >= AUDIT_RECALL:
            break
        beam = min(2 * beam, n)
    todo, a, b = np.arange(len(queries)), [], []
    while len(todo):
        ids, near = graph.search(queries[todo], beam)
        full = near[:, -1] >= threshold if beam < n else np.zeros(len(todo), bool)
        row, col = np.nonzero((near >= threshold) & ~full[:, None])
        a.append(todo[row])
        b.append(ids[row, col])
        todo, beam = todo[full], min(2 * beam, n)
    a, b = np.concatenate(a), np.concatenate(b)
    if len(linked) and (np.bincount(a, minlength=len(queries))[linked] / truth).mean() < AUDIT_RECALL:
        return _near_all(graph.vectors, queries, threshold)
    return a, b


def _near_all(vectors: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of at least the threshold, by matrix products of all with all."""
    rows, a, b = max(1, MOST_CELLS // 4 // max(1, len(vectors))), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(queries), rows):
        q, v = np.nonzero(queries[at : at + rows] @ vectors.T >= threshold)
        a.append(at + q)
        b.append(v)
    return np.concatenate(a), np.concatenate(b)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash and the doubles of each vector; null for one that can have no link."""
    for batch in batches:
        column = batch.column("embedding")
        nodes, checks, blobs = [], [], []
        offsets, values = column.offsets.to_numpy(), column.values
        numbers = pa.compute.fill_null(values, np.nan).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_valid().to_pylist()):
            vector = numbers[a:b]
            if ok and len(vector) and np.isfinite(vector).all() and vector.any():
                blobs.append(vector.tobytes())
                digest = xxhash.xxh3_128_digest(blobs[-1])
                nodes.append(int.from_bytes(digest[:8], "little", signed=True))
                checks.append(int.from_bytes(digest[8:], "little", signed=True))
            else:
                blobs.append(None)
                nodes.append(None)
                checks.append(None)
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "node": pa.array(nodes, pa.int64()), "check": pa.array(checks, pa.int64()), "vector": pa.array(blobs, pa.binary())})


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True) if len(vectors) else 1.0
    scaled = vectors / scale
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _index(table: pa.Table) -> pa.Table:
    """The graph of a shard's vectors, of one dimension, as one blob."""
    table = table.sort_by("node")
    exact = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("vector")])
    nodes = table.column("node").to_numpy()
    draws = np.array([xxhash.xxh3_64_intdigest(int(x).to_bytes(8, "little", signed=True), 7) for x in nodes], np.float64) / 2.0**64
    graph, order = build(_unit(exact), draws)
    blob = pickle.dumps((graph.layers, exact[order], nodes[order], table.column("docs").to_numpy()[order]), protocol=5)
    return pa.table({"dim": table.column("dim").slice(0, 1), "shard": table.column("shard").slice(0, 1), "index": pa.array([blob], pa.binary())})


def _linked(threshold: float):
    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"a": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(none)
        layers, exact, nodes, docs = pickle.loads(left.column("index")[0].as_buffer())
        right = right.sort_by("node")
        mine = right.column("node").to_numpy()
        vectors = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in right.column("vector")])
        graph, queries = Graph(_unit(exact).astype(np.float32), layers), _unit(vectors).astype(np.float32)
        audit = np.arange(0, len(queries), max(1, len(queries) // AUDITED))
        q, v = within(graph, queries, threshold - 1e-5, audit)
        keep = mine[q] != nodes[v]
        q, v = q[keep], v[keep]
        good = np.zeros(len(q), bool)
        for at in range(0, len(q), 1 << 16):
            x, y = vectors[q[at : at + (1 << 16)]], exact[v[at : at + (1 << 16)]]
            x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
            cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            good[at : at + (1 << 16)] = cosine >= threshold
        q, v = q[good], v[good]
        count = np.bincount(q, docs[v], len(mine)).astype(np.int64)
        some = np.flatnonzero(count)
        both = np.concatenate([mine, nodes])
        root = forest(len(both), q, len(mine) + v)
        tied = np.flatnonzero(root != np.arange(len(both)))
        a = np.concatenate([mine[some], both[tied]])
        link = np.repeat([False, True], [len(some), len(tied)])
        return pa.table({"a": pa.array(a), "links": pa.array(np.concatenate([count[some], np.zeros(len(tied), np.int64)]), mask=link), "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), both[root[tied]]]), mask=~link)})

    return rows


def linked(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Vectors of one length are linked when their cosine, in double precision, is at least threshold. n_links counts the
    other vectors linked, component_id is the least id that links reach, kept says whether that is the vector itself.

    A vector that is null, empty or zero, or holds null or non-finite components, has no links. One without an id comes
    back with nulls, no links, and kept. Rows that repeat an id count each. Of an empty table nothing comes back. Other
    columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    features = unclashed(written(rows.mapInArrow(_features, "vec_id long, node long, check long, vector binary"), "vectors"))
    usable = features.where(F.col("vec_id").isNotNull() & F.col("node").isNotNull())
    classes = usable.groupBy("node").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("docs"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("dim", F.octet_length("vector")), "classes")
    # Blocks of queries are as large as shards, so neither grows with the table; the least of them sets how many tasks there are.
    shards = blocks = parts(classes.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0], SHARD_BYTES, LEAST_SHARDS)
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    index = written(placed.select("dim", "shard", "node", "docs", "vector").groupBy("dim", "shard").applyInArrow(_index, "dim int, shard int, index binary"), "graphs")
    queries = classes.select("dim", "node", "vector", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = written(spread.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_linked(threshold), "a long, links long, b long"), "links")
    verdict = verdicts(classes, found)
    out = usable.select("vec_id", "node").join(verdict, "node").select("vec_id", "n_links", "component_id")
    rest = features.where(F.col("vec_id").isNull() | F.col("node").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("vec_id", id_col)
