"""Removal of repeated byte strings by Burrows-Wheeler transforms of shards, merged by interleave refinement.

A shard is a batch of documents. First a filter: of every `length`-byte window the least hashed gram (the leftmost of
equals) is its anchor. Equal windows have equal anchors, so pieces around an anchor's places decide all of its windows,
and text around anchors that occur once is left out. Equal pieces of a shard, compared by their bytes, are kept once.

Where pieces of one anchor meet, each shard's pieces have a transform of their own. Transforms are then merged as Holt
and McMillan do: the interleave, which says from which shard each suffix of the merged order comes, starts anyhow and is
refined by passes of the backward step, one symbol of common prefix a pass, without sorting suffixes again. Boundaries
that no pass has drawn are common prefixes (as in the Gap algorithm of Egidi and Manzini); suffixes with none between
them are a repeated interval. A symbol here is a block of `STRIDE` bytes, numbered by its bytes, and the backward step
goes back by as many, so that `length / STRIDE` passes are enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULTIPLIERS, U64, column_name, flat, mix, ranges
from .exchange import ANSWER, FIRST, SECOND, Records, bounds, looked_at, rows, unpacked

GRAM, STRIDE = 40, 20
CHUNK = 1 << 17  # positions hashed at once: arrays of 1 MB
MERGE_BYTES = 200_000
MANY = 50_000  # pieces of one anchor; beyond it each window travels alone, dealt by its own hash, to meet its like


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[20])


def _block_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every n consecutive bytes, put together from runs of 1, 2, 4, ... bytes, then mixed."""
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    run, size, factor, out, done = _BYTES[data], 1, MULTIPLIERS[21:22], None, 0
    while True:
        if n & size:
            out = run[:count].copy() if out is None else out * factor + run[done : done + count]
            done += size
        if done == n:
            return mix(out)
        longer = run[:-size] * factor
        longer += run[size:]
        run, size, factor = longer, 2 * size, factor * factor


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :])


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of each run at a are those of the run of the same size (1 at least) at b."""
    out, ends, begin = np.ones(len(sizes), bool), np.cumsum(sizes), 0
    while begin < len(sizes):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 8 * CHUNK, "right")))
        n = sizes[begin:stop]
        differ = data[ranges(a[begin:stop], n)] != data[ranges(b[begin:stop], n)]
        out[begin:stop] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        begin = stop
    return out


def _heads(data: np.ndarray, first: np.ndarray, size: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Where classes of equal runs begin, for runs in order of keys, the last two of which are halves of a digest.

    Bytes are compared with the first run's of a class; runs of one digest that differ, if ever, are classes of one each.
    """
    head = np.zeros(len(first), bool)
    head[:1] = True
    for key in (*keys, size):
        head[1:] |= key[1:] != key[:-1]
    begins = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)
    rest = np.flatnonzero(~head)
    wrong = rest[~_same(data, first[rest], first[begins[rest]], size[rest])]
    if len(wrong):
        head |= np.isin(begins, begins[wrong])
    return head


class _Batch:
    """The bytes of a batch, and its runs of windows with one anchor: where the anchor stands, the first and the last window."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, length: int):
        self.length = length
        self.data, self.offsets = flat(table.column(text_col))
        ids = table.column(id_col)
        self.ids = pc.fill_null(ids, 0).to_numpy().astype(np.int64)
        known = ids.is_valid().to_numpy()
        usable = np.flatnonzero(known & (np.diff(self.offsets) >= length))
        anchors, firsts, lasts, hashes = [], [], [], []
        n = len(self.data)
        open_row = np.zeros(n + 1, np.int32)  # windows that may start here
        np.add.at(open_row, self.offsets[usable], 1)
        np.add.at(open_row, self.offsets[usable + 1] - length + 1, -1)
        starts_here = np.cumsum(open_row)[:-1] > 0
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        for at in range(0, max(0, n - length + 1), CHUNK):
            stop = min(at + CHUNK, n - length + 1)
            grams = _block_hashes(self.data[at : stop + length - 1], GRAM)
            packed = (grams & ~U64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
            anchor = (_least(packed, length - GRAM + 1) & U64((1 << 24) - 1)).astype(np.int64)
            s = np.flatnonzero(starts_here[at:stop])
            if not len(s):
                continue
            a = anchor[s]
            cut = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(s) != 1) | edge[at + s[1:]]])
            head = np.flatnonzero(cut)
            firsts.append(at + s[head])
            lasts.append(at + s[np.append(head[1:], len(s)) - 1])
            anchors.append(at + a[head])
            hashes.append(grams[a[head]])
        none = np.zeros(0, np.int64)
        anchor, first, last = (np.concatenate([none, *x]) for x in (anchors, firsts, lasts))
        hashed = np.concatenate([np.zeros(0, np.uint64), *hashes])
        # Where a chunk's end parted a run it is one again: rows come in another order at each look, and pieces must not depend on it.
        whole = np.ones(len(anchor), bool)
        whole[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1)
        self.anchor, self.first, self.last, self.hash = anchor[whole], first[whole], last[np.append(whole[1:], True)[: len(last)]], hashed[whole]

    def records(self, buckets: int) -> tuple[Records, np.ndarray, np.ndarray]:
        found = Records(self.hash, buckets)
        return found, np.ones(len(found.low), bool), found.counts > 1

    def pieces(self, answers: pa.Table, buckets: int) -> _Pieces:
        found, *_ = self.records(buckets)
        meets, often = found.answered(answers)
        meets, often = meets[found.of], often[found.of]
        plain = meets & ~often
        first, last, group = self.first[plain], self.last[plain], self.hash[plain]
        if often.any():  # each window of its own, dealt by what it holds
            sizes = (self.last - self.first + 1)[often]
            alone = ranges(self.first[often], sizes)
            own = np.fromiter((xxhash.xxh3_64_intdigest(self.data[s : s + self.length]) for s in alone.tolist()), np.uint64, len(alone))
            first, last, group = np.concatenate([first, alone]), np.concatenate([last, alone]), np.concatenate([group, own])
        return _Pieces(self, first, last, group, buckets)


class _Pieces:
    """Pieces of a batch, equal ones as one class: in order of bucket, group and content, with the least (id, start) of each."""

    def __init__(self, batch: _Batch, first: np.ndarray, last: np.ndarray, group: np.ndarray, buckets: int):
        self.first, self.last = first, last
        size = last - first + batch.length
        view = memoryview(np.ascontiguousarray(batch.data))
        digests = b"".join(xxhash.xxh3_128_digest(view[a : a + n]) for a, n in zip(first.tolist(), size.tolist()))
        pair = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        row = np.searchsorted(batch.offsets, first, "right") - 1
        self.id, self.start = batch.ids[row], first - batch.offsets[row]
        bucket = (group % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort([self.start, self.id, size, pair[:, 1], pair[:, 0], group, bucket])
        head = _heads(batch.data, first[order], size[order], [group[order], pair[order, 0], pair[order, 1]])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(head) - 1
        self.pick = order[head]  # the least of each class, for start and id come last in the order
        self.group, self.size = group[self.pick], size[self.pick]
        self.bounds = bounds(bucket[self.pick])
        self.data = batch.data

    def blobs(self) -> dict[int, bytes]:
        out = {}
        for bucket, a, b in self.bounds:
            at = self.pick[a:b]
            head = np.empty((b - a, 4), np.int64)
            head[:, 0], head[:, 1], head[:, 2], head[:, 3] = self.group[a:b].view(np.int64), self.id[at], self.start[at], self.size[a:b]
            out[bucket] = np.int64(b - a).tobytes() + head.T.tobytes() + self.data[ranges(self.first[at], self.size[a:b])].tobytes()
        return out


def _transforms(symbols: np.ndarray, ends: np.ndarray, starts: np.ndarray, shard: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of each shard in order of their first `passes` symbols, one shard after another, and the symbol before each (0 at the start of a sequence).

    symbols: at every position, 0 where a sequence ends. starts: the first position of the piece that a position is in.
    ends: its last. Orders come from ranks, within the shard, of runs of 1, 2, 4, ... symbols.
    """
    n = len(symbols)
    position = np.arange(n)
    single = np.unique((shard << 32) | symbols, return_inverse=True)[1].astype(np.int64)
    rank, depth = single, 1

    def joined(front: np.ndarray, back: np.ndarray, step: int) -> np.ndarray:
        there = position + step * STRIDE
        follow = np.where((symbols > 0) & (there <= ends), back[np.minimum(there, n - 1)] + 1, 0)
        return np.unique((front << 32) | follow, return_inverse=True)[1].astype(np.int64)

    while depth < passes:
        if 2 * depth <= passes:
            rank, depth = joined(rank, rank, depth), 2 * depth
        else:
            rank, depth = joined(rank, single, depth), depth + 1
    order = np.sort((rank << 32) | position) & 0xFFFFFFFF
    before = order - STRIDE
    return order, np.where(before >= starts[order], symbols[np.maximum(before, 0)], 0)


def _merge(order: np.ndarray, symbols: np.ndarray, shard: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all shards in order of `passes` symbols, and the class of equal ones that each is in.

    order and symbols: suffixes of each shard in order, one shard after another, and the symbol before each; shard: of
    each suffix, from 0. In each shard as many suffixes are the empty ones of sequences, first in order, as symbols are 0.
    """
    kind = np.uint16 if shard[-1] < 1 << 16 else np.uint32  # 16 bits are sorted by digits
    n, come_from = len(order), shard.astype(kind)
    ended = come_from[symbols == 0]
    drawn = np.zeros(n, np.int64)  # classes of suffixes that agree so far; sequences that have ended agree with none
    before = np.empty(n, np.int64)
    for _ in range(passes):
        before[np.argsort(come_from, kind="stable")] = symbols
        inner = np.flatnonzero(before)
        key = np.sort((before[inner] << 32) | np.arange(len(inner)))
        step = inner[key & 0xFFFFFFFF]
        symbol, was = key >> 32, drawn[step]
        come_from = np.concatenate([ended, come_from[step]])
        new = np.concatenate([[True], (np.diff(symbol) != 0) | (np.diff(was) != 0)]) if len(step) else np.zeros(0, bool)
        drawn = np.concatenate([np.arange(len(ended)), len(ended) + np.cumsum(new) - 1])
    suffix = np.empty(n, np.int64)
    suffix[np.argsort(come_from, kind="stable")] = order
    return suffix, drawn


def _symbols(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the STRIDE bytes at each place, equal for equal bytes: by hash, and then compared."""
    blocks = np.lib.stride_tricks.sliding_window_view(data, STRIDE)
    _, first, number = np.unique(_block_hashes(data, STRIDE)[at], return_index=True, return_inverse=True)
    if (blocks[at] != blocks[at[first[number]]]).any():
        number = np.unique(np.ascontiguousarray(blocks[at]).view(f"V{STRIDE}").ravel(), return_inverse=True)[1]
    return number + 1


def repeated(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray, shards: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the pieces, one piece's after another's, equal one with a smaller (id, start).

    data: the pieces' bytes one after another; ids and starts: where each piece's first window stands; shards: the shard
    of each piece.
    """
    passes = length // STRIDE
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    wide = sizes + 1  # a position more, where the sequence that ends with the piece's last byte stops
    base = np.concatenate([[0], np.cumsum(wide)])
    piece = np.repeat(np.arange(len(sizes)), wide)
    inside = np.arange(base[-1]) - base[piece]
    filled = inside <= sizes[piece] - STRIDE
    symbols = np.zeros(base[-1], np.int64)
    symbols[filled] = _symbols(data, (offsets[piece] + inside)[filled])
    shard = np.unique(shards, return_inverse=True)[1].astype(np.int64)[piece]
    order, before = _transforms(symbols, base[piece + 1] - 1, base[piece], shard, passes)
    suffix, drawn = _merge(order, before, shard[order], passes)
    whole = inside[suffix] <= sizes[piece[suffix]] - length
    suffix, drawn = suffix[whole], drawn[whole]
    at = piece[suffix]
    own_id, own_start = ids[at], starts[at] + inside[suffix]
    order = np.lexsort([own_start, own_id, drawn])
    head = np.concatenate([[True], np.diff(drawn[order]) != 0]) if len(order) else np.zeros(0, bool)
    least = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else order
    later = (own_id[order] > own_id[least]) | (own_start[order] > own_start[least])
    windows = sizes - length + 1
    out = np.zeros(int(windows.sum()), bool)
    first_window = np.cumsum(windows) - windows
    out[first_window[at[order]] + inside[suffix[order]]] = later
    return out


def _meet_pieces(length: int):
    def answer(table: pa.Table) -> pa.Table:
        """A bit for each window of each record: whether it stands earlier too."""
        got = unpacked(table, SECOND)
        counts = [int(np.frombuffer(blob[:8], np.int64)[0]) for _, _, blob in got]
        heads = np.concatenate([np.frombuffer(blob[8 : 8 + 32 * n], np.int64).reshape(4, n) for (_, _, blob), n in zip(got, counts)], axis=1)
        data = np.concatenate([np.frombuffer(blob[8 + 32 * n :], np.uint8) for (_, _, blob), n in zip(got, counts)])
        group, ids, starts, sizes = heads
        shards = np.repeat(np.arange(len(got)), counts)  # a batch is a shard
        at = np.cumsum(sizes) - sizes
        view = memoryview(data)
        pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a : a + n]) for a, n in zip(at.tolist(), sizes.tolist())), np.uint64).reshape(-1, 2)
        order = np.lexsort([starts, ids, sizes, pair[:, 1], pair[:, 0], group])
        head = _heads(data, at[order], sizes[order], [group[order], pair[order, 0], pair[order, 1]])
        pick = order[head]  # one of each set of equal pieces, the earliest
        windows = sizes - length + 1
        first = np.cumsum(windows) - windows
        bits = np.zeros(int(windows.sum()), bool)
        earliest = pick[np.cumsum(head) - 1]
        later = order[(ids[order] > ids[earliest]) | (starts[order] > starts[earliest])]
        bits[ranges(first[later], windows[later])] = True
        # A piece alone in its group has nothing to meet: its own windows differ, for they stand differently to the anchor.
        new = np.concatenate([[True], np.diff(group[pick]) != 0])
        held = np.diff(np.append(np.flatnonzero(new), len(pick)))
        pick, new = pick[np.repeat(held > 1, held)], new[np.repeat(held > 1, held)]
        # Groups one after another, in runs of about MERGE_BYTES that never part a group.
        ends = np.cumsum(sizes[pick])
        begin = 0
        while begin < len(pick):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + MERGE_BYTES, "right")))
            while stop < len(pick) and not new[stop]:
                stop += 1
            run = pick[begin:stop]
            bits[ranges(first[run], windows[run])] |= repeated(data[ranges(at[run], sizes[run])], sizes[run], ids[run], starts[run], shards[run], length)
            begin = stop
        out, k = [], 0
        upto = np.cumsum(counts)
        for (bucket, batch, _), n, e in zip(got, counts, upto):
            size = int(windows[e - n : e].sum())
            out.append(rows(batch, ANSWER, {bucket: np.packbits(bits[k : k + size]).tobytes()}))
            k += size
        return pa.concat_tables(out)

    return answer


def deduplicated(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that stay.

    Removed is each byte covered by a string of `length` bytes (a multiple of 20) that also starts earlier: in a document
    of a smaller id, or in the same document before. Overlaps count; strings are judged on the input and never cross
    documents. Columns of the four names that docs brings already get underscores in front of the new ones.

    A null text is empty. A document without an id neither removes nor loses bytes. Rows that share an id count as one
    document, where the smaller start is the earlier. Of an empty table nothing comes back.
    """
    if length % STRIDE or length < GRAM:
        raise ValueError(f"length must be a multiple of {STRIDE} and at least {GRAM}")
    made = [column_name(docs, c) for c in ("n_bytes", "n_removed", "n_spans", "kept")]
    columns = docs.columns
    docs = docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long"))

    def first(table: pa.Table, batch: int, buckets: int) -> pa.Table:
        found, anchor, twice = _Batch(table, id_col, text_col, length).records(buckets)
        return rows(batch, FIRST, found.blobs(anchor, twice))

    def second(table: pa.Table, answers: pa.Table, batch: int, buckets: int) -> pa.Table:
        return rows(batch, SECOND, _Batch(table, id_col, text_col, length).pieces(answers, buckets).blobs())

    def last(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
        held = _Batch(table, id_col, text_col, length)
        pieces = held.pieces(answers, buckets)
        windows = pieces.size - length + 1
        begin = np.cumsum(windows) - windows
        bits = np.zeros(int(windows.sum()), bool)
        got = {bucket: blob for bucket, _, blob in unpacked(answers, ANSWER)}
        for bucket, a, b in pieces.bounds:
            size = int(windows[a:b].sum())
            bits[begin[a] : begin[a] + size] = np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=size)
        pick = pieces.pick[pieces.of]
        later = (pieces.id > pieces.id[pick]) | (pieces.start > pieces.start[pick])
        each = pieces.last - pieces.first + 1
        gone = bits[ranges(begin[pieces.of], each)] | np.repeat(later, each)
        at = ranges(pieces.first, each)[gone]
        edge = np.zeros(len(held.data) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        removed = np.cumsum(edge)[:-1] > 0
        begins = removed & ~np.concatenate([[False], removed[:-1]])
        heads = held.offsets[:-1][held.offsets[:-1] < len(removed)]
        begins[heads] |= removed[heads]
        kept = np.concatenate([[0], np.cumsum(~removed)])[held.offsets]
        spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[held.offsets])
        left = pa.Array.from_buffers(pa.large_binary(), len(held.ids), [None, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(held.data[~removed].tobytes())])
        total = np.diff(held.offsets)
        out = [pa.array(total), pa.array(total - np.diff(kept)), pa.array(spans), left.cast(pa.binary())]
        return pa.table([*(table.column(c) for c in columns), *out], names=[*columns, *made])

    schema = T.StructType([*docs.schema.fields])
    for name, kind in zip(made, ("long", "long", "long", "binary")):
        schema = schema.add(name, kind)
    return looked_at(docs, id_col, text_col, first, second, _meet_pieces(length), last, schema, MANY)
