"""Removal of repeated word sequences by fixed-block anchors.

Every document is cut into blocks of `(window + 1) // 2` words that do not overlap: the index. Every rolling run of as
many words, of every document, probes it. Two equal windows always hold a whole block of either one, so no repeat is
missed. Each hit travels with the words around it to where its like meet. There hits are extended to the left and to the
right, a word a step, each step parting those whose words differ; what is together after so many steps on either side
holds the same window. Windows that touch make one maximal run.

Words are compared by 32 bits of their hashes each, so a window of 13 by 416.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULTIPLIERS, U64, column_name, complete, gram_hashes, mix, words
from .exchange import ANSWER, FIRST, SECOND, Records, bounds, looked_at, rows, unpacked


class _Batch:
    """The words of a batch, and where its documents can hold a window. Documents without an id hold none."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.words, self.hashes, self.offsets = words(table.column(text_col))
        ids = table.column(id_col)
        self.ids = pc.fill_null(ids, 0).to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
        known = ids.is_valid().to_numpy()[self.row]
        long = (np.diff(self.offsets) >= window)[self.row]
        grams = gram_hashes(self.hashes, self.block)
        self.probes = np.flatnonzero(complete(self.offsets, self.block) & (known & long)[: len(grams)])
        self.grams = grams[self.probes]

    def records(self, buckets: int) -> tuple[Records, np.ndarray, np.ndarray]:
        """Of each distinct probe: whether a document's own grid starts a block there, and whether documents of two ids hold it."""
        found = Records(self.grams, buckets)
        row = self.row[self.probes]
        anchor = (self.probes - self.offsets[row]) % self.block == 0
        ids = self.ids[row]
        return found, found.reduce(np.logical_or, anchor), found.reduce(np.minimum, ids) != found.reduce(np.maximum, ids)

    def hits(self, hit: np.ndarray, buckets: int) -> _Hits:
        return _Hits(self, hit, buckets)


class _Hits:
    """Hits of a batch with the words around them; equal ones are one record, in order of bucket and content, with the least id of each.

    first: the word at which a hit's leftmost window starts. whole: which of its windows, by their place from the left,
    lie in the document.
    """

    def __init__(self, batch: _Batch, hit: np.ndarray, buckets: int):
        side = batch.window - batch.block
        at = batch.probes[hit]
        self.first = at - side
        reach = self.first[:, None] + np.arange(batch.window + side)
        row = batch.row[at]
        lo, hi = batch.offsets[row], batch.offsets[row + 1]
        inside = (reach >= lo[:, None]) & (reach < hi[:, None])
        short = (batch.hashes & U64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        around = np.where(inside, short[np.clip(reach, 0, max(0, len(short) - 1))], np.uint32(0)) if len(at) else np.zeros((0, reach.shape[1]), np.uint32)
        starts = self.first[:, None] + np.arange(side + 1)
        self.whole = (starts >= lo[:, None]) & (starts + batch.window <= hi[:, None])
        self.id = batch.ids[row]
        bucket = ((batch.grams[hit] >> U64(32)) % U64(buckets)).astype(np.int64)
        digest = mix(around.astype(np.uint64) @ MULTIPLIERS[: around.shape[1]])
        order = np.lexsort([self.id, digest, bucket])
        sorted_around, sorted_bucket = around[order], bucket[order]
        head = np.concatenate([[True], (sorted_bucket[1:] != sorted_bucket[:-1]) | (sorted_around[1:] != sorted_around[:-1]).any(1)]) if len(at) else np.zeros(0, bool)
        self.of = np.empty(len(at), np.int64)
        self.of[order] = np.cumsum(head) - 1
        self.least = np.minimum.reduceat(self.id[order], np.flatnonzero(head)) if len(at) else self.id
        self.around = sorted_around[head]
        self.bounds = bounds(sorted_bucket[head])

    def blobs(self) -> dict[int, bytes]:
        return {k: np.uint32(b - a).tobytes() + self.least[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() + self.around[a:b].T.tobytes() for k, a, b in self.bounds}


def _parted(classes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Classes anew, numbered from 0, those apart whose `more` differ."""
    pair = (classes.astype(np.uint64) << U64(32)) | more.astype(np.uint64)
    return np.unique(pair, return_inverse=True)[1]


def _meet_hits(window: int):
    block = (window + 1) // 2
    side = window - block

    def answer(table: pa.Table) -> pa.Table:
        """For each record a bit a window, by its place from the left: whether a smaller id holds it."""
        got = unpacked(table, SECOND)
        sizes = [int(np.frombuffer(blob[:4], np.uint32)[0]) for _, _, blob in got]
        ids = np.concatenate([np.frombuffer(x[4 : 4 + 8 * n], np.uint8).reshape(8, n).T.copy().view(np.int64).ravel() for (_, _, x), n in zip(got, sizes)])
        around = np.concatenate([np.frombuffer(bytes(x[4 + 8 * n :]), np.uint32).reshape(window + side, n) for (_, _, x), n in zip(got, sizes)], axis=1)
        anchors = np.zeros(len(ids), np.int64)
        for k in range(side, side + block):
            anchors = _parted(anchors, around[k])
        left, right = [anchors], [np.unique(anchors, return_inverse=True)[1]]
        for k in range(side):
            left.append(_parted(left[-1], around[side - 1 - k]))
            right.append(_parted(right[-1], around[side + block + k]))
        bits = np.zeros((side + 1, len(ids)), bool)
        for k in range(side + 1):  # the window that starts k words right of the leftmost
            same = _parted(left[side - k], right[k])
            least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same, ids)
            bits[k] = ids > least[same]
        ends = np.cumsum(sizes)
        return pa.concat_tables([rows(batch, ANSWER, {bucket: np.packbits(bits[:, e - n : e]).tobytes()}) for (bucket, batch, _), n, e in zip(got, sizes, ends)])

    return answer


def deduplicated(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with n_words, n_removed and kept_text, the words that stay, joined by one space.

    Removed is each word covered by `window` consecutive words that also stand in a document of a smaller id, judged on
    the input. Columns of the three names that docs brings already get underscores in front of the new ones.

    A null or empty text has no words. A document without an id neither removes nor loses words. Rows that share an id
    remove nothing from each other. A text shorter than the window stays as it is. Of an empty table nothing comes back.
    """
    n_words, n_removed, kept_text = (column_name(docs, c) for c in ("n_words", "n_removed", "kept_text"))
    columns = docs.columns
    docs = docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long"))

    def first(table: pa.Table, batch: int, buckets: int) -> pa.Table:
        found, anchor, shared = _Batch(table, id_col, text_col, window).records(buckets)
        return rows(batch, FIRST, found.blobs(anchor, shared))

    def second(table: pa.Table, answers: pa.Table, batch: int, buckets: int) -> pa.Table:
        held = _Batch(table, id_col, text_col, window)
        found, *_ = held.records(buckets)
        return rows(batch, SECOND, held.hits(found.answered(answers)[0][found.of], buckets).blobs())

    def last(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
        held = _Batch(table, id_col, text_col, window)
        found, *_ = held.records(buckets)
        hits = held.hits(found.answered(answers)[0][found.of], buckets)
        earlier = np.zeros((hits.whole.shape[1], len(hits.least)), bool)
        got = {bucket: blob for bucket, _, blob in unpacked(answers, ANSWER)}
        for bucket, x, y in hits.bounds:
            earlier[:, x:y] = np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=len(earlier) * (y - x)).reshape(len(earlier), -1)
        hit, k = np.nonzero(hits.whole & (earlier.T[hits.of] | (hits.id > hits.least[hits.of])[:, None]))
        gone = hits.first[hit] + k
        edge = np.zeros(len(held.row) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[held.offsets]
        left = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), held.words.filter(pa.array(keep)).cast(pa.large_string()))
        total = np.diff(held.offsets)
        made = [pa.array(total), pa.array(total - np.diff(kept)), pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())]
        return pa.table([*(table.column(c) for c in columns), *made], names=[*columns, n_words, n_removed, kept_text])

    schema = T.StructType([*docs.schema.fields]).add(n_words, "long").add(n_removed, "long").add(kept_text, "string")
    return looked_at(docs, id_col, text_col, first, second, _meet_hits(window), last, schema)
