"""Three looks at the same texts with two meetings in between, as one lazy plan.

Documents are dealt into batches by a hash. At the first look each batch sends a record for each of its distinct hashes
to buckets of the hash space; a bucket answers with bits, in the order in which the batch sent them. The second look,
which knows those bits, sends records of what is left to other buckets, and the third applies the answers. A hash that
a third of all documents share is one record of each batch, so no bucket grows with the copies.

Records are sorted by bucket and hash, so an answer needs no keys, and a batch that is computed anew, after the loss of
an executor, understands answers to its first attempt.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_name, parts, placed, small_batches, text_bytes, trim

ROW = "bucket int, batch int, kind int, blob binary"
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 6 << 20
FIRST, HITS, SECOND, ANSWER = range(4)


def rows(batch: int, kind: int, blobs: dict[int, bytes]) -> pa.Table:
    n = len(blobs)
    return pa.table({"bucket": pa.array(blobs.keys(), pa.int32()), "batch": pa.array([batch] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "blob": pa.array(blobs.values(), pa.binary())})


def unpacked(table: pa.Table, kind: int) -> list[tuple[int, int, memoryview]]:
    """(bucket, batch, blob) of one kind, by bucket and batch."""
    got = [(b, a, memoryview(x.as_buffer())) for b, a, k, x in zip(table.column("bucket").to_pylist(), table.column("batch").to_pylist(), table.column("kind").to_pylist(), table.column("blob")) if k == kind]
    return sorted(got, key=lambda x: x[:2])


def only(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.compute.equal(table.column("kind"), kind)).select(["bucket", "batch", "kind", "blob"])


def bounds(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run."""
    if not len(sorted_buckets):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(sorted_buckets)) + 1, [len(sorted_buckets)]])
    return [(int(sorted_buckets[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:])]


class Records:
    """The distinct 64-bit hashes of a batch, dealt into buckets by the upper half; the lower half tells them apart there.

    of: the record of each given hash. Hashes that agree in bucket and lower half are one record; what follows a hit
    compares whole strings, so such a clash costs work, never a result.
    """

    def __init__(self, hashes: np.ndarray, buckets: int):
        key = ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        self.starts = np.flatnonzero(first)
        self.low = (key[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.bounds = bounds((key[first] >> np.uint64(32)).astype(np.int64))
        self.of = np.empty(len(key), np.int64)
        self.of[self.order] = np.cumsum(first) - 1
        self.counts = np.diff(np.append(self.starts, len(key)))

    def reduce(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        return how.reduceat(values[self.order], self.starts) if len(self.starts) else values[:0]

    def blobs(self, *flags: np.ndarray) -> dict[int, bytes]:
        """Of each bucket: lower halves, then a byte of two flags and a count for each, then 4 bytes for each count of 63 or more."""
        marks = np.minimum(self.counts, 63).astype(np.uint8)
        for i, flag in enumerate(flags):
            marks |= flag.astype(np.uint8) << np.uint8(6 + i)
        out = {}
        for bucket, a, b in self.bounds:
            counts = self.counts[a:b]
            out[bucket] = np.uint32(b - a).tobytes() + self.low[a:b].tobytes() + marks[a:b].tobytes() + counts[counts >= 63].astype(np.uint32).tobytes()
        return out

    def answered(self, table: pa.Table, kind: int = HITS) -> tuple[np.ndarray, np.ndarray]:
        """Two bits for each record, from the buckets' answers."""
        out = np.zeros((2, len(self.low)), bool)
        got = {bucket: blob for bucket, _, blob in unpacked(table, kind)}
        for bucket, a, b in self.bounds:
            out[:, a:b] = np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=2 * (b - a)).reshape(2, -1)
        return out[0], out[1]


def meet(many: int) -> Callable[[pa.Table], pa.Table]:
    """Answers to Records.blobs, two bits a record: whether it meets another document's (and one of them is flagged as a reference), and whether the batches hold it `many` times or more."""

    def answer(table: pa.Table) -> pa.Table:
        trim()
        got = unpacked(table, FIRST)
        sizes = [int(np.frombuffer(blob[:4], np.uint32)[0]) for _, _, blob in got]
        low = np.concatenate([np.frombuffer(blob[4 : 4 + 4 * n], np.uint32) for (_, _, blob), n in zip(got, sizes)])
        marks = np.concatenate([np.frombuffer(blob[4 + 4 * n : 4 + 5 * n], np.uint8) for (_, _, blob), n in zip(got, sizes)])
        counts = (marks & 63).astype(np.int64)
        counts[counts == 63] = np.concatenate([np.frombuffer(bytes(blob[4 + 5 * n :]), np.uint32) for (_, _, blob), n in zip(got, sizes)])
        order = np.argsort(low, kind="stable")
        first = np.concatenate([[True], np.diff(low[order]) != 0])
        starts, group = np.flatnonzero(first), np.cumsum(first) - 1
        marked = marks[order]
        held = np.diff(np.append(starts, len(low)))
        meets = ((held > 1) | np.logical_or.reduceat(marked & 128 > 0, starts)) & np.logical_or.reduceat(marked & 64 > 0, starts)
        often = np.add.reduceat(counts[order], starts) >= many
        bits = np.zeros((2, len(low)), bool)
        bits[0, order], bits[1, order] = meets[group], (meets & often)[group]
        ends = np.cumsum(sizes)
        tables = [rows(batch, HITS, {bucket: np.packbits(bits[:, e - n : e]).tobytes()}) for (bucket, batch, _), n, e in zip(got, sizes, ends)]
        return pa.concat_tables(tables)

    return answer


def looked_at(docs: DataFrame, id_col: str, text_col: str, first: Callable, second: Callable, meet_second: Callable, last: Callable, schema, many: int = 1 << 60) -> DataFrame:
    """The rows of last. first(table, batch, buckets), second(table, answers, batch, buckets) and last(table, answers, buckets) get a batch of docs."""
    small_batches(docs.sparkSession)
    total = text_bytes(docs, text_col)
    batches, buckets = parts(total, BATCH_BYTES), parts(total, BUCKET_BYTES)
    name, place = column_name(docs, "batch_no"), column_name(docs, "place")
    # A row's place is part of the key, so that rows that repeat, and those without an id, are dealt over all batches.
    docs = placed(docs, place)
    key = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.octet_length(F.col(f"`{text_col}`")), place), F.lit(batches)).cast("int")
    dealt = docs.withColumn(name, key).drop(place)

    def one(table: pa.Table) -> pa.Table:
        trim()
        return first(table, table.column(name)[0].as_py(), buckets)

    def two(table: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        if not table.num_rows:
            return rows(0, HITS, {})
        batch = table.column(name)[0].as_py()
        return pa.concat_tables([second(table, answers, batch, buckets), only(answers, HITS)])

    def both(table: pa.Table) -> pa.Table:
        trim()
        sent = only(table, SECOND)
        return pa.concat_tables([only(table, HITS), meet_second(sent)]) if sent.num_rows else only(table, HITS)

    def three(table: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        return last(table, answers, buckets)

    hits = dealt.groupBy(name).applyInArrow(one, ROW).groupBy("bucket").applyInArrow(meet(many), ROW)
    sent = dealt.groupBy(name).cogroup(hits.groupBy("batch")).applyInArrow(two, ROW)
    answers = sent.groupBy("bucket").applyInArrow(both, ROW)
    return dealt.groupBy(name).cogroup(answers.groupBy("batch")).applyInArrow(three, schema)
