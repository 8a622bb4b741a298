"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, parts, placed, ranges, slices, small_batches, trim

MOST_CACHED = 200_000  # words a worker remembers before it starts anew
PUNCTUATION = ".,!?;:%&$#*"
GROUP_BYTES, ROW_BYTES = 16 << 20, 16  # of a group's texts; what a row counts for besides
LATIN = 0x250  # below it, Unicode's letters are old and stay what they are


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _byte_letters() -> dict[int, str]:
    """For each code point below LATIN, its UTF-8 bytes as byte-level tokenizers write them: printable bytes as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(LATIN)}


class WordIds:
    """Ids of whole texts for a tokenizer that lowers letters, drops white space and never joins across it.

    Each distinct word is encoded once: texts are cut at ASCII white space, and a word at the place where a letter a-z
    is followed by closing punctuation, which the tokenizer's own pattern always cuts too. A word of Latin letters alone
    is one piece for that pattern, so its ids come straight from the tokenizer's model. A word that holds the string of
    one of the tokenizer's added tokens, in any case, goes to the tokenizer as it stands, neither lowered nor cut.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        if any(c.isspace() for t in self.added for c in t):
            raise ValueError("added tokens that hold white space are not supported")
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)

    def _word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return [t.id for t in self.model.tokenize(word.lower())]
        if word.isalpha() and ord(max(word)) < LATIN and "\u0130" not in word:
            return [t.id for t in self.model.tokenize(word.lower().translate(_byte_letters()))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _slots(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in dict.fromkeys(words) if w not in self.slot]
        if fresh:
            found, sizes = [], []
            for word in fresh:
                got = self._word(word)
                found += got
                sizes.append(len(got))
            known = len(self.slot)
            end = int(self.start[known])
            while end + len(found) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while known + len(fresh) + 1 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.ids[end : end + len(found)] = found
            self.start[known + 1 : known + 1 + len(fresh)] = end + np.cumsum(sizes)
            self.slot.update(zip(fresh, range(known, known + len(fresh))))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def _parted(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each lowered word's first part, and its closing punctuation where that follows a letter a-z, or nothing."""
        asis, words, raw = np.zeros(len(words), bool), pc.ascii_lower(words), words
        for token in self.added:
            asis |= pc.match_substring(words, token).to_numpy(zero_copy_only=False).astype(bool)
        if asis.any():
            words = pc.if_else(pa.array(asis), raw, words)
        data, at = flat(words)
        size = np.diff(flat(pc.ascii_rtrim(words, characters=PUNCTUATION))[1])
        last = data[np.minimum(at[:-1] + np.maximum(size, 1), len(data)) - 1] if len(data) else np.zeros(len(words), np.uint8)
        whole = np.diff(at)
        size = np.where((size > 0) & (last >= ord("a")) & (last <= ord("z")) & ~asis, size, whole)

        def cut(begin: np.ndarray, length: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data[ranges(begin, length)])])

        return cut(at[:-1], size), cut(at[:-1] + size, whole - size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids start. Null texts are empty."""
        if len(self.slot) > MOST_CACHED:
            self.clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = split.offsets.to_numpy().astype(np.int64)
        values = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        coded = values.dictionary_encode()
        slots = []
        for part in self._parted(coded.dictionary):  # a new array, for ascii_lower errs on a slice
            each = part.dictionary_encode()
            known = self._slots([w.decode("utf-8", "replace") for w in each.dictionary.to_pylist()])
            slots.append(known[each.indices.to_numpy()])
        pairs = np.stack(slots, 1)
        sizes = self.start[pairs + 1] - self.start[pairs]
        of_word = self.ids[ranges(self.start[pairs].ravel(), sizes.ravel())]
        sizes = sizes.sum(1)
        begin = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        ids = of_word[ranges(begin[codes], sizes[codes])]
        return ids, np.concatenate([[0], np.cumsum(sizes[codes])])[offsets]


def _pieces(path: str, seq_len: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder = WordIds(path)  # of this task; it goes when the task ends
        for batch in batches:
            trim()
            for part in slices(batch, "text", 2 << 20):
                ids, starts = encoder.encode(part.column("text"))
                n = len(starts) - 1
                at = starts[1:] + np.arange(n)  # where each document's closing id goes
                full = np.full(len(ids) + n, end_id, np.uint32)
                keep = np.ones(len(full), bool)
                keep[at] = False
                full[keep] = ids
                starts = starts + np.arange(n + 1)
                totals = np.diff(starts)
                count = -(-totals // seq_len)
                doc = np.repeat(np.arange(n), count)
                begin = ranges(np.zeros(n, np.int64), count) * seq_len
                length = np.minimum(seq_len, totals[doc] - begin)
                lo = starts[doc] + begin
                raw = full.astype("<u4", copy=False)
                views = [raw[a:b].tobytes() for a, b in zip(lo.tolist(), (lo + length).tolist())]
                out = {
                    "doc_id": part.column("doc_id").take(pa.array(doc)),
                    "start": pa.array(begin),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(v) for v in views], pa.int64()),
                    "doc_tokens": pa.array(totals[doc]),
                    "place": part.column("place").take(pa.array(doc)),
                }
                if with_ids:
                    out["ids"] = pa.array(views, pa.binary())
                yield pa.RecordBatch.from_pydict(out)
        del encoder
        trim()

    return cut


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: the largest first, each into the first bin that has room; equal sizes in the given order.

    A tournament tree holds the room of every bin, each inner node the most room below it; going down to the left
    wherever the left side has room finds the first bin in a logarithm of the bins.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = np.zeros(n, np.int64)
    values = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = values[i], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i] = node - leaves
        room[node] -= size
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            top = left if left >= right else right
            if room[node] == top:
                break
            room[node] = top
            node //= 2
    return bins


def _packer(seq_len: int):
    def pack(group: pa.Table) -> pa.Table:
        trim()
        # Pieces stay where they are, and only their places are put in order: ids are not copied.
        place = pc.sort_indices(group.select(["doc_id", "start", "ids_crc32"]), [(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]).to_numpy()
        lengths = group.column("length").to_numpy()
        bins = np.zeros(len(lengths), np.int64)
        bins[place] = first_fit_decreasing(lengths[place], seq_len)
        order = place[np.argsort(bins[place], kind="stable")]
        ends = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(bins[order]) != 0]))
        offset = np.zeros(len(bins), np.int64)
        offset[order] = ends - np.repeat(ends[first], np.diff(np.append(first, len(bins))))
        sequence = (group.column("pack_group").to_numpy() << 32) | bins
        return group.drop_columns(["pack_group", "place"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def packed(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, group_bytes: int = GROUP_BYTES, seed: int = 3, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, the little-endian unsigned 32-bit ids).

    A document's ids, closed by end_id, are cut into pieces of seq_len and a rest. Pieces are dealt into random groups of
    about group_bytes of text, by a hash; each group packs its pieces by first-fit decreasing, on its own. Groups grow in
    number and never in size: the key takes in a piece's ids and its row's place, so neither a long document, nor an id
    or a row that repeats, falls into one of them whole.

    A null or empty text is the closing id alone. Strings of the tokenizer's added tokens become these tokens. Repeated
    rows are packed each. A null id stays null. Of an empty table nothing comes back. Other columns are ignored, whatever
    their names.
    """
    small_batches(docs.sparkSession)
    held = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + ROW_BYTES), F.lit(0))).first()[0]
    groups = parts(held, group_bytes)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    texts = placed(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "place")
    pieces = texts.mapInArrow(_pieces(tokenizer_path, seq_len, end_id, with_ids), schema + ", place int" + ", ids binary" * with_ids)
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "doc_tokens", "place"), F.lit(groups)).alias("pack_group")
    return pieces.select("*", key).groupBy("pack_group").applyInArrow(_packer(seq_len), schema + ", ids binary" * with_ids + ", sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
