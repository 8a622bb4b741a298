"""Audio fingerprints from chroma, and their alignment.

A recording becomes frames of energy in 12 pitch classes. Sixteen filters slide over the smoothed frames; each compares
sums of rectangles, read off an integral image, and is quantised to two bits in Gray code: one 32-bit integer a frame.
Recordings that share integers are aligned by a histogram of offsets, and judged by the share of bits that differ.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, ranges, written

RATE, FRAME, HOP = 11025, 4096, 1365
FRAMES_AT_ONCE = 256  # spectra held at a time, however long a recording is
LOW_HZ, HIGH_HZ = 28.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH = 16
#: Filters: kind, first pitch class, pitch classes, frames. By rule: each kind over a ladder of heights and widths.
FILTERS = [(i % 6, (5 * i) % (12 - (3 + i % 4) + 1), 3 + i % 4, 4 + (5 * i) % (WIDTH - 3)) for i in range(16)]
STEPS = (-0.04, 0.0, 0.04)
GRAY = np.array([0, 1, 3, 2], np.uint32)
QUERY_BLOCK, BLOCK, MOST_MET = 10_000, 20_000, 1_000_000


def _mono(raw: bytes, channels: int, width: int) -> np.ndarray:
    """The mean of all channels, on the scale of 16-bit samples. 8-bit samples are unsigned, as WAV has them."""
    whole = len(raw) // (channels * width) * channels * width
    data = np.frombuffer(raw[:whole], np.uint8).reshape(-1, width)
    if width == 1:
        samples = (data[:, 0].astype(np.float32) - 128) * 256
    else:  # the two highest bytes are all that the scale needs, but lower ones are kept as fractions
        high = np.ascontiguousarray(data[:, -2:]).view("<i2")[:, 0].astype(np.float32)
        samples = high + sum(data[:, -3 - k].astype(np.float32) / 256 ** (k + 1) for k in range(width - 2))
    return samples.reshape(-1, channels).mean(1, dtype=np.float32)


def _resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples at RATE: a low pass below half of the lower rate (a Hamming-windowed sinc), then straight lines between."""
    if rate == RATE or not len(samples):
        return samples
    cut = 0.5 * min(1.0, RATE / rate)
    reach = int(16 / cut)
    t = np.arange(-reach, reach + 1)
    taps = 2 * 0.9 * cut * np.sinc(2 * 0.9 * cut * t) * np.hamming(len(t))
    if rate > RATE:
        samples = np.convolve(samples, (taps / taps.sum()).astype(np.float32), "same")[: len(samples)] if len(samples) > len(taps) else samples
    at = np.arange(int(len(samples) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


def decode_wav(column: pa.Array) -> list[np.ndarray]:
    """Samples at RATE of WAV bytes, of any rate, of one channel or more, and of 1 to 4 bytes each (whole numbers); none for a null or anything else."""
    out = []
    for blob in column.to_pylist():
        samples = np.zeros(0, np.float32)
        if blob:
            try:
                with wave.open(io.BytesIO(blob)) as sound:
                    if 1 <= sound.getsampwidth() <= 4 and sound.getframerate() > 0:
                        samples = _resampled(_mono(sound.readframes(sound.getnframes()), sound.getnchannels(), sound.getsampwidth()), sound.getframerate())
            except (wave.Error, EOFError):
                pass
        out.append(samples)
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by 12 pitch classes, smoothed over five frames and scaled to length 1 (a silent frame is zero)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    used = (hertz >= LOW_HZ) & (hertz <= HIGH_HZ)
    pitch = np.eye(12)[np.round(12 * np.log2(hertz[used] / 440.0)).astype(np.int64) % 12]
    frames, bell = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP], np.hamming(FRAME).astype(np.float32)
    classes = np.zeros((len(frames), 12))
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        energy = np.abs(np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * bell, axis=1)) ** 2
        classes[at : at + FRAMES_AT_ONCE] = energy[:, used] @ pitch
    if len(classes) < len(SMOOTH):
        return np.zeros((0, 12))
    smooth = sum(w * classes[i : len(classes) - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    size = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(size > 0.01, smooth / np.maximum(size, 0.01), 0.0)


def _sums(image: np.ndarray, t: np.ndarray, width: int, y: int, height: int) -> np.ndarray:
    return image[t + width, y + height] - image[t, y + height] - image[t + width, y] + image[t, y]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers, one for each WIDTH frames; none of a recording that is too short."""
    frames = chroma(samples)
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    t, out = np.arange(n), np.zeros(n, np.uint32)
    for kind, y, height, width in FILTERS:
        whole = _sums(image, t, width, y, height)
        if kind == 0:  # a band of pitches against its share of all of them
            part = whole
            rest = _sums(image, t, width, 0, 12) * height / 12
        elif kind == 1:  # lower against upper half of the pitches
            part = _sums(image, t, width, y, height // 2)
            rest = _sums(image, t, width, y + height - height // 2, height // 2)
        elif kind == 2:  # first against second half of the time
            part = _sums(image, t, width // 2, y, height)
            rest = _sums(image, t + width - width // 2, width // 2, y, height)
        elif kind == 3:  # opposite quarters
            part = _sums(image, t, width // 2, y, height // 2) + _sums(image, t + width // 2, width - width // 2, y + height // 2, height - height // 2)
            rest = whole - part
        elif kind == 4:  # the middle third of the pitches against the others
            part = _sums(image, t, width, y + height // 3, height - 2 * (height // 3))
            rest = whole - part
        else:  # the middle third of the time
            part = _sums(image, t + width // 3, width - 2 * (width // 3), y, height)
            rest = whole - part
        value = np.log((1 + np.maximum(part, 0) / (height * width)) / (1 + np.maximum(rest, 0) / (height * width)))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(STEPS, value, "right")]
    return out


def fingerprints(recordings: DataFrame, id_col: str, audio_col: str, decode: Callable[[pa.Array], list[np.ndarray]] = decode_wav) -> DataFrame:
    """rec_id and fingerprint (array of int, the 32 bits as a signed number) of every recording.

    A null, unreadable or short recording has an empty fingerprint. A long one is worked off in runs of frames, so that
    besides its samples only its frames' 12 pitch classes are held. Rows that repeat come back each; of an empty table
    nothing does. Other columns are ignored, whatever their names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                prints = [fingerprint(s).view(np.int32) for s in decode(part.column("audio"))]
                yield pa.RecordBatch.from_pydict({"rec_id": part.column("rec_id"), "fingerprint": pa.array(prints, pa.list_(pa.int32()))})

    return recordings.select(F.col(f"`{id_col}`").cast("long").alias("rec_id"), F.col(f"`{audio_col}`").alias("audio")).mapInArrow(rows, "rec_id long, fingerprint array<int>")


def _popcount(prints: np.ndarray, others: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Differing bits of each pair of runs that start at a and b."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    bits = np.bitwise_count(prints[ranges(a, lengths)] ^ others[ranges(b, lengths)]).astype(np.int64)
    return np.add.reduceat(bits, np.cumsum(lengths) - lengths)


def _prints(table: pa.Table, ids: str, codes: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, all codes one after another, and where each id's start."""
    table = table.sort_by(ids)
    column = table.column(codes).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return table.column(ids).to_numpy(), column.flatten().to_numpy().view(np.uint32), offsets - offsets[0]


def _meet(most_error: float, least_votes: int, least_overlap: int):
    """Of a block of queries and one of recordings: a row for each recording that queries align with."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.array([], pa.int64())
        out = {"class_id": [none], "query_id": [none], "offset": [none], "errors": [none], "overlap": [none]}
        if left.num_rows and right.num_rows:
            q_ids, q_codes, q_at = _prints(left, "class_id", "fingerprint")
            r_ids, r_codes, r_at = _prints(right, "other", "other_print")
            flips = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint32)
            probes = (q_codes[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(probes, kind="stable")
            probes, of = probes[order], order // len(flips)
            of_query = np.repeat(np.arange(len(q_ids)), np.diff(q_at))
            low, high = np.searchsorted(probes, r_codes), np.searchsorted(probes, r_codes, "right")
            met = np.concatenate([[0], np.cumsum(high - low)])[r_at]
            begin = 0
            while begin < len(r_ids):  # recordings, as many at once as have MOST_MET meetings
                stop = max(begin + 1, int(np.searchsorted(met, met[begin] + MOST_MET, "right")) - 1)
                codes = np.arange(r_at[begin], r_at[stop])
                count = high[codes] - low[codes]
                query_code = of[ranges(low[codes], count)]
                r = np.repeat(np.searchsorted(r_at, codes, "right") - 1, count)
                q = of_query[query_code]
                shift = (np.repeat(codes, count) - r_at[r]) - (query_code - q_at[q])
                keep = q_ids[q] != r_ids[r]
                r, q, shift = r[keep], q[keep], shift[keep]
                order = np.lexsort([shift, np.abs(shift), q, r])
                r, q, shift = r[order], q[order], shift[order]
                new = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(q) != 0) | (np.diff(shift) != 0)]) if len(r) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                votes = np.diff(np.append(at, len(r)))
                r, q, shift = r[at], q[at], shift[at]
                order = np.lexsort([shift, np.abs(shift), -votes, q, r])
                r, q, shift, votes = r[order], q[order], shift[order], votes[order]
                best = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(q) != 0)]) if len(r) else np.zeros(0, bool)
                best &= votes >= least_votes
                r, q, shift = r[best], q[best], shift[best]
                first = np.maximum(0, -shift)
                overlap = np.minimum(np.diff(q_at)[q] - first, np.diff(r_at)[r] - first - shift)
                wide = overlap >= least_overlap
                r, q, shift, first, overlap = r[wide], q[wide], shift[wide], first[wide], overlap[wide]
                errors = _popcount(q_codes, r_codes, q_at[q] + first, r_at[r] + first + shift, overlap)
                near = errors <= most_error * 32 * overlap
                for name, values in (("class_id", r_ids[r]), ("query_id", q_ids[q]), ("offset", shift), ("errors", errors), ("overlap", overlap)):
                    out[name].append(pa.array(values[near].astype(np.int64)))
                begin = stop
        flat = {k: pa.concat_arrays(v).to_numpy() for k, v in out.items()}
        cut = np.flatnonzero(np.concatenate([[True], np.diff(flat["class_id"]) != 0])) if len(flat["class_id"]) else np.zeros(0, np.int64)
        ends = pa.array(np.append(cut, len(flat["class_id"])).astype(np.int32))
        lists = {k: pa.ListArray.from_arrays(ends, pa.array(flat[k])) if len(cut) else pa.array([], pa.list_(pa.int64())) for k in ("query_id", "offset", "errors", "overlap")}
        return pa.table({"class_id": flat["class_id"][cut], **lists})

    return rows


def aligned(prints: DataFrame, queries, most_error: float = 0.15, least_votes: int = 2, least_overlap: int = 12) -> DataFrame:
    """A row per recording: rec_id, class_id, n_codes, n_matches, matches (ids), offsets, error_rates.

    prints: rec_id, fingerprint; queries: a condition on rec_id. Recordings of equal fingerprints are one class, named by
    its least id. matches are the classes, other than its own, that hold a query and align with the recording, in order
    of error rate and id; offsets are the recording's frames against theirs, error_rates the shares of bits that differ.

    Integers of a query vote for the offset at which the recording has the same integer but for one bit at most; the
    offset with most votes counts, of equals the least in size, then the negative one. A match has least_votes of them,
    least_overlap frames in common and an error rate of at most most_error.

    A recording without an id, or with an empty fingerprint, matches nothing and is its own class. Rows that repeat come
    back each; of an empty table nothing does. Blocks of queries meet blocks of recordings; what one returns is a row a recording, however many align.
    """
    known = prints.where(F.col("rec_id").isNotNull() & (F.size("fingerprint") > 0))
    classes = written(known.groupBy("fingerprint").agg(F.min("rec_id").alias("class_id"), F.max(queries).alias("asked")), "recordings")
    asked = classes.where("asked").select("class_id", "fingerprint")
    query_blocks, blocks = parts(asked.count(), QUERY_BLOCK), parts(classes.count(), BLOCK, 8)
    left = asked.select("*", F.pmod(F.xxhash64("class_id"), F.lit(query_blocks)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    right = classes.select(F.col("class_id").alias("other"), F.col("fingerprint").alias("other_print"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("other_i"), F.pmod(F.xxhash64(F.lit(1), "class_id"), F.lit(blocks)).cast("int").alias("other_j"))
    met = left.groupBy("i", "j").cogroup(right.groupBy("other_i", "other_j")).applyInArrow(_meet(most_error, least_votes, least_overlap), "class_id long, query_id array<long>, offset array<long>, errors array<long>, overlap array<long>")
    met = met.select("class_id", F.arrays_zip("query_id", "offset", "errors", "overlap").alias("m")).groupBy("class_id").agg(F.flatten(F.collect_list("m")).alias("m"))
    rate = F.transform("m", lambda x: F.struct((x["errors"] / (32.0 * x["overlap"])).alias("rate"), x["query_id"].alias("id"), x["offset"].cast("int").alias("offset")))
    found = met.select(F.col("class_id").alias("of"), F.array_sort(rate).alias("m"))
    named = classes.select(F.col("class_id"), F.col("fingerprint").alias("print"))
    tied = prints.join(named, (F.col("fingerprint") == F.col("print")) & F.col("rec_id").isNotNull(), "left").join(found, F.col("class_id") == F.col("of"), "left")
    m = F.coalesce("m", F.array().cast("array<struct<rate:double,id:bigint,offset:int>>"))
    return tied.select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), F.size("fingerprint").alias("n_codes"), F.size(m).alias("n_matches"), m["id"].alias("matches"), m["offset"].alias("offsets"), m["rate"].alias("error_rates"))


SEGMENTS, SEGMENT = 14, 4725
_TONES = (np.sin(2 * np.pi * 440.0 * 2 ** (np.arange(12)[:, None] / 12) * np.arange(SEGMENT)[None, :] / RATE)).astype(np.float32)


def sung(column: pa.Array) -> list[np.ndarray]:
    """A recording of each vector: SEGMENTS chords of 0.43 s, whose 12 tones are as loud as the squares of 12 components from a moving place."""
    out = []
    for vector in column.to_pylist():
        x = np.array([v if v is not None else np.nan for v in vector or []], np.float32)
        if not len(x) or not np.isfinite(x).all() or not x.any():
            out.append(np.zeros(0))
            continue
        loud = (x / np.abs(x).max()) ** 2
        chords = loud[(5 * np.arange(SEGMENTS)[:, None] + np.arange(12)[None, :]) % len(x)]
        out.append((chords @ _TONES).ravel() * 2000)
    return out
