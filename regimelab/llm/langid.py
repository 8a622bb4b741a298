"""Language identification by string kernels.

The kernel of two texts is the number of character 1-, 2- and 3-grams that both hold, over the geometric mean of how
many each holds (a blended-spectrum presence kernel, normalised), counted over all grams of the sample that is learned from. A Nyström sample of landmark texts spans the
kernel space; one ridge regression a language against the rest is solved in it. Landmarks and their weights are
multiplied once, so scoring is one matrix product a batch: grams by languages.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_name, slices, small_batches, trim

UNKNOWN = "und"
CHUNK = 1 << 21
MOST_DENSE = 1 << 22  # entries of a lookup table; larger ones are searched
CELLS = 1 << 21  # rows of presence at once, times columns
LANDMARKS_EACH = 16


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts as code points, each run of anything else as one space; every text starts and ends with one. And where each text starts."""
    rows = pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()
    lowered = [b.decode("utf-8", "replace").lower() for b in rows]
    sizes = np.fromiter((len(x) + 2 for x in lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(f" {x} " for x in lowered).encode("utf-32-le", "replace"), "<u4")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32))
    keep = letter | np.concatenate([[True], letter[:-1]])
    first = starts[:-1][sizes > 0]
    keep[first] = True
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def gram_set(points: np.ndarray) -> np.ndarray:
    """The distinct 1- to 3-grams of one text, each as a 63-bit number (21 bits a character, the first character highest)."""
    p = points.astype(np.uint64)
    two = (p[:-1] << np.uint64(21)) | p[1:]
    three = (two[:-1] << np.uint64(21)) | p[2:] if len(p) > 2 else np.zeros(0, np.uint64)
    grams = np.unique(np.concatenate([p, two, three]))
    return grams[grams != 32]


class _Places:
    """Where a key stands among sorted distinct keys, or -1: by a table where their range allows one, else by binary search."""

    def __init__(self, keys: np.ndarray, top: int):
        self.keys, self.table = keys, None
        if top <= MOST_DENSE:
            self.table = np.full(top + 1, -1, np.int32)  # the last place answers for -1
            self.table[keys] = np.arange(len(keys))

    def of(self, wanted: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[wanted]
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # every 1- to 3-gram of the sample, sorted; its place is its column
    weights: np.ndarray  # columns by languages: landmarks, each scaled to length 1, times their ridge weights

    @functools.cached_property
    def _index(self) -> tuple[np.ndarray, int, np.ndarray, _Places, _Places]:
        """Numbers of letters (0 for one that the sample lacks), how many, columns of letters, and the places of pairs and of triples among their like."""
        mask = np.uint64((1 << 21) - 1)
        one, two, three = np.split(self.grams, np.searchsorted(self.grams, np.array([1 << 21, 1 << 42], np.uint64)))
        letters = np.union1d(one.astype(np.int64), [32])
        a = len(letters) + 1
        numbers = np.zeros(0x110000, np.int32)
        numbers[letters] = np.arange(1, a)
        columns = np.full(a, -1, np.int32)
        columns[numbers[one.astype(np.int64)]] = np.arange(len(one))
        last = lambda grams: numbers[(grams & mask).astype(np.int64)]
        pairs = _Places(numbers[(two >> np.uint64(21)).astype(np.int64)].astype(np.int64) * a + last(two), a * a)
        triples = _Places(np.searchsorted(two, three >> np.uint64(21)) * a + last(three), max(1, len(two)) * a)
        return numbers, a, columns, pairs, triples

    def presence(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which column occurs in which text. Whole texts, in chunks that overlap by two characters."""
        rows, width = len(starts) - 1, len(self.grams)
        out = np.zeros(rows * width, np.float32)
        numbers, a, columns, pairs, triples = self._index
        before = (0, int(np.count_nonzero(columns >= 0)))
        before += (before[1] + len(pairs.keys),)
        for at in range(0, len(points), CHUNK):
            x = numbers[points[at : at + CHUNK + 2]].astype(np.int64)
            row = np.searchsorted(starts, np.arange(at, min(at + CHUNK, len(points))), "right") - 1
            two = pairs.of(x[:-1] * a + x[1:]).astype(np.int64)
            three = triples.of(np.where(two[:-1] >= 0, two[:-1] * a + x[2:], -1)) if len(x) > 2 else two[:0]
            for n, found in enumerate((columns[x], two, three)):
                found = found[: len(row)]
                ends = at + np.arange(len(found)) + n < starts[row[: len(found)] + 1]
                good = (found >= 0) & ends
                out[row[: len(found)][good] * width + found[good] + before[n]] = 1
        return out.reshape(rows, width)

    def scores(self, present: np.ndarray) -> np.ndarray:
        """A score of each language for each row of presence; 0 where a text holds no known gram."""
        size = np.sqrt(present.sum(1, keepdims=True))
        return present @ self.weights / np.maximum(size, 1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        points, starts = code_points(texts)
        n = len(starts) - 1
        has_letter = np.add.reduceat(np.append(points != 32, 0), starts[:-1]) > 0 if n else np.zeros(0, bool)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        names, best = [], np.zeros(n)
        step = max(1, min(256, CELLS // max(1, len(self.grams))))
        for at in range(0, n, step):
            lo, hi = starts[at], starts[min(n, at + step)]
            got = self.scores(self.presence(points[lo:hi], starts[at : min(n, at + step) + 1] - lo))
            top = got.argmax(1)
            best[at : at + len(top)] = np.clip(got[np.arange(len(top)), top], 0, 1)
            names += [self.languages[k] for k in top]
        return [name if ok else UNKNOWN for name, ok in zip(names, has_letter)], np.where(has_letter, best, 0.0)


def train(rows: list[tuple[str, np.ndarray]], most_landmarks: int = 192, ridge: float = 1e-2) -> Model:
    """The model of (language, gram set) rows, in the order given: the first texts of each language, in turns, are the landmarks.

    Every letter and gram of the rows counts. There are most_landmarks landmarks, or LANDMARKS_EACH a language where that is more.
    """
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    sizes = np.array([len(g) for _, g in rows])
    grams, flat = np.unique(np.concatenate([g for _, g in rows]), return_inverse=True)
    owner, starts = np.repeat(np.arange(len(rows)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    length = np.sqrt(np.maximum(sizes, 1))
    seen, turn = Counter(), []
    for lang, _ in rows:
        turn.append(seen[lang])
        seen[lang] += 1
    marks = np.sort(np.argsort(np.array(turn), kind="stable")[: max(most_landmarks, LANDMARKS_EACH * len(languages))])
    kernel = np.zeros((len(rows), len(marks)))
    for j, mark in enumerate(marks):
        held = np.zeros(len(grams), bool)
        held[flat[starts[mark] : starts[mark + 1]]] = True
        kernel[:, j] = np.bincount(owner[held[flat]], minlength=len(rows)) / length / length[mark]
    target = np.array([[1.0 if lang == x else -1.0 / max(1, len(languages) - 1) for x in languages] for lang, _ in rows])
    weight = np.array([len(rows) / len(languages) / seen[lang] for lang, _ in rows])[:, None]
    normal = kernel.T @ (weight * kernel) + ridge * kernel[marks] + 1e-6 * np.eye(len(marks))
    solved = np.linalg.solve(normal, kernel.T @ (weight * target))
    weights = np.zeros((len(grams), len(languages)))
    for j, mark in enumerate(marks):
        weights[flat[starts[mark] : starts[mark + 1]]] += solved[j] / length[mark]
    return Model(languages, grams, weights.astype(np.float32))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            points, starts = code_points(part.column("text"))
            grams = [gram_set(points[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_pydict({"place": part.column("place"), "lang": part.column("lang"), "grams": pa.array(grams, pa.binary())})


def fit(labelled: DataFrame, per_language: int = 300, seed: int = 11, text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model of rows with a text and a non-null language.

    It learns from a sample: of each language the per_language distinct texts whose hashes come first (all of a language
    that has fewer), drawn from all rows. No more than that are learned from, however often a text or an id repeats, and
    no language is left out. Texts are whole; only sets of their grams reach the driver. Without a row there is a model
    of no language. Other columns are never looked at.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Places from 0 to 2 ** 62 - 1. Equal texts of a language have one.
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "lang", "text"), 2))
    held = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.05).alias("n")).collect()}
    if not held:
        return train([], **options)
    # Twice as many distinct texts as wanted, by an estimate of how many there are, are looked at for the first ones.
    last = F.create_map(*[F.lit(x) for lang, n in held.items() for x in (lang, int(min(1.0, (2 * per_language + 100) / max(1, n)) * (1 << 62)))])
    near = rows.where(F.col("place") < F.try_element_at(last, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("place")
    first = near.select("lang", "place").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    texts = near.join(F.broadcast(first.select("lang", "place")), ["lang", "place"])  # per_language rows a language
    got = texts.groupBy("lang", "place").agg(F.min("text").alias("text")).mapInArrow(_gram_rows, "place long, lang string, grams binary").collect()
    return train([(r.lang, np.frombuffer(bytes(r.grams), np.uint64)) for r in sorted(got, key=lambda r: (r.place, r.lang))], **options)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with lang_pred (a learned language, or `und` for a text that is null or holds no letter) and score, 0 to 1.

    Columns of those names that docs brings already get underscores in front of the new ones. A null or empty text, or
    one without a letter, is `und` with score 0; without any learned language all are. Ties go to the language that
    sorts first. Rows that repeat are scored each; of an empty table nothing comes back. Only texts are looked at.
    """
    lang, score = column_name(docs, "lang_pred"), column_name(docs, "score")
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of the size of the sample's distinct grams

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            for part in slices(batch, text_col, 4 << 20):
                names, scores = held.value.predict(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang, score])
        trim()

    schema = type(docs.schema)([*docs.schema.fields]).add(lang, "string").add(score, "double")
    return docs.mapInArrow(score_batches, schema)
