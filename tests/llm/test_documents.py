"""Each operator on documents against brute force, on a table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regimelab.llm import exchange, langid, mixing, ngram_join, packing, registry, sharding, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot int, score string, copy int, n_links long, n_removed int, kept_text string, sequence_id string, batch_no int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, texts = prose(60), []
    for i in range(60):
        texts.append(prose(rng.randint(1, 120)))
        if i % 6 == 0:
            texts[-1] += "\n" + passage + " " + prose(9)
    base = prose(200).split()
    for i in range(12):  # near copies, three of them equal
        w = list(base)
        w[(i // 3) * 40 + 3] = f"changed{i // 3}"
        texts.append(" ".join(w))
    texts += ["", " \n\t ", "one", "one", "two words here now", "!!! 123 ?", "x" * 3000, "ab" * 400, "É é ß ñ 日本 ab.", prose(12) + "\x0b" + prose(3), prose(9000)]
    out = [(i * 3 + 1, t, ["en", "fr", None][i % 3], [f"s{i % 4}", "big", "big", None][i % 4], len(t)) for i, t in enumerate(texts)]
    out += [out[7], out[7], (out[9][0], "another text of a repeated id", "en", "s1", 5), (5000, None, "en", "s1", None), (None, texts[3], None, None, 1), (None, None, None, None, None), (-4, texts[63], "fr", "big", 2)]
    return [(*r, 1, 2, "s", 3, 4, 5, "k", "q", 6) for r in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())


def test_every_operator_takes_an_empty_table(spark, empty):
    path = registry.tokenizer_path()
    model = langid.fit(empty)
    made = [sharding.shard(empty), packing.packed(empty, path), mixing.mixed(empty, extras=True), ngram_join.joined(empty), substring_dedup.deduplicated(empty), suffix_dedup.deduplicated(empty), langid.identified(empty, model)]
    assert [df.count() for df in made] == [0] * len(made)


def test_shards_follow_the_key_alone(docs):
    got = sharding.shard(docs, 40).toPandas()
    assert len(got) == len(ROWS)
    assert sorted(got["size"]) == sorted(16 + len((r[1] or "").encode()) for r in ROWS)
    assert collections.Counter(got.text_crc32) == collections.Counter(zlib.crc32((r[1] or "").encode()) for r in ROWS)
    for _, group in got.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert ((got.grown_shard == got["shard"]) | (got.grown_shard == 40)).all()
    assert (got.groupby(got.doc_id.fillna(-1)).shard.nunique() == 1).all()


def test_jump_hash_moves_only_into_the_new_bucket():
    keys = np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64)
    old, new = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert set(new[new != old]) == {40} and abs((new != old).mean() - 1 / 41) < 0.005
    assert np.bincount(old, minlength=40).min() > 400

    def plain(key, buckets):
        b, j = -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    assert [plain(int(k), 40) for k in keys[:500]] == old[:500].tolist()


def test_hot_keys_get_slots_too(spark):
    df = spark.range(20000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard(df).select("slot").toPandas()
    assert sorted(got.slot) == list(range(20000))


def test_poisson_quantiles_against_their_definition():
    u = np.random.default_rng(1).random(400)
    for rate in (0.0, 0.2, 1.0, 7.5, 90.0):
        got = mixing.poisson_quantile(u, np.full(400, rate))
        for x, k in zip(u, got):
            below = sum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) if rate else float(j == 0) for j in range(int(k) + 1))
            under = below - (math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else float(k == 0))
            assert below > x - 1e-12 and under <= x + 1e-12
    for rate in (499.5, 501.0, 1200.0, 3e6):
        big = mixing.poisson_quantile(np.random.default_rng(2).random(40000), np.full(40000, rate))
        assert abs(big.mean() / rate - 1) < 0.01 and abs(big.var() / rate - 1) < 0.05
    mixed = mixing.poisson_quantile(np.array([0.5, 0.5, 0.5, 1 - 2**-52]), np.array([0.0, 3.0, 700.0, 2.0]))
    assert mixed[:3].tolist() == [0, 3, 700] and 10 < mixed[3] < 40


def test_mixing_repeats_rows_by_count(docs):
    got = mixing.mixed(docs, weights={"big": 3.0, "s0": 1.0}, epochs=2.0, extras=True)
    made = ["_copy" if c == "copy" else c for c in ("n_copies", "copy", "shuffle_key")]
    assert got.columns == SCHEMA_NAMES + made
    pdf = got.toPandas()
    assert set(pdf[pdf.text.fillna("") != ""].source) <= {"big", "s0"}
    for _, group in pdf.groupby([pdf.doc_id.fillna(-1), pdf.text.fillna("")]):
        n = int(group.n_copies.iloc[0])
        assert len(group) % n == 0 and set(group["_copy"]) == set(range(n))
    assert mixing.mixed(docs).columns == SCHEMA_NAMES


def test_mixing_spreads_the_copies_of_one_id(spark):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mixing.mixed(rows, weights={"s": 1.0}, epochs=3.0).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) % 4000 == 0 and max(sizes) < 0.6 * sum(sizes)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_mixing_counts_copies_in_one_python_worker_a_task(docs, monkeypatch):
    for most in (mixing.MOST_BROADCAST, 1):
        monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
        plan = mixing.mixed(docs, extras=True)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_mixing_salted_join_gives_the_same(docs, monkeypatch):
    a = mixing.mixed(docs, extras=True).groupBy("doc_id", "source").count().toPandas()
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 1)
    b = mixing.mixed(docs, extras=True).groupBy("doc_id", "source").count().toPandas()
    key = lambda df: sorted(map(repr, df.itertuples(index=False)))
    assert key(a) == key(b)


def test_packing_is_an_exact_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    plain = Tokenizer.from_file(path)
    got = packing.packed(docs, path, seq_len=256, group_bytes=3000, with_ids=True).toPandas()
    want = collections.Counter()  # every piece of every row, cut anew
    for doc, text, *_ in ROWS:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 256):
            want[doc, start, len(ids), np.array(ids[start : start + 256], "<u4").tobytes()] += 1
    have = collections.Counter()
    for r in got.itertuples():
        assert r.length == len(bytes(r.ids)) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        have[None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.doc_tokens, bytes(r.ids)] += 1
    assert have == want
    for _, group in got.groupby("sequence_id"):
        g = group.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256


def test_words_with_added_tokens_and_odd_letters():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    plain, encoder, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "One", "two,", "it's!", "ÉTÉ", "e\u0301", "ẞ", "İx", "Σας", "日本", "a.b.", "x!!", "42", "<", "|>", "...", "\u00a0", "\u2028"]
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b.", "x.<|EndOfText|>!", *("".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(4000))]
    ids, starts = encoder.encode(pa.array(texts))
    for text, a, b in zip(texts, starts[:-1], starts[1:]):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert len(encoder.encode(pa.array(texts[:1]))[0]) == 3


def test_packing_deals_one_id_and_long_texts_over_groups(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same words here").alias("text")).unionAll(spark.createDataFrame([(8, "one two three " * 4000), (9, None)], "doc_id long, text string"))
    got = packing.packed(rows, registry.tokenizer_path(), seq_len=64, group_bytes=8000).withColumn("g", F.shiftright("sequence_id", 32)).toPandas()
    assert len(got[got.doc_id == 7]) == 3000 and got[got.doc_id == 8].length.sum() == 12001
    assert got[got.doc_id == 7].groupby("g").size().max() < 900 and got[got.doc_id == 8].g.nunique() > 8


def test_first_fit_decreasing_against_a_plain_loop():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 300)
    room, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= sizes[i]
        want[int(i)] = b
    assert packing.first_fit_decreasing(sizes, 100).tolist() == [want[i] for i in range(300)]
    assert packing.first_fit_decreasing(np.zeros(0, np.int64), 10).tolist() == []


@pytest.mark.parametrize("small", [False, True])
def test_join_against_all_pairs(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(ngram_join, "LEAF", 3)
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    got = ngram_join.joined(docs).toPandas()
    items = [(r[0], r[1]) for r in ROWS]

    def grams(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [grams(t) if i is not None else set() for i, t in items]
    near = [[j for j in range(len(items)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(items))]
    want = []
    for i, (doc, _) in enumerate(items):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = None if doc is None else min(items[j][0] for j in seen)
        same = None if doc is None else min(items[j][0] for j in {i, *(j for j in near[i] if sets[j] == sets[i])})
        want.append((doc, same, len(near[i]), least, doc == least))
    clean = lambda v: None if v is None or v != v else int(v)
    have = [(clean(r.doc_id), clean(r.class_id), int(r.n_links), clean(r.component_id), bool(r.kept)) for r in got.itertuples()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_substrings_against_a_plain_scan(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(exchange, "BATCH_BYTES", 4000)
        monkeypatch.setattr(exchange, "BUCKET_BYTES", 4000)
    out = substring_dedup.deduplicated(docs)
    made = ["n_words", "_n_removed", "_kept_text"]
    assert out.columns == SCHEMA_NAMES + made
    least = {}
    for doc, text, *_ in ROWS:
        w = words(text)
        for p in range(len(w) - 12):
            if doc is not None:
                key = tuple(w[p : p + 13])
                least[key] = min(doc, least.get(key, doc))
    want = []
    for doc, text, *_ in ROWS:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if doc is not None and least[tuple(w[p : p + 13])] < doc:
                gone[p : p + 13] = [True] * 13
        want.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    have = [(r.doc_id, r.n_words, r["_n_removed"], r["_kept_text"]) for r in out.select("doc_id", *made).collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 100


@pytest.mark.parametrize("many", [50_000, 2])
def test_suffixes_against_a_plain_scan(docs, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 3000)
    monkeypatch.setattr(exchange, "BATCH_BYTES", 4000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 4000)
    out = suffix_dedup.deduplicated(docs)
    first = {}
    for doc, text, *_ in ROWS:
        b = (text or "").encode()
        for p in range(len(b) - 99):
            if doc is not None:
                key = b[p : p + 100]
                first[key] = min((doc, p), first.get(key, (doc, p)))
    want = []
    for doc, text, *_ in ROWS:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if doc is not None and first[b[p : p + 100]] < (doc, p):
                gone[p : p + 100] = b"\1" * 100
        want.append((doc, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    have = [(r.doc_id, r.n_bytes, r["_n_removed"], r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_suffixes_do_not_depend_on_the_order_of_rows_at_a_look(spark, monkeypatch):
    looks = {}
    monkeypatch.setattr(suffix_dedup, "looked_at", lambda docs, id_col, text_col, first, second, meet_second, last, *_: looks.update(first=first, second=second, meet=meet_second, last=last))
    suffix_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string"))
    usable = [(r[0], r[1] or "") for r in ROWS if r[0] is not None and len(r[1] or "") < 4000]
    there = pa.table({"doc_id": [r[0] for r in usable], "text": [r[1] for r in usable]})
    back = there.take(list(range(len(usable)))[::-1])

    def outcome(chunk, one, two, three):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        hits = exchange.meet(1 << 60)(looks["first"](one, 0, 1))
        sent = looks["second"](two, hits, 0, 1)
        return sorted(map(repr, looks["last"](three, pa.concat_tables([hits, looks["meet"](sent)]), 1).to_pylist()))

    want = outcome(1 << 20, there, there, there)  # no chunk ends
    assert outcome(1000, there, there, there) == outcome(1000, there, back, there) == outcome(1000, there, there, back) == want


def test_bytes_decide_where_hashes_clash(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[200:330] = data[20:150]
    sizes, ids, starts = np.array([200, 200]), np.array([1, 2]), np.array([0, 0])
    want = suffix_dedup.repeated(data, sizes, ids, starts, ids, 100)
    monkeypatch.setattr(suffix_dedup, "_block_hashes", lambda x, n: np.arange(max(0, len(x) - n + 1), dtype=np.uint64) % np.uint64(3))
    assert suffix_dedup.repeated(data, sizes, ids, starts, ids, 100).tolist() == want.tolist() and want.any()
    first, size, key = np.array([20, 200, 21, 200]), np.array([100] * 4), np.zeros(4)
    assert suffix_dedup._heads(data, first[:2], size[:2], [key[:2]]).tolist() == [True, False]
    assert suffix_dedup._heads(data, first, size, [key]).tolist() == [True] * 4


def test_merged_transforms_group_equal_strings():
    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 99, n).astype(np.uint8) for n in (150, 240, 180, 130, 300)]
    parts[1][20:140] = parts[0][10:130]
    parts[3] = parts[2][:130].copy()
    ids, starts = np.array([5, 2, 9, 1, 7]), np.array([0, 50, 3, 8, 0])
    got = suffix_dedup.repeated(np.concatenate(parts), np.array([len(p) for p in parts]), ids, starts, np.array([3, 0, 3, 9, 0]), 100)
    at = [(int(i), int(s) + k, bytes(p[k : k + 100])) for p, i, s in zip(parts, ids, starts) for k in range(len(p) - 99)]
    least = {}
    for i, s, text in at:
        least[text] = min((i, s), least.get(text, (i, s)))
    assert got.tolist() == [least[text] < (i, s) for i, s, text in at]
    assert got.any()


def test_language_of_odd_texts(spark, docs):
    labelled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(labelled)
    out = langid.identified(docs, model)
    assert out.columns == SCHEMA_NAMES + ["lang_pred", "_score"]
    got = out.toPandas()
    assert len(got) == len(ROWS)
    for r in got.itertuples():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= got.at[r.Index, "_score"] <= 1
    assert set(langid.identified(docs, langid.fit(labelled.where("false"))).select("lang_pred").distinct().toPandas().lang_pred) == {"und"}


def test_language_held_out_accuracy(spark):
    got = registry.op10_string_kernel_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97


def test_kernel_scores_against_sets():
    import pyarrow as pa

    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(30))
    texts = [(lang, make(letters)) for _ in range(12) for lang, letters in (("a", "abcde"), ("b", "defgh"))]
    points, starts = langid.code_points(pa.array([t for _, t in texts]))
    sets = [langid.gram_set(points[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    model = langid.train([(lang, s) for (lang, _), s in zip(texts, sets)], most_landmarks=8)
    fresh = [make("abcde"), make("defgh"), "Zq x.", "ab"]
    points, starts = langid.code_points(pa.array(fresh))
    present = model.presence(points, starts)
    known = [g for s in sets for g in s.tolist()]
    for row, (a, b) in zip(present, zip(starts[:-1], starts[1:])):
        assert row.sum() == len(set(langid.gram_set(points[a:b]).tolist()) & set(known))
    assert model.predict(pa.array(fresh[:2]))[0] == ["a", "b"]


def test_no_mutual_imports():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "regimelab"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text()), path


def test_languages_of_many_scripts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    scripts = {"ar": (0x627, 28), "el": (0x3B1, 24), "hi": (0x904, 50), "ja": (0x3041, 80), "ko": (0xAC00, 900), "la": (0x61, 26), "ru": (0x430, 32), "th": (0xE01, 44), "zh": (0x4E00, 1500)}
    make = lambda at, n: " ".join("".join(chr(at + int(n * rng.random() ** 2)) for _ in range(rng.randint(2, 7))) for _ in range(40))
    sets, texts = [], [(lang, make(*span)) for _ in range(40) for lang, span in scripts.items()]
    points, starts = langid.code_points(pa.array([t for _, t in texts]))
    for a, b in zip(starts[:-1], starts[1:]):
        sets.append(langid.gram_set(points[a:b]))
    rows = [(lang, s) for (lang, _), s in zip(texts, sets)]
    model, fresh = langid.train(rows), [(lang, make(*span)) for lang, span in scripts.items() for _ in range(5)]
    names, scores = model.predict(pa.array([t for _, t in fresh]))
    assert names == [lang for lang, _ in fresh] and scores.min() >= 0.15
    points, starts = langid.code_points(pa.array([t for _, t in fresh]))
    known, present = set(np.concatenate(sets).tolist()), model.presence(points, starts)
    for row, a, b in zip(present, starts[:-1], starts[1:]):
        assert set(model.grams[row > 0].tolist()) == set(langid.gram_set(points[a:b]).tolist()) & known
    for most in (0, 1 << 30):  # searched and looked up
        monkeypatch.setattr(langid, "MOST_DENSE", most)
        assert (langid.train(rows).presence(points, starts) == present).all()


def test_the_language_sample_is_bounded_and_leaves_no_language_out(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(12))
    rows = [(1, text("abcde"), "hot") for _ in range(1500)] + [(2, "one text for all", "same")] * 900 + [(i, text("fghij"), "cold") for i in range(40)] + [(7, "lone", "rare"), (8, None, "none"), (9, "x", None)]
    taken = []
    monkeypatch.setattr(langid, "train", lambda got, **options: taken.extend(got) or langid.Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert collections.Counter(lang for lang, _ in taken) == {"hot": 50, "same": 1, "cold": 40, "rare": 1}


def test_kernel_ridge_against_the_whole_kernel():
    """With every text a landmark, scores are those of kernel ridge regression on the full matrix of shared grams, one language against the rest."""
    import pyarrow as pa

    rng = random.Random(12)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(14))
    langs = {"a": "abcdef", "b": "defghi", "c": "ghijab"}
    texts = [(lang, make(letters)) for _ in range(7) for lang, letters in langs.items()]
    fresh = [make(letters) for letters in langs.values()] + ["!!", "zzz", "abc"]

    def grams(text):
        s = " " + re.sub(r"[^a-z]+", " ", text.lower()).strip() + " "
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "}

    def sets(these):
        points, starts = langid.code_points(pa.array(these))
        return [langid.gram_set(points[a:b]) for a, b in zip(starts[:-1], starts[1:])]

    model = langid.train([(lang, s) for (lang, _), s in zip(texts, sets([t for _, t in texts]))], most_landmarks=1000, ridge=0.3)
    train_sets, known = [grams(t) for _, t in texts], set().union(*(grams(t) for _, t in texts))
    kernel = lambda x, y: len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y)))
    k = np.array([[kernel(x, y) for y in train_sets] for x in train_sets])
    y = np.array([[1.0 if lang == other else -0.5 for other in langs] for lang, _ in texts])
    alpha = np.linalg.solve(k + 0.3 * np.eye(len(k)), y)  # the normal equations K(K + 0.3)a = Ky without their common K
    want = np.array([[kernel(grams(t) & known, x) for x in train_sets] for t in fresh]) @ alpha
    points, starts = langid.code_points(pa.array(fresh))
    got = model.scores(model.presence(points, starts))
    assert np.abs(got - want).max() < 1e-3
    names, best = model.predict(pa.array(fresh))
    assert [n for n in names if n != "und"] == [sorted(langs)[i] for i, t in zip(want.argmax(1), fresh) if t != "!!"] and names[3] == "und" and best[3] == 0
