"""URL filter, vectors, sound and the pipeline against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regimelab.llm import audio, components, registry, url_filter, vector_dedup


def test_url_filter_against_a_plain_scan(spark, monkeypatch):
    rng = random.Random(1)
    urls = ["https://a.b.example.com/x/y/z.html", "http://B.example.com/x/", "ftp://user@c.org:21/x?q=/y/", "not a url", "", None, "https://example.com", "https://d.example.com/x", "https://b.example.com/x/" + "y/" * 30000, "https://localhost/a/b", "http://" + "w." * 20000 + "c.org/"]
    entries = []
    for pattern in ("example.com", "b.example.com", "b.example.com/x/", "c.org/x", "c.org", "a.b.example.com/x/y/", "d.example.com", "localhost", "d.example.com/"):
        for _ in range(rng.randint(0, 4)):
            entries.append((pattern, rng.choice(["add", "add", "remove"]), rng.randint(0, 20)))
    entries += [("b.example.com", "add", 5), ("b.example.com", "remove", 5), (None, "add", 1), ("c.org", "add", None), ("c.org", "other", 1)]
    captures = [(i, rng.choice(urls), rng.choice([None, *range(22)]), "old") for i in range(300)] + [(1, urls[0], 4, "old")] * 3

    def listed(pattern, t):
        state = {}
        for p, action, at in entries:
            if p == pattern and at is not None and action in ("add", "remove"):
                state[at] = min(state.get(at, 1), int(action == "add"))
        past = [at for at in state if at <= t]
        return bool(past) and state[max(past)] == 1

    def keys(url):
        host, _, path = url.split("://", 1)[1].partition("/")
        host = host.split("@")[-1].split(":")[0].split("?")[0].lower()
        labels = host.split(".")
        out = {".".join(labels[i:]) for i in range(max(0, len(labels) - 30), max(1, len(labels) - 1))}
        folders = ("/" + path).split("?")[0].lower().split("/")[1:-1] if "/" in url.split("://", 1)[1] else []
        out = {k for k in out if len(k) < 99}  # no pattern here is longer
        return out | {host + "/" + "".join(f + "/" for f in folders[:i]) for i in range(min(9, len(folders) + 1)) if "/" in url.split("://", 1)[1]}

    want = sorted((i, sum(listed(p, t) for p in keys(u)) if u and "://" in u and t is not None else 0) for i, u, t, _ in captures)
    df = spark.createDataFrame(captures, "page_id int, url string, fetched_at int, host string")
    feed = spark.createDataFrame(entries, "pattern string, action string, effective_at int")
    for most in (url_filter.MOST_BROADCAST, 1):
        monkeypatch.setattr(url_filter, "MOST_BROADCAST", most)
        got = url_filter.judged(df, feed).collect()
        assert got[0].__fields__ == ["page_id", "url", "fetched_at", "host", "_host", "blocked", "n_active", "first_pattern", "listed_since"] and {r.host for r in got} == {"old"}
        assert sorted((r.page_id, r.n_active) for r in got) == want
        assert all(r.blocked == (r.n_active > 0) for r in got)
    assert url_filter.judged(df.limit(0), feed).count() == 0
    assert url_filter.judged(df, feed.limit(0)).where("blocked").count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    vectors = [list(map(float, np.float32(c + rng.normal(size=16) * s))) for c in centres for s in (0.05, 0.1, 0.3, 0.6) for _ in range(8)]
    rows = [(int(i), v, 1) for i, v in enumerate(vectors)]
    rows += [(500, vectors[0], 1), (500, vectors[0], 1), (501, [2 * x for x in vectors[1]], 1), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] + [1.0] * 15, 1), (505, [None] + [1.0] * 15, 1), (506, [], 1), (507, vectors[2][:8], 1), (None, vectors[3], 1), (-1, [-x for x in vectors[0]], 1)]
    got = vector_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).toPandas()

    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    near = []
    for i, v, _ in rows:
        row = []
        for k, (j, w, _) in enumerate(rows):
            if i is not None and j is not None and good(v) and good(w) and len(v) == len(w):
                a, b = np.float32(v).astype(float), np.float32(w).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    row.append(k)
        near.append(row)
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        least = None if i is None else min(rows[x][0] for x in seen)
        want.append((i, len([x for x in near[k] if x != k]), least, i == least))
    clean = lambda v: None if v is None or v != v else int(v)
    have = [(clean(r.vec_id), int(r.n_links), clean(r.component_id), bool(r.kept)) for r in got.itertuples()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert vector_dedup.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(1)
    vectors = vector_dedup._unit(rng.normal(size=(3000, 24)))
    graph, order = vector_dedup.build(vectors, rng.random(3000))
    queries = vectors[:200].astype(np.float32)
    ids, near = graph.search(queries, 32)
    assert (order[ids[:, 0]] == np.arange(200)).mean() >= 0.99
    truth = np.sort(queries @ graph.vectors.T, 1)[:, -10:]
    assert (near[:, :10] >= truth[:, :1] - 1e-6).mean() > 0.9


def test_a_block_that_fails_its_audit_is_compared_with_all():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 12))
    vectors = vector_dedup._unit(np.concatenate([c + rng.normal(size=(n, 12)) * 0.05 for c, n in zip(centres, [900] + [6] * 39)]))
    graph, order = vector_dedup.build(vectors, rng.random(len(vectors)))
    queries = vectors.astype(np.float32)
    want = {(q, v) for q, v in zip(*np.nonzero(queries @ graph.vectors.T >= 0.9))}
    audit = np.arange(0, len(queries), 4)
    found = set(zip(*vector_dedup.within(graph, queries, 0.9, audit)))
    assert found <= want and len(found) > 0.999 * len(want)
    cut = vector_dedup.Graph(graph.vectors, [np.full_like(graph.layers[0], -1)])  # no edges: nothing but the entry is found
    assert set(zip(*vector_dedup.within(cut, queries, 0.9, audit))) == want


def test_nodes_that_clash_become_two(spark):
    from regimelab.llm.common import unclashed

    rows = [(1, 10, 100), (2, 10, 100), (3, 10, 101), (4, 11, 100), (5, None, None)]
    got = {r.id: r.node for r in unclashed(spark.createDataFrame(rows, "id int, node long, check long")).collect()}
    assert got[1] == got[2] != got[3] and got[4] == 11 and got[5] is None and len({got[1], got[3], got[4], 10}) == 4
    plain = [r for r in rows if r[0] != 3]
    assert sorted(r.node or 0 for r in unclashed(spark.createDataFrame(plain, "id int, node long, check long")).collect()) == [0, 10, 10, 11]


def test_components_of_long_and_wide_graphs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(400, 401), (401, 400), (500, 500), (450, 399)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(200))
    assert (got[400], got[401], got[500], got[450], got[399]) == (400, 400, 500, 399, 399)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def melody(seed, seconds=9.0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(int(seconds / 0.3)):
        t = np.arange(int(0.3 * audio.RATE)) / audio.RATE
        out.append(sum(np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in rng.integers(0, 24, 3)))
    return np.concatenate(out) * 3000


def wav(samples, rate=audio.RATE, channels=1, width=2):
    import io
    import wave

    held = io.BytesIO()
    with wave.open(held, "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        whole = np.repeat(np.clip(samples, -32000, 32000).astype(np.int64), channels)
        data = (whole * 256 ** (width - 2)).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width] if width > 1 else (whole // 256 + 128).astype(np.uint8)
        out.writeframes(data.tobytes())
    return held.getvalue()


def test_sounds_of_any_rate_channels_and_width():
    t = np.arange(4 * 44100) / 44100
    tune = sum(np.where((t * 2).astype(int) % 4 == k, np.sin(2 * np.pi * f * t), 0) for k, f in enumerate((262, 330, 392, 523))) * 9000
    plain = audio.fingerprint(audio.decode_wav(pa.array([wav(tune[::4])]))[0])
    for rate, channels, width, samples in ((44100, 1, 2, tune), (44100, 2, 3, tune), (22050, 1, 4, tune[::2]), (11025, 2, 1, tune[::4]), (48000, 1, 2, np.interp(np.arange(4 * 48000) / 48000, t, tune))):
        got = audio.fingerprint(audio.decode_wav(pa.array([wav(samples, rate, channels, width)]))[0])
        n = min(len(got), len(plain))
        assert abs(len(got) - len(plain)) <= 1 and np.bitwise_count(got[:n] ^ plain[:n]).sum() < 0.08 * 32 * n, (rate, channels, width)
    assert np.allclose(audio.chroma(tune[::4].astype(np.float32)), audio.chroma(np.concatenate([tune[::4]] * 40).astype(np.float32))[: len(audio.chroma(tune[::4].astype(np.float32)))], atol=1e-5)


def test_alignments_against_all_pairs_and_offsets(spark):
    """The registered search on vectors that are sung, held against every offset of every pair."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 64))
    vectors = [b + rng.normal(size=64) * s for b in base for s in (0, 0.02, 0.1, 0.3, 0.6)] + [np.roll(base[0], 5 * k) for k in (1, -2)] + [base[1], base[1]]
    rows = [(10 * i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(7, None), (None, vectors[0].tolist()), (50, vectors[3].tolist())]
    prints = audio.fingerprints(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", audio.sung)
    got = audio.aligned(prints, F.col("rec_id") % 50 == 0).collect()
    codes = [tuple(np.array(r.fingerprint, np.int32).view(np.uint32).tolist()) for r in prints.orderBy(F.col("rec_id").asc_nulls_first(), "fingerprint").collect()]
    ids = [r.rec_id for r in prints.orderBy(F.col("rec_id").asc_nulls_first(), "fingerprint").collect()]
    least, asked = {}, set()
    for i, c in zip(ids, codes):
        if i is not None and c:
            least[c] = min(i, least.get(c, i))
            asked |= {c} if i % 50 == 0 else set()

    def best(q, r):
        near = np.bitwise_count(np.array(q, np.uint32)[:, None] ^ np.array(r, np.uint32)[None, :]) <= 1
        votes = collections.Counter((int(b) - int(a)) for a, b in zip(*np.nonzero(near)))
        if not votes:
            return None
        shift = min(votes, key=lambda s: (-votes[s], abs(s), s))
        first = max(0, -shift)
        n = min(len(q) - first, len(r) - first - shift)
        if votes[shift] < 2 or n < 12:
            return None
        wrong = int(np.bitwise_count(np.array(q[first : first + n], np.uint32) ^ np.array(r[first + shift : first + shift + n], np.uint32)).sum())
        return (wrong / (32 * n), shift) if wrong <= 0.15 * 32 * n else None

    want = collections.Counter()
    for i, c in zip(ids, codes):
        found = [(*m, least[q]) for q in asked if i is not None and c and q != c and (m := best(q, c)) is not None]
        want[i, tuple((rate, k, shift) for rate, shift, k in sorted(found, key=lambda x: (x[0], x[2])))] += 1
    have = collections.Counter((r.rec_id, tuple(zip(r.error_rates, r.matches, r.offsets))) for r in got)
    assert have == want and sum(len(k[1]) for k in want) > 20


def test_sound_aligns_with_its_shifted_and_noisy_copy(spark):
    rng = np.random.default_rng(0)
    tune = melody(1, 14)
    clips = {50: tune, 1: tune[audio.HOP * 8 :], 2: tune + rng.normal(0, 120, len(tune)), 3: melody(2, 14), 4: melody(3, 14), 5: np.zeros(60000), 6: tune[:2000]}
    rows = [(k, wav(v)) for k, v in clips.items()] + [(7, None), (8, b"junk"), (None, wav(tune)), (9, wav(tune))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "vec_id long, sound binary"), "vec_id", "sound")
    got = {r.rec_id: r for r in audio.aligned(prints, F.col("rec_id") % 50 == 0).collect()}
    assert len(got) == len(rows)
    assert got[1].matches == [9] and got[1].offsets == [-8] and got[1].error_rates[0] < 0.01  # 9 and 50 are one class
    assert got[2].matches == [9] and got[2].offsets == [0]
    assert got[50].class_id == got[9].class_id == 9 and got[50].matches == []
    assert all(got[k].n_matches == 0 for k in (3, 4, 5, 6, 7, 8, None))
    empty = audio.fingerprints(spark.createDataFrame([], "vec_id long, sound binary"), "vec_id", "sound")
    assert audio.aligned(empty, F.col("rec_id") % 50 == 0).count() == 0


def word_grams(text, n=5):
    w = (text or "").split()  # test texts hold no white space but blanks and line ends
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_copies_gone(rows):
    """Rows (doc_id, text) that stay: one of each group that pairs of similarity 0.8 or more make; all pairs, plainly."""
    sets = [word_grams(t) for _, t in rows]
    stays = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo and rows[i][0] is not None:
            k = todo.pop()
            for j in range(len(rows)):
                if j not in seen and rows[j][0] is not None and sets[j] and sets[k] and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]):
                    seen.add(j)
                    todo.append(j)
        if rows[i][0] is None or (rows[i][0] == min(rows[j][0] for j in seen) and rows[i] not in rows[:i]):
            stays.append(i)
    return stays


def windows_gone(rows, n=13):
    """Texts of rows (doc_id, text) without words of windows that a smaller id holds."""
    least = {}
    for doc, text in rows:
        w = (text or "").split()
        for i in range(len(w) - n + 1 if doc is not None else 0):
            least[tuple(w[i : i + n])] = min(doc, least.get(tuple(w[i : i + n]), doc))
    out = []
    for doc, text in rows:
        w = (text or "").split()
        gone = {i + k for i in range(len(w) - n + 1 if doc is not None else 0) if least[tuple(w[i : i + n])] < doc for k in range(n)}
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone) if gone else text)
    return out


def odd_documents():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeioulmnprst") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = prose(30), prose(80)
    texts = [prose(rng.randint(8, 60)) + (" " + shared + " " + prose(5) if i % 7 == 0 else "") for i in range(60)]
    texts += [base, base + " more", "some " + base, base]
    rows = [(2 * i, t, "it", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[3]] * 20 + [(6, prose(40), "it", "s1"), (None, texts[5], None, None), (None, texts[5], None, None), (900, None, "it", "s1"), (902, "", "it", None), (904, "12 34 !", None, "s2"), (-2, texts[11], None, "s2")]
    return [(*r, len(r[1] or ""), i, 1, 2, 3.0, "x", "y", 4, 5, 6) for i, r in enumerate(rows)]


ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, kept_id int, kept_times int, score double, lang_pred string, kept_text string, copy int, batch_no int, place int"


def test_pipeline_stages_against_plain_loops(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "mixing to target weights", "packing"]
    stages, folder = dict(pipeline.STAGES), f"file://{tmp_path}"
    made = odd_documents()
    docs = spark.createDataFrame(made, ODD)
    step = 0

    def run(name, df):
        nonlocal step
        step += 1
        out = stages[name](spark, df, folder)
        if name != "packing":
            assert out.columns == df.columns and out.dtypes == df.dtypes
        out.write.parquet(f"{folder}/{step}")
        return spark.read.parquet(f"{folder}/{step}")

    first = run("language ID", docs)
    assert sorted(r.row for r in first.collect()) == [r[5] for r in made if any(c.isalpha() for c in r[1] or "")]
    assert first.join(docs, docs.columns, "left_anti").where("lang is not null and source is not null").count() == 0

    rows = sorted(((r.doc_id, r.text, r.row) for r in docs.collect()), key=lambda r: r[2])
    second = run("n-gram Jaccard join", docs)
    got = sorted(((r.doc_id, r.text) for r in second.collect()), key=repr)
    assert got == sorted((rows[i][:2] for i in near_copies_gone([r[:2] for r in rows])), key=repr) and len(got) < len(rows) - 20

    third = run("substring dedup", docs)
    assert {r.row: (r.text, r.n_chars) for r in third.collect()} == {r[2]: (t, len(t or "")) for r, t in zip(rows, windows_gone([r[:2] for r in rows]))}
    assert sum(a[1] != b for a, b in zip(rows, windows_gone([r[:2] for r in rows]))) > 5

    fourth = run("mixing to target weights", docs)
    sizes, count = {}, {}
    for r in made:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode())
    shares = {k: v**0.7 for k, v in sizes.items()}
    for r in made:
        u = int(hashlib.md5(f"17:count:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        rate, k, below = shares[r[3]] / sum(shares.values()) * sum(sizes.values()) / sizes[r[3]], 0, 0.0
        while (below := below + math.exp(-rate) * rate**k / math.factorial(k)) <= u:
            k += 1
        count[r[5]] = k
    assert collections.Counter(r.row for r in fourth.collect()) == collections.Counter({k: v for k, v in count.items() if v})

    fifth = run("packing", docs)
    from tokenizers import Tokenizer

    plain, whole = Tokenizer.from_file(registry.tokenizer_path()), collections.Counter()
    for r in fifth.collect():
        whole[r.doc_id, bytes(r.ids)] += 1
    assert whole == collections.Counter((r[0], np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in made)

    docs.limit(0).write.parquet(f"{folder}/empty/documents.parquet")
    assert pipeline.run(spark, f"{folder}/empty").count() == 0
    docs.write.parquet(f"{folder}/odd/documents.parquet")
    assert pipeline.run(spark, f"{folder}/odd").count() > 0
    clean = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert stages["language ID"](spark, clean, folder).count() > 0.95 * clean.count()


def test_registered_queries_have_the_contract_columns(spark):
    want = {
        "op1": "doc_id size text_crc32 law shard slot grown_shard", "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op6": "vec_id n_links component_id kept",
        "op8": "doc_id n_words n_removed kept_sha256", "op9": "doc_id n_bytes n_removed n_spans kept_sha256", "op10": "doc_id held_out lang_pred score",
    }
    for name, query in registry.QUERIES.items():
        if (columns := want.get(name.split("_")[0])) is not None:
            assert set(columns.split()) <= set(query(spark, "/root/testdata/sf0.001").columns)
