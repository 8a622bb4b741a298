"""The queries of this subpackage, over the tables of a folder, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, langid, mixing, ngram_join, packing, sharding, substring_dedup, suffix_dedup, url_filter, vector_dedup
from .common import written

YEAR = 365 * 86400
START = 1704067200  # 2024-01-01 in seconds


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mixed(docs, alpha=0.7, epochs=1.0, seed=17, extras=True)
    return out.select("doc_id", "source", "n_copies", "copy", "shuffle_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_ffd_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), path or tokenizer_path(), 2048, 1)


def list_feed(pages: DataFrame) -> DataFrame:
    """Dated list entries, made by rule since no table holds any: half of the hosts, and one folder of a quarter, come and go on days that the host's MD5 names."""
    host = F.lower(F.regexp_extract("url", url_filter.HOST, 1)).alias("host")
    hosts = pages.select(host).where("host <> ''").distinct().withColumn("m", F.md5(F.col("host").cast("binary")))
    digit = lambda at, n: F.conv(F.substring("m", at, n), 16, 10).cast("long")
    added = digit(2, 2)
    removed = added + 30 + digit(4, 2) % 120
    entry = lambda pattern, action, day: F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), (START + day * 86400).alias("effective_at"))
    whole = F.when(digit(1, 1) < 8, F.array(entry(F.col("host"), "add", added), entry(F.col("host"), "remove", removed), entry(F.col("host"), "add", removed + 60)))
    folder = F.when(digit(7, 1) < 4, F.array(entry(F.concat("host", F.lit("/en/")), "add", digit(8, 2))))
    none = F.array().cast("array<struct<pattern:string,action:string,effective_at:long>>")
    return hosts.select(F.explode(F.concat(F.coalesce(whole, none), F.coalesce(folder, none))).alias("e")).select("e.*")


def op4_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (START + F.pmod(F.col("page_id") * 7919, F.lit(YEAR))).alias("fetched_at"))
    return url_filter.judged(captures, list_feed(pages), "url", "fetched_at")


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_table(spark, sf_dir, "documents"), 0.8, 5)


def op6_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.linked(_table(spark, sf_dir, "embeddings"), 0.9)


def op7_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound, so each vector of embeddings is sung; the queries are every recording whose id is divisible by 50."""
    prints = written(audio.fingerprints(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.sung), "fingerprints")
    return audio.aligned(prints, F.col("rec_id") % 50 == 0)


def op8_fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.deduplicated(docs, 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.deduplicated(docs, 100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return langid.identified(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_jump_hash_shards,
        op2_poisson_mixing,
        op3_ffd_packing,
        op4_temporal_url_filter,
        op5_chosen_path_join,
        op6_hnsw_dedup,
        op7_chroma_fingerprints,
        op8_fixed_block_dedup,
        op9_bwt_dedup,
        op10_string_kernel_langid,
    )
}

_HASH52 = "('0x' || substr(md5({}), 1, 13))::BIGINT"
_COMPONENTS = """
 reach(node, id) as (select {id}, {id} from {rows} union select l.a, r.id from reach r join both_ways l on l.b = r.node),
 least as (select node, min(id) as component_id from reach group by node)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_poisson_mixing": f"""
with bytes as (select source, coalesce(sum(strlen(text)), 0)::DOUBLE as b from documents group by source),
 rate as (select source, case when b <= 0 then 1.0::DOUBLE else pow(b, 0.7::DOUBLE) / (select sum(pow(b, 0.7::DOUBLE)) from bytes) * (select sum(b) from bytes) / b end as r from bytes),
 term as (select source, k, exp(-r + k * ln(r) - lgamma(k + 1)) as p from (select source, r, unnest(range(0, (r + 12 * sqrt(r) + 60)::BIGINT)) as k from rate)),
 cdf as (select source, k, sum(p) over (partition by source order by k) as c from term),
 drawn as (select doc_id, source, text, {_HASH52.format("'17:count:' || coalesce(doc_id::VARCHAR, 'null')")} / 4503599627370496.0::DOUBLE as u from documents),
 counted as (select d.doc_id, d.source, d.text, (select count(*) from cdf c where c.source is not distinct from d.source and c.c <= d.u) as n from drawn d)
select doc_id, source, n::BIGINT as n_copies, i::BIGINT as copy, {_HASH52.format("'17:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i::VARCHAR")} as shuffle_key, md5(text) as text_md5
from (select *, unnest(range(0, n::BIGINT)) as i from counted)""",
    "op4_temporal_url_filter": f"""
with captures as (select page_id, url, {START} + (page_id * 7919) % {YEAR} as fetched_at, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)) as host, lower(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1)) as path from pages),
 hosts as (select distinct host, md5(host) as m from captures where host <> ''),
 digits as (select host, ('0x' || substr(m, 1, 1))::BIGINT as d1, ('0x' || substr(m, 2, 2))::BIGINT as added, ('0x' || substr(m, 2, 2))::BIGINT + 30 + ('0x' || substr(m, 4, 2))::BIGINT % 120 as removed, ('0x' || substr(m, 7, 1))::BIGINT as d7, ('0x' || substr(m, 8, 2))::BIGINT as d8 from hosts),
 spans as (
  select host as pattern, {START} + added * 86400 as a, {START} + removed * 86400 as z from digits where d1 < 8
  union all select host, {START} + (removed + 60) * 86400, null from digits where d1 < 8
  union all select host || '/en/', {START} + d8 * 86400, null from digits where d7 < 4),
 hits as (select c.page_id, c.url, c.fetched_at, s.pattern, s.a from (select distinct page_id, url, fetched_at, host, path from captures) c join spans s
  on c.fetched_at >= s.a and (s.z is null or c.fetched_at < s.z) and (c.host = s.pattern or ends_with(c.host, '.' || s.pattern) or (s.pattern like '%/' and starts_with(c.host || c.path, s.pattern)))),
 verdicts as (select page_id, url, fetched_at, count(*) as n, min(pattern) as first_pattern, arg_min(a, pattern) as listed_since from hits group by all)
select c.page_id, c.url, c.fetched_at, nullif(c.host, '') as host, v.n is not null as blocked, coalesce(v.n, 0)::INTEGER as n_active, v.first_pattern, v.listed_since
from captures c left join verdicts v on v.page_id = c.page_id and v.url = c.url and v.fetched_at = c.fetched_at""",
    "op5_chosen_path_join": r"""
with recursive split as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents),
 grams as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from split where len(w) >= 5) union select doc_id, array_to_string(w, ' ') from split where len(w) between 1 and 4),
 sizes as (select doc_id, count(*) as n from grams group by doc_id),
 shared as (select x.doc_id as a, y.doc_id as b, count(*) as n from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by all),
 both_ways as materialized (select a, b, s.n = x.n and s.n = y.n as same from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 5 * s.n >= 4 * (x.n + y.n - s.n)),
""" + _COMPONENTS.format(id="doc_id", rows="documents") + """
select d.doc_id, least(d.doc_id, coalesce((select min(b) from both_ways l where l.a = d.doc_id and l.same), d.doc_id)) as class_id, (select count(*) from both_ways l where l.a = d.doc_id) as n_links, c.component_id, d.doc_id = c.component_id as kept
from documents d join least c on c.node = d.doc_id""",
    "op6_hnsw_dedup": """
with recursive usable as (select vec_id, embedding::DOUBLE[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 both_ways as materialized (select x.vec_id as a, y.vec_id as b from usable x join usable y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.9),
""" + _COMPONENTS.format(id="vec_id", rows="embeddings") + """
select e.vec_id, (select count(*) from both_ways l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept from embeddings e join least c on c.node = e.vec_id""",
    "op8_fixed_block_dedup": r"""
with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 windows as (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from split where len(w) >= 13)),
 least as (select g, min(doc_id) as d from windows group by g),
 gone as (select doc_id, i from windows join least using (g) where doc_id > d),
 covered as (select distinct doc_id, i + k as place from gone, range(0, 13) t(k)),
 kept as (select s.doc_id, len(s.w) as n, list_filter(s.w, lambda x, i: not list_contains(coalesce(c.places, []), i)) as k from split s left join (select doc_id, list(place) as places from covered group by doc_id) c using (doc_id))
select doc_id, n::BIGINT as n_words, (n - len(k))::BIGINT as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""",
    "op9_bwt_dedup": """
with raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 strings as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as g from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from raw where length(h) >= 200)),
 ranked as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from strings),
 gone as (select doc_id, i, lag(i) over (partition by doc_id order by i) as was from ranked where r > 1),
 runs as (select doc_id, i, sum(case when was is null or i > was + 100 then 1 else 0 end) over (partition by doc_id order by i) as run from gone),
 spans as (select doc_id, run, min(i) as a, max(i) + 100 as z from runs group by all),
 around as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as before, lead(a) over (partition by doc_id order by a) as after from spans),
 cut as (select doc_id, count(*) as n, sum(z - a) as removed, list(before order by a) as befores, list(a order by a) as starts, max(z) as tail from around group by doc_id)
select r.doc_id, (length(h) // 2)::BIGINT as n_bytes, coalesce(removed, 0)::BIGINT as n_removed, coalesce(n, 0)::BIGINT as n_spans,
 sha256(unhex(case when n is null then h else array_to_string(list_transform(range(1, n + 1), lambda k: substr(h, 2 * befores[k]::BIGINT + 1, 2 * (starts[k] - befores[k])::BIGINT)), '') || substr(h, 2 * tail::BIGINT + 1) end)) as kept_sha256
from raw r left join cut using (doc_id)""",
}
