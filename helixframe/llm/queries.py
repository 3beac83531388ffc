"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fingerprint, importance, katz, line_dedup, minhash, packing, phrases, pii, quality, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one with fewer partitions than the cluster has cores is dealt out, larger ones stay as they are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), digests_only=True)


def op2_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.captures_of(_table(spark, sf_dir, "pages"))
    contents = captures.where("status = 200").groupBy(F.col("record_id").alias("_of")).agg(F.min("payload").alias("content"))  # one of repeated rows
    found = warc.resolve(captures.withColumn("payload", F.when(F.col("status") == 200, F.col("record_id"))))  # contents travel once, after
    found = found.join(contents, F.coalesce("payload", "record_id") == F.col("_of"), "left").withColumn("payload", F.md5("content"))
    number = lambda c: F.substr(c, F.lit(2)).cast("long")
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select(number(F.col("record_id")).alias("page_id"), "canonical_url", "ts", number(F.col("target_id")).alias("target_page"), "outcome", headers.alias("headers"), "payload")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), digest.alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), vocabulary_path())
    packed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op11_packing": op11_packing, "op12_resampling": op12_resampling, "op13_phrases": op13_phrases, "op10_katz": op10_katz, "op1_suffix": op1_suffix, "op5_lines": op5_lines, "op2_tiling": op2_tiling, "op4_revisits": op4_revisits, "op3_fingerprint": op3_fingerprint, "op9_minhash": op9_minhash, "op6_quality": op6_quality, "op7_bpe": op7_bpe, "op8_pii": op8_pii}
_LUHN = "list_sum(list_transform(list_reverse(string_split(d, '')), lambda c, i: case when i % 2 = 1 then c::int else c::int * 2 - case when c::int > 4 then 9 else 0 end end)) % 10 = 0"
_MOD97 = "list_reduce(list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end), lambda a, x: (a * case when x < 10 then 10 else 100 end + x) % 97) = 1"
#: By kind: what a match must hold, v being the match, d its digits and b what stands before it.
_HOLDS = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 or ('0' || substr(ltrim(p, '0'), 1, 3))::int > 255)) = 0",
    "card": f"case when length(d) between 16 and 19 then {_LUHN} else false end",
    "phone": "length(d) between 8 and 15",
    "iban": _MOD97,
    "ssn": f"regexp_matches(b, '\\b(?:{pii.WORDS['ssn']})\\b')",
}


def _pii_sql() -> str:
    """The op8 query: positions follow from the lengths of matches and of the pieces between them."""
    steps = ["t as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents)"]
    for n, (kind, pattern) in enumerate(pii.PLAIN.items()):
        p = pattern.replace("(", "(?:").replace("[\\x20(?:)", "[\\x20()")
        steps.append(f"g{n} as (select r, text, regexp_extract_all(text, '{p}') as hits, regexp_split_to_array(text, '{p}') as gaps from t)")
        steps.append(f"h{n} as (select r, text, unnest(range(1, len(hits) + 1)) as i, hits, gaps from g{n})")
        steps.append(f"s{n} as (select r, text, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as s, hits[i] as v from h{n})")
        steps.append(f"k{n} as (select r, {n} as kind, '{kind}:' || s || ':' || (s + length(v)) as span, s from (select *, regexp_replace(v, '[^0-9]', '', 'g') as d, lower(substr(text, greatest(s - {pii.NEAR}, 0) + 1, least(s, {pii.NEAR}))) as b from s{n}) where {_HOLDS[kind]})")
    steps.append("k as (" + " union all ".join(f"select * from k{n}" for n in range(len(pii.PLAIN))) + ")")
    steps.append("a as (select r, " + ", ".join(f"count(*) filter (kind = {n}) as n_{kind}" for n, kind in enumerate(pii.BASE)) + f", string_agg(span, ',' order by kind, s) filter (kind < {len(pii.BASE)}) as base, string_agg(span, ',' order by kind, s) as spans from k group by r)")
    counts = ", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in pii.BASE)
    return "with " + ", ".join(steps) + f" select doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join a using (r)"


SQL: dict[str, str] = {
    "op4_revisits": """
with p as (select page_id, url, md5(coalesce(html, '')) as m, length(coalesce(html, '')) as size from pages),
u as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from p),
parts as (select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') as host,
  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
    lambda q: q <> '' and not regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))), '&') as query from u),
c as (select page_id, m, size, host || path || case when query <> '' then '?' || query else '' end as canonical_url from parts),
r as (select page_id, m, size, canonical_url, page_id * 10 as ts from c),
v as (select page_id, canonical_url, page_id * 10 + 50005 as ts, 'day-' || substr(m, 2, 6) as day,
  case when substr(m, 1, 1) < '4' then 'old' when substr(m, 1, 1) >= '8' then m end as etag from c),
j as (select v.page_id, v.canonical_url, v.ts, v.etag, v.day, r.page_id as target_page, r.m, r.size
  from v asof left join r on v.canonical_url = r.canonical_url and v.ts > r.ts),
o as (select *, case when target_page is null then 'orphan'
  when (etag is not null and etag = m) or (etag is null and day = 'day-' || substr(m, 2, 6)) then 'resolved' else 'changed' end as outcome from j)
select page_id, canonical_url, ts, target_page, outcome,
  case when outcome = 'resolved' then 'content-length=' || size || ';content-type=text/html;date=' || ts || ';etag=' || m || ';last-modified=day-' || substr(m, 2, 6) end as headers,
  case when outcome = 'resolved' then m end as payload from o""",
    "op8_pii": _pii_sql(),
    "op13_phrases": """
with p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from (select coalesce(lang, 'und') as lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
w as materialized (select lang, piece, word, lead(word, 1) over q as w2, lead(word, 2) over q as w3, lead(word, 3) over q as w4
  from (select lang, piece, unnest(ws) as word, generate_subscripts(ws, 1) as i from (select lang, ws, row_number() over () as piece from p)) window q as (partition by piece order by i)),
f as materialized (select lang, 1 as m, word as phrase, count(*) as f from w group by all having count(*) >= 30
  union all select lang, 2, word || ' ' || w2, count(*) from w where w2 is not null group by all having count(*) >= 30
  union all select lang, 3, word || ' ' || w2 || ' ' || w3, count(*) from w where w3 is not null group by all having count(*) >= 30
  union all select lang, 4, word || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) from w where w4 is not null group by all having count(*) >= 30),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as words from f where m > 1),
cut as (select c.lang, c.m, c.phrase, c.a, k, l.f as l, r.f as r, (2000000::hugeint * c.a) // (l.f::hugeint + r.f) as score from c join (values (1), (2), (3)) v(k) on k < c.m
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.words[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.words[k + 1:c.m], ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_of as (select lang, a as f, unnest(list_transform(range(1, m - n + 2), lambda s: array_to_string(words[s:s + n - 1], ' '))) as phrase from c join (values (2), (3)) v(n) on n < m),
held as (select lang, phrase, max(f) as f from inner_of group by all),
kept as (select b.* from best b left join held h on h.lang = b.lang and h.phrase = b.phrase where h.f is null or 100::hugeint * h.f < 80::hugeint * b.a),
n as (select lang, count(*) as n from w group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from kept join n using (lang)
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000""",
    "op12_resampling": """
with crc_table as (select list(list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end, b) order by b) as steps from range(256) r(b)),
w as (select 'd' as kind, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents
  union all select 't', null, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
f as (select kind, doc_id, word, count(*) as n from w group by all),
hashed as (select word, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::bigint), lambda c, x: xor(steps[(xor(c, x) % 256) + 1], c // 256), 4294967295::bigint)) % 10000 as bucket
  from (select distinct word from f), crc_table),
b as (select bucket, coalesce(sum(n) filter (kind = 'd'), 0) as s, coalesce(sum(n) filter (kind = 't'), 0) as t from f join hashed using (word) group by bucket),
g as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000) / ((s + 1)::double * (sum(t) over () + 10000))))::bigint as gain from b),
d as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from f join hashed using (word) join g using (bucket) where kind = 'd' group by doc_id),
h as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from documents left join d using (doc_id)),
scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from h),
placed as (select *, n_features >= 20 as fit, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, 10 * count(*) over (partition by n_features >= 20) // 100 as drawn from scored)
select doc_id, n_features, weight, score, case when fit and place <= drawn then place end as rank from placed""",
}
