"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, compression, language, line_crf, merkle, mixing, oph, perspectives, revisits, simhash, token_files, topk, whitening
from parley.llm.captures import CAPTURES_SQL, captures
from parley.llm.shared import id_remainder, table
from parley.session import work_path

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    model = line_crf.fit(docs, labels, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), line_crf.score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= line_crf.GOOD_FROM).cast("int"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = token_files.write(docs, work_path(spark, "token-files"), vocabulary_path())
    return token_files.read(written, docs).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op4_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oph.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", oph.edited_with_next(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_packed", oph.packed(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        oph.hex_string(F.col("packed")).alias("fingerprint"),
        oph.hex_string(F.col("edited_packed")).alias("edited_fingerprint"),
        oph.likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        oph.likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(plan).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken"
    )


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), language.predict(F.col("text"), model).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(F.array_sort(lines), "\n"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", bpe.round_trip(F.col("text").cast("string"), vocabulary_path()).alias("r")
    )
    return rows.select(
        "doc_id",
        bpe.n_ids(F.col("r.ids")).alias("n_tokens"),
        F.sha2("r.ids", 256).alias("ids_sha256"),
        F.sha2("r.decoded", 256).alias("decoded_sha256"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", compression.measures(F.col("text").cast("string")).alias("m")
    )
    failed = compression.base_failed(F.col("m"))
    return rows.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        failed.alias("base_failed"), (~failed & compression.within_bands(F.col("m"))).alias("kept"),
        "m.ratio", "m.odd_share",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    tree = merkle.build(table(spark, sf_dir, "documents"), tampered=flat, tampered_where=id_remainder("doc_id", 2) == 0)
    return merkle.verified(tree).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_line_crf_quality": op1_line_crf_quality,
    "op2_exact_topk": op2_exact_topk,
    "op3_token_files": op3_token_files,
    "op4_oph_fingerprints": op4_oph_fingerprints,
    "op5_source_mixing": op5_source_mixing,
    "op6_perspectives": op6_perspectives,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_revisits": op9_revisits,
    "op10_bpe": op10_bpe,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_compression_bands": op12_compression_bands,
    "op13_merkle_manifest": op13_merkle_manifest,
}
OP2_SQL = """
with usable as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from usable q join usable c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""

OP6_SQL = """
with rows as (
  select conv_id, cast(turn as bigint) as turn, role as speaker, coalesce(text, '') as text from conversations
), people as (
  select distinct conv_id, speaker as perspective from rows where speaker is distinct from 'system'
), seen as (
  select p.conv_id, p.perspective, r.turn, r.speaker, r.text,
    case when r.speaker is not distinct from 'system' then 'system'
      when r.speaker is not distinct from p.perspective then 'assistant' else 'user' end as role
  from people p join rows r on r.conv_id is not distinct from p.conv_id
), named as (
  select *, case when role = 'user' then coalesce(speaker, '') end as name from seen
), headed as (
  select *, '<|im_start|>' || role || case when name <> '' then ' name=' || name else '' end || chr(10) as head from named
), rendered as (
  select *, head || text || '<|im_end|>' || chr(10) as rendered from headed
), placed as (
  select *, coalesce(sum(length(rendered)) over (
    partition by conv_id, perspective order by turn nulls first, speaker nulls first, text
    rows between unbounded preceding and 1 preceding), 0) as start
  from rendered
)
select conv_id, perspective, turn, role, name, rendered, cast(start as bigint) as start,
  cast(start + length(head) as bigint) as mask_from,
  cast(start + length(head) + case when role = 'assistant' then length(text) + 10 else 0 end as bigint) as mask_to
from placed
"""

OP9_SQL = f"""
with {CAPTURES_SQL}, split as (
  select *, regexp_replace(trim(url), '#.*$', '') as clean from captures
), parted as (
  select *, lower(regexp_extract(clean, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
    lower(regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)) as place,
    regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) as rest
  from split
), canon as (
  select *, case when scheme = '' then clean else scheme || '://' ||
    case when scheme = 'http' then regexp_replace(place, ':80$', '')
      when scheme = 'https' then regexp_replace(place, ':443$', '') else place end ||
    case when starts_with(rest, '/') then rest else '/' || rest end end as canonical_url
  from parted
), answers as (
  select * from canon where kind = 'response'
  qualify row_number() over (partition by canonical_url, ts order by record_id desc) = 1
), asked as (
  select r.record_id, r.canonical_url, r.ts, a.record_id as response_id,
    r.etag as fresh_tag, r.modified as fresh_date, a.etag as tag, a.modified as old_date, a.ctype,
    coalesce(r.cache, a.cache) as cache, coalesce(r.date, a.date) as date, coalesce(r.etag, a.etag) as etag,
    coalesce(r.expires, a.expires) as expires
  from (select * from canon where kind = 'revisit') r
  asof left join answers a on r.canonical_url = a.canonical_url and r.ts > a.ts
), judged as (
  select *, case when response_id is null then 'no_response'
    when fresh_tag is not null and tag is not null then
      case when regexp_replace(fresh_tag, '^W/', '') = regexp_replace(tag, '^W/', '') then 'resolved' else 'mismatch' end
    when fresh_date is not null and old_date is not null then
      case when fresh_date = old_date then 'resolved' else 'mismatch' end
    else 'unverified' end as status
  from asked
)
select record_id, canonical_url, ts, status, response_id,
  case when status = 'resolved' then concat_ws(chr(10), 'cache-control: ' || cache, 'content-type: ' || ctype,
    'date: ' || date, 'etag: ' || etag, 'expires: ' || expires, 'last-modified: ' || old_date) end as headers
from judged
"""

_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
# Whether the last bit of the crc32 of an id's digits is 0 (null: no).
_TAMPERED = """list_reduce(list_prepend(cast(4294967295 as bigint),
    list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda crc, byte:
  list_reduce(list_prepend(xor(crc, byte), [cast(i as bigint) for i in range(8)]), lambda c, i:
    case when c % 2 = 1 then xor(c // 2, cast(3988292384 as bigint)) else c // 2 end)) % 2 = 1"""

OP13_SQL = f"""
with recursive rows as (
  select row_number() over (partition by source order by doc_id nulls first, {_LEAF.format(text="text")}) - 1 as idx,
    count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as tree,
    doc_id, {_LEAF.format(text="text")} as leaf,
    case when {_TAMPERED} then {_LEAF.format(text="replace(text, chr(10), '')")} else {_LEAF.format(text="text")} end as climbs
  from documents
), lower as (
  select tree, cast(0 as bigint) as level, idx, n, leaf as hash from rows
  union all
  select tree, level + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(hash, '' order by idx))
  from lower where n > 1 group by tree, level, idx // 3
), subroots as (
  select tree, hash, count(*) over () as n from lower where n = 1
), upper as (
  select cast(0 as bigint) as level, cast(tree as bigint) as idx, n, hash from subroots
  union all
  select level + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(hash, '' order by idx))
  from upper where n > 1 group by level, idx // 3
), runs as (
  select tree, level, idx // 3 as run, list(hash order by idx) as own from lower where n > 1 group by all
), over_runs as (
  select level, idx // 3 as run, list(hash order by idx) as own from upper where n > 1 group by all
), low_climb as (
  select tree, idx as row, idx, cast(0 as bigint) as level, climbs as hash, '' as proof from rows
  union all
  select c.tree, c.row, c.idx // 3, c.level + 1,
    sha256(array_to_string(list_concat(r.own[:c.idx % 3], [c.hash], r.own[c.idx % 3 + 2:]), '')),
    c.proof || array_to_string(list_concat(r.own[:c.idx % 3], r.own[c.idx % 3 + 2:]), '')
  from low_climb c join runs r on r.tree = c.tree and r.level = c.level and r.run = c.idx // 3
), at_subroot as (
  select * from low_climb qualify row_number() over (partition by tree, row order by level desc) = 1
), high_climb as (
  select tree, row, cast(tree as bigint) as idx, cast(0 as bigint) as level, hash, proof from at_subroot
  union all
  select c.tree, c.row, c.idx // 3, c.level + 1,
    sha256(array_to_string(list_concat(r.own[:c.idx % 3], [c.hash], r.own[c.idx % 3 + 2:]), '')),
    c.proof || array_to_string(list_concat(r.own[:c.idx % 3], r.own[c.idx % 3 + 2:]), '')
  from high_climb c join over_runs r on r.level = c.level and r.run = c.idx // 3
), at_root as (
  select * from high_climb qualify row_number() over (partition by tree, row order by level desc) = 1
)
select r.doc_id, r.leaf, s.hash as subroot, u.hash as root, sha256(a.proof) as proof_sha256, a.hash as folded_root,
  a.hash = u.hash as verified
from rows r join subroots s on s.tree = r.tree join at_root a on a.tree = r.tree and a.row = r.idx
join upper u on u.n = 1
"""

ORACLES: dict[str, str] = {
    "op2_exact_topk": OP2_SQL,
    "op6_perspectives": OP6_SQL,
    "op9_revisits": OP9_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
