"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import alignment, fixity, importance, lzprint, neardup, orc_tokens, outliers, packing, pfair, pii, repeats, secret_scan, slots
from siteloom.llm.common import documents, work_path


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a copy of the pages' archives: records whose digest starts with 00 have another first character, those with 01 are gone, and after those with 02 a second copy lies one byte on."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    layout = fixity.archive_layout(pages)
    changed = pages.select(
        F.col("page_id").cast("bigint"), F.sha2(fixity.warc_record(F.col("url"), F.col("html")), 256).alias("digest"),
        F.sha2(fixity.warc_record(F.col("url"), F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))), 256).alias("rotten"),
    ).where(F.col("digest").startswith("00")).dropDuplicates(["page_id", "digest"])
    copy = layout.join(changed, ["page_id", "digest"], "left").where(~F.col("digest").startswith("01"))
    replica = copy.select("archive", "piece", "offset", F.coalesce("rotten", "digest").alias("digest"))
    second = layout.where(F.col("digest").startswith("02")).select("archive", "piece", (F.col("offset") + 1).alias("offset"), "digest")
    return fixity.fixity_audit(pages, replica.unionByName(second)).select("page_id", "archive", "piece", "offset", "length", "copies", "damage", "digest", "found_digest")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard_documents(documents(spark, sf_dir))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_verdicts(documents(spark, sf_dir))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix_schedule(documents(spark, sf_dir)).select("doc_id", "source", "block", "release", "deadline", "slot", "place")


def op5_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op9_lempel_ziv_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprint_documents(documents(spark, sf_dir))


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    orc_tokens.write_tokens(documents(spark, sf_dir), path)
    return orc_tokens.token_index(spark, path)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir))


def op12_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_merkle_fixity, op2_virtual_slots, op3_robust_outliers, op4_pfair_mix, op5_bottom_k_dedup, op6_boosted_pii, op7_markov_secrets, op8_hierarchical_packing, op9_lempel_ziv_prints, op10_orc_tokens, op11_token_alignment, op12_interval_expansion, op13_importance_resampling)}


#: The records of pages that op1 damages, found by comparing every digest.
OP1_SQL = f"""
with r as (select page_id, coalesce(url, '') as url, coalesce(html, '') as body, '#' || substr(html, 2) as rot, chr(13) || chr(10) as nl from pages),
m as (select *, md5(url || ' ' || body) as m1, md5(url || ' ' || coalesce(rot, '')) as m2 from r),
w as (select page_id,
    'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr(m1, 1, 8), substr(m1, 9, 4), substr(m1, 13, 4), substr(m1, 17, 4), substr(m1, 21, 12)) || '>' || nl || 'WARC-Date: {fixity.DATE}'
      || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || octet_length(encode(body)) || nl || nl || body as record,
    'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr(m2, 1, 8), substr(m2, 9, 4), substr(m2, 13, 4), substr(m2, 17, 4), substr(m2, 21, 12)) || '>' || nl || 'WARC-Date: {fixity.DATE}'
      || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || octet_length(encode(coalesce(rot, ''))) || nl || nl || coalesce(rot, '') as rotten from m),
d as (select page_id, sha256(record) as digest, octet_length(encode(record)) + 4 as length, sha256(rotten) as rotten from w),
u as (select page_id, digest, length, min(rotten) as rotten, count(*) as copies from d group by all),
a as (select *, coalesce(cast(floor(page_id / 1024) as bigint), 0) as archive from u),
p as (select *, cast(('0x' || substr(digest, 1, 8))::bigint % cast(ceil(count(*) over (partition by archive) / 4096) as bigint) as integer) as piece from a),
o as (select *, cast(coalesce(sum(length) over (partition by archive, piece order by page_id nulls first, digest rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from p)
select page_id, archive, piece, "offset", cast(length as bigint) as length, copies, case when digest like '00%' then 'changed' else 'missing' end as damage,
  digest, case when digest like '00%' then rotten end as found_digest
from o where digest like '00%' or digest like '01%'
union all select null, archive, piece, "offset" + 1, null, null, 'extra', null, digest from o where digest like '02%'
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_fixity": OP1_SQL}
