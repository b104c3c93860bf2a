"""One query an operator, with production parameters, over its whole table; SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, license_scan, line_dedup, packing, pii, quality, setjoin, token_store, url_filter, warc
from .common import kept, table

#: Host and path rules of the URL filter (fixed values).
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_gone").cast("long").alias("n_removed_lines"), F.sha2("text", 256).alias("text_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "license_sha256", "license")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.blocked_domains(spark), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = warc.write(table(spark, sf_dir, "pages"))
    captures = warc.assemble(kept(warc.read(spark, names, with_content=False), "warc-records"))
    return captures.select(
        F.col("response.capture_key").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.expr("try_cast(regexp_extract(response.refers_to, '^<urn:capture:(-?[0-9]+):', 1) as bigint)").alias("refers_to"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_back(spark, token_store.write(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_license_scan, op3_url_filter, op4_pii, op5_warc, op6_packing, op7_decontamination, op8_token_store, op9_jaccard_join, op10_quality)}


def _url_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[0]))
    fits = {r: f"((host = '{r[: r.index('/')]}' or host like '%.{r[: r.index('/')]}') and starts_with(path, '{r[r.index('/') :]}'))" for r, _ in rules}
    domains = ", ".join(f"('{x}')" for x in (Path(url_filter.__file__).parent / "blocked_domains.txt").read_text("utf-8").split("\n") if x and x[0] != "#")
    case = lambda i: "case " + " ".join(f"when {fits[r[0]]} then '{r[i]}'" for r in rules) + " end"
    return f"""with u as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') as h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
        l(domain) as (values {domains}), v as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u)
        select page_id, host, path, {case(0)} as rule, coalesce({case(1)}, case when exists (select 1 from l where host = domain or ends_with(host, '.' || domain)) then 'block' else 'allow' end) as verdict from v"""


def _warc_sql() -> str:
    return """with p as (select page_id, coalesce(html, '') as h from pages),
        q as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest from p),
        m as (select payload_digest as d, max(page_id) as top from q where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id < top then top end as refers_to from q left join m on payload_digest = d"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.sql(), "op3_url_filter": _url_sql(), "op5_warc": _warc_sql()}
