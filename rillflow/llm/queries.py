"""Registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, revisits, ring, secrets, spelling, tagpaths, toxicity
from .bagminhash import near_duplicates
from .decontaminate import contaminated
from .packing import pack
from .quality import COUNTS, risk_controlled
from .substring import remove_repeats
from .suffix import remove_repeated_bytes


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl records made from pages: three full responses each, under different spellings of the URL, and two revisits.

    The first revisit follows the second response, the second one the third.  Every thirteenth page's last response is a
    404.  Every seventh page's revisits still hold the first tag, every fifth have no tag but a date, every eleventh no
    validator."""
    body, n, k = F.coalesce(F.col("html"), F.lit("")), F.col("page_id"), F.col("k")
    text = lambda c: c.cast("string")
    tag = lambda k: F.concat(F.lit('"'), F.substring(F.md5(body.cast("binary")), 1, 16), text(k), F.lit('"'))
    date = lambda k: F.concat(F.lit("day "), text(n % 365), F.lit("."), text(k))
    bare = F.regexp_replace("url", "^https?://", "")
    spelled = F.when(k == 0, F.col("url")).when(k == 1, F.concat("url", F.lit("#part"))).otherwise(F.concat(F.lit("HTTP://user@www."), bare))
    first = pages.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select(
        (n * 8 + k).alias("record_id"), spelled.alias("url"), (n * 60 + k * 200_000).alias("ts"), F.lit("response").alias("kind"), F.when((n % 13 == 0) & (k == 2), 404).otherwise(200).alias("http_status"),
        tag(k).alias("etag"), date(k).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag(k), F.lit("date"), F.concat(F.lit("t"), text(n))).alias("headers"),
    )
    latest = F.when(n % 13 == 0, F.lit(1)).otherwise(k + 1)
    seen = F.when(n % 7 == 0, tag(F.lit(0))).when(n % 3 == 0, F.concat(F.lit("W/"), tag(latest))).otherwise(tag(latest))
    bare_ = n % 11 == 0
    again = pages.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (n * 8 + 4 + k).alias("record_id"), "url", (n * 60 + 300_000 + k * 300_000).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"),
        F.when(~bare_ & (n % 5 != 0), seen).alias("etag"), F.when(~bare_ & (n % 5 == 0), date(latest)).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Date"), F.concat(F.lit("r"), text(n)), F.lit("expires"), F.lit("later"), F.lit("server"), F.lit("x")).alias("headers"),
    )
    return first.unionByName(again)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(page_records(_read(spark, sf_dir, "pages")))
    flat = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "canonical", "response_id", "status", flat.alias("headers"))


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.place(_read(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tagpaths.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_bytes(docs, length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, threshold=0.8).select("doc_id", "class_id", "class_size", "n_joins")


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, column="score")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    pieces = pack(docs, word_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = contaminated(docs, _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "best_item", "best_score", "n_items", "contaminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = risk_controlled(docs, _read(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text")), F.col("found")
    counts = [secrets.count_of(found, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(secrets.listed(found, ("assign", "access", "hex")), 256).alias("base_sha256"), secrets.listed(found).alias("spans"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _read(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_bounded_ring": op2_bounded_ring,
    "op6_tag_path_text": op6_tag_path_text,
    "op3_substring_dedup": op3_substring_dedup,
    "op7_compression_toxicity": op7_compression_toxicity,
    "op8_mixture_packing": op8_mixture_packing,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op5_bagminhash": op5_bagminhash,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}

_TAG = "'\"' || substring(md5(coalesce(html, '')), 1, 16) || {} || '\"'"
_LATEST = "(CASE WHEN page_id % 13 = 0 THEN 1 ELSE k + 1 END)"
_RECORDS = f"""
SELECT page_id * 8 + k AS record_id, CASE k WHEN 0 THEN url WHEN 1 THEN url || '#part' ELSE 'HTTP://user@www.' || regexp_replace(url, '^https?://', '') END AS url, page_id * 60 + k * 200000 AS ts, TRUE AS is_full,
  CASE WHEN page_id % 13 = 0 AND k = 2 THEN 404 ELSE 200 END AS http_status, {_TAG.format('k')} AS etag, 'day ' || (page_id % 365) || '.' || k AS last_modified, page_id FROM pages, (VALUES (0), (1), (2)) v(k)
UNION ALL SELECT page_id * 8 + 4 + k, url, page_id * 60 + 300000 + k * 300000, FALSE, 304,
  CASE WHEN page_id % 11 <> 0 AND page_id % 5 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN {_TAG.format("'0'")} WHEN page_id % 3 = 0 THEN 'W/' || {_TAG.format(_LATEST)} ELSE {_TAG.format(_LATEST)} END END,
  CASE WHEN page_id % 11 <> 0 AND page_id % 5 = 0 THEN 'day ' || (page_id % 365) || '.' || {_LATEST} END, page_id FROM pages, (VALUES (0), (1)) v(k)"""
_CANONICAL = r"""
SELECT *, host || path || CASE WHEN parts <> '' THEN '?' || parts ELSE '' END AS canonical FROM (
 SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  coalesce((SELECT string_agg(q, '&' ORDER BY q) FROM (SELECT unnest(string_split(regexp_extract(rest, '\?(.*)$', 1), '&')) AS q) WHERE q <> ''), '') AS parts
 FROM (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM ({})))"""

ORACLES: dict[str, str] = {
    "op1_warc_revisits": f"""WITH c AS ({_CANONICAL.format(_RECORDS)}),
 m AS (SELECT r.record_id, r.canonical, r.etag, r.last_modified, r.page_id, o.record_id AS old_id, o.etag AS old_etag, o.last_modified AS old_modified, o.page_id AS old_page,
   row_number() OVER (PARTITION BY r.record_id ORDER BY o.ts DESC NULLS LAST, o.record_id DESC) AS k
  FROM (SELECT * FROM c WHERE NOT is_full) r LEFT JOIN (SELECT * FROM c WHERE is_full AND http_status = 200) o ON o.canonical = r.canonical AND o.ts < r.ts),
 s AS (SELECT *, CASE WHEN old_id IS NULL THEN 'no_response' WHEN regexp_replace(etag, '^W/', '') <> old_etag OR last_modified <> old_modified THEN 'mismatch'
   WHEN etag IS NULL AND last_modified IS NULL THEN 'no_validator' ELSE 'resolved' END AS status FROM m WHERE k = 1)
 SELECT record_id, canonical, old_id AS response_id, status, CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=r' || page_id || ';etag=' || old_etag || ';expires=later' END AS headers FROM s""",
    "op3_substring_dedup": r"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 p AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
 win AS (SELECT rid, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM p),
 hit AS (SELECT DISTINCT rid, i + k AS pos FROM (SELECT rid, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)), (SELECT unnest(range(0, 35)) AS k)),
 wd AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
 kept AS (SELECT wd.rid, string_agg(wd.word, ' ' ORDER BY wd.pos) AS t, count(*) AS n FROM wd LEFT JOIN hit ON hit.rid = wd.rid AND hit.pos = wd.pos WHERE hit.rid IS NULL GROUP BY wd.rid)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.rid = d.rid""",
    "op12_filter_audit": r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 f AS (SELECT doc_id, part, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS fe FROM w),
 g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN g ON g.doc_id = f.doc_id GROUP BY 1, 2),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
 s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
 r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
   sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
   sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
    "op13_spelling_variants": r"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
 r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 d AS (SELECT id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY 1, 2),
 b AS (SELECT run, k, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))) AS bytes FROM d),
 h AS (SELECT run, k, xor(list_reduce(bytes, lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) AS h FROM b, t),
 w AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
 v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
 p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
 g AS (SELECT word, n, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS z FROM p),
 x AS (SELECT DISTINCT word, n, a || z AS short FROM g),
 m AS (SELECT g.word, o.word AS other, o.n FROM g JOIN g o ON o.i = g.i AND o.a = g.a AND o.z = g.z AND o.word <> g.word
  UNION ALL SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.short UNION ALL SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.short),
 f AS MATERIALIZED (SELECT v.word, v.n, c.n_near, CASE WHEN c.best_n >= 5 * v.n THEN c.best END AS form, CASE WHEN c.best_n >= 5 * v.n THEN c.best_n END AS form_n FROM v LEFT JOIN
  (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM m GROUP BY word) c ON c.word = v.word),
 s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
 SELECT f.word, f.form, s.root, f.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM f JOIN s ON s.word = f.word JOIN f e ON e.word = s.root AND e.form IS NULL""",
}
