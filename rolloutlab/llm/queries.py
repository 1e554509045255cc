"""Queries over the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embedding_dedup import near_vectors
from .fingerprints import fingerprint_documents
from .html_extraction import extract
from .infilling import infilled_digests
from .language_id import identify
from .line_dedup import dedup_lines
from .mixing import mix_sizes
from .packing import pack_documents
from .sharding import shard_documents
from .simhash_dedup import near_duplicates
from .toxicity import score_documents
from .url_filters import filter_urls, rule_table
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"), weights=(3, 1, 2), total=1.5, most=2.0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_words=50)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), sequence=1024, with_ids=False)


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilled_digests(table(spark, sf_dir, "documents"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, rule_table(pages))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_html_extraction": op2_html_extraction,
        "op3_fingerprints": op3_fingerprints,
        "op4_sharding": op4_sharding,
        "op5_language_id": op5_language_id,
        "op6_line_dedup": op6_line_dedup,
        "op7_simhash_dedup": op7_simhash_dedup,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_infilling": op11_infilling,
        "op12_url_filters": op12_url_filters,
        "op13_whitening": op13_whitening,
    }


OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
near AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT n.a, l.b FROM near n JOIN link l ON n.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM near GROUP BY 1), deg AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM comp c LEFT JOIN deg USING (vec_id)"""


#: Jump hashing as a recursion over the keys; CRC-32 by a table made from its polynomial.
OP4_SQL = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), bits AS (SELECT n, n AS c, 0 AS k FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8), raw AS (SELECT doc_id, x, hex(encode(x)) AS h FROM d),
sized AS (SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32 FROM raw, crc),
jump AS (SELECT DISTINCT doc_id, (coalesce(doc_id, -1)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key, -1::BIGINT AS shard, 0::BIGINT AS ahead FROM d UNION ALL
 SELECT doc_id, k, ahead, CAST(floor((ahead + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(k // 8589934592 AS DOUBLE) + 1))) AS BIGINT) FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jump WHERE ahead < 24)),
placed AS (SELECT s.*, j.shard, j.ahead FROM sized s JOIN jump j ON s.doc_id IS NOT DISTINCT FROM j.doc_id AND j.ahead >= 24)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY coalesce((doc_id % 1024 + 1024) % 1024, -1), doc_id, size, text_crc32) - 1 AS slot, CAST(CASE WHEN ahead = 24 THEN 24 ELSE shard END AS INTEGER) AS grown_shard FROM placed"""


OP6_SQL = r"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+$', '')), lambda x: x <> '') AS ls FROM documents),
w AS (SELECT doc_id, ls, list_transform(ls, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS ws FROM d),
p AS (SELECT doc_id, ls, ws, unnest(range(1, len(ls) + 1)) AS i FROM w),
m AS (SELECT doc_id, ls, i, list_filter(range(1, 51), lambda m: i + m - 1 <= len(ls) AND list_sum(ws[i:i + m - 1]) >= 50)[1] AS ahead, list_filter(range(1, 51), lambda m: i - m + 1 >= 1 AND list_sum(ws[i - m + 1:i]) >= 50)[1] AS back FROM p),
r AS (SELECT DISTINCT doc_id, start, n, run FROM (SELECT doc_id, i AS start, ahead AS n, ls[i:i + ahead - 1] AS run FROM m WHERE ahead IS NOT NULL UNION ALL SELECT doc_id, i - back + 1, back, ls[i - back + 1:i] FROM m WHERE back IS NOT NULL)),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS place FROM r),
g AS (SELECT doc_id, list(DISTINCT line) AS gone FROM (SELECT doc_id, unnest(range(start, start + n)) AS line FROM k WHERE place > 1) GROUP BY 1)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_deleted,
 CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text FROM d LEFT JOIN g USING (doc_id)"""


OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS b, greatest(h1 % (n + 1), h2 % (n + 1)) AS e, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, '<P>' || substring(t, 1, b) AS pre, '<M>' || substring(t, b + 1, e - b) AS mid, '<S>' || substring(t, e + 1, n - e) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN b END AS prefix_chars, CASE WHEN form <> 'plain' THEN e - b END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


OP12_SQL = r"""WITH r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (SELECT row, page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY row ORDER BY length(h) + length(p) DESC, length(h) DESC) AS place
 FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) WHERE place = 1"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express: op4, op11 and op12 fully, op6 by comparing the runs themselves, op8 all pairs of a label."""
    return {"op4_sharding": OP4_SQL, "op6_line_dedup": OP6_SQL, "op8_embedding_dedup": OP8_SQL, "op11_infilling": OP11_SQL, "op12_url_filters": OP12_SQL}
