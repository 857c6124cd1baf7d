"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocation, debruijn_dedup, decontaminate, hilbert, html_main, language, merkle, near_dup, packing, pseudonyms, suffix_dedup, telephony, url_filter
from .common import compact
from .common import table as whole_table

#: In production the key comes from a secret store; equal keys give equal pseudonyms.
PSEUDONYM_KEY = "voxelspark pseudonyms"
BLOCKED, ALLOWED = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return compact(whole_table(spark, sf_dir, name, *columns))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), BLOCKED, ALLOWED)


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), packing.tokenizer_path("word_bpe_49k.json"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.audio_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group_near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def private_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents", "doc_id", "text"), PSEUDONYM_KEY)


def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup.remove_repeated_words(table(spark, sf_dir, "documents", "doc_id", "text"))


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_digest(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine(table(spark, sf_dir, "documents", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": private_numbers,
    "op2_url_filter": url_rules,
    "op3_main_text": main_texts,
    "op4_packing": packed,
    "op5_repeated_words": repeated_words,
    "op6_benchmark_passages": benchmark_passages,
    "op7_language": languages,
    "op8_near_duplicates": near_duplicates,
    "op9_repeated_bytes": repeated_bytes,
    "op10_telephony": audio,
    "op11_merkle_manifest": manifest,
    "op12_hilbert_shards": sharded,
    "op13_collocations": phrases,
}

ORACLES = {
    "op6_benchmark_passages": r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
shingled AS (
  SELECT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM split),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, s FROM shingled WHERE kind = 'i')),
docs AS (SELECT DISTINCT id AS doc_id, s FROM shingled WHERE kind = 'd')
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS item_shingles, CAST(count(*) AS BIGINT) AS shared_shingles
FROM docs JOIN items USING (s) GROUP BY doc_id, item_id HAVING count(*) * 100 >= max(n) * 75
""",
    "op2_url_filter": r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM parts LEFT JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE
given AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS grp, n_chars,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, grp, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(length(CAST(m AS VARCHAR)) || ':' || m, '-') || tail) AS other
  FROM (SELECT *, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS m FROM given)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM hashed),
tree AS (
  SELECT grp, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY grp, level, idx // 2, n),
subroots AS (SELECT grp, h AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY level, idx // 2, n),
root AS (SELECT h AS root, level AS height FROM crown WHERE n = 1),
whole AS (
  SELECT grp, level, idx, h FROM tree WHERE n > 1
  UNION ALL
  SELECT s.grp, s.height + c.level, c.idx, c.h FROM subroots s, crown c WHERE c.level > 0 OR c.idx <> s.idx),
steps AS (
  SELECT l.grp, l.idx AS leaf_idx, k.level, CASE WHEN k.level < s.height THEN (l.idx >> k.level) % 2 ELSE (s.idx >> (k.level - s.height)) % 2 END AS side, w.h AS sibling
  FROM leaves l JOIN subroots s USING (grp), root r, LATERAL (SELECT unnest(range(s.height + r.height)) AS level) k
  LEFT JOIN whole w ON w.grp = l.grp AND w.level = k.level AND w.idx = xor(CASE WHEN k.level < s.height THEN l.idx >> k.level ELSE s.idx >> (k.level - s.height) END, 1)),
folded AS (
  SELECT grp, idx, 0 AS level, other AS h FROM leaves
  UNION ALL
  SELECT f.grp, f.idx, f.level + 1, sha256(CASE WHEN t.side = 1 THEN coalesce(t.sibling, '') || f.h ELSE f.h || coalesce(t.sibling, '') END)
  FROM folded f JOIN steps t ON t.grp = f.grp AND t.leaf_idx = f.idx AND t.level = f.level),
last AS (SELECT grp, idx, max_by(h, level) AS folded_root FROM folded GROUP BY grp, idx),
proof AS (SELECT grp, leaf_idx AS idx, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY grp, leaf_idx)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (grp) CROSS JOIN root JOIN last ON last.grp = leaves.grp AND last.idx = leaves.idx LEFT JOIN proof ON proof.grp = leaves.grp AND proof.idx = leaves.idx
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k AS words, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND a >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM candidates, (VALUES (1), (2)) p(k) WHERE k < words),
cuts AS (
  SELECT p.*, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * p.a * p.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM parts p JOIN counts l ON l.lang = p.lang AND l.phrase = p.first JOIN counts r ON r.lang = p.lang AND r.phrase = p.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidates WHERE words = 3),
displaced AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer * 100 >= c.a * 50)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN displaced USING (lang, phrase)) JOIN totals USING (lang)
WHERE rank <= 2000
""",
}
