"""The numbered queries over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from newsloom.llm import (
    ann, byte_bpe, exact_dedup, filter_audit, language, line_dedup, lm_scoring, merkle, mixing, piece_bpe, simhash,
    token_counts, url_filter)
from newsloom.llm.common import table
from newsloom.registry.base import Registry

REGISTRY = Registry()
add = REGISTRY.add

SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP_SQL = f"""WITH d AS (SELECT doc_id, {SQL_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""


@add("op1_exact_dedup", EXACT_DEDUP_SQL)
def op1_exact_dedup(spark, folder):
    found = exact_dedup.exact_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


URL_FILTER_SQL = f"""WITH u AS (
  SELECT page_id, {SQL_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hits USING (page_id)"""


@add("op2_url_filter", URL_FILTER_SQL)
def op2_url_filter(spark, folder):
    return url_filter.filter_pages(table(spark, folder, "pages"), url_filter.rule_table(spark))


@add("op3_line_dedup")
def op3_line_dedup(spark, folder):
    found = line_dedup.line_dedup(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        F.sha2("text", 256).alias("text_sha256"))


@add("op4_byte_bpe")
def op4_byte_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decoded("ids", path), 256).alias("decoded_sha256"))


@add("op5_token_counts")
def op5_token_counts(spark, folder):
    return token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


MIXING_SQL = r"""WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix' || coalesce(':' || doc_id, '')), 1, 13))::BIGINT AS draw FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
turned AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
  2.0::DOUBLE * source_size AS cap FROM sums),
levels AS (SELECT *, row_number() OVER o AS place, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM turned WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
level AS (SELECT arg_min(level, place) AS height FROM levels WHERE level * weight <= cap),
targets AS (SELECT source, source_size, coalesce(least(cap, height * weight), cap) AS target FROM levels, level),
split AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS certain FROM targets),
rows AS (SELECT d.*, source_size, target, certain, target - certain * source_size AS extra
  FROM docs d JOIN split s ON d.source IS NOT DISTINCT FROM s.source),
ranked AS (SELECT *, (random / (1 - random)) / nullif(chance / nullif(1 - chance, 0), 0) AS odds FROM (
  SELECT *, (draw + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS random, extra / nullif(source_size, 0) AS chance FROM rows)),
running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, draw, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked),
prefix AS (SELECT *, upto <= extra AND extra > 0 AS first FROM running),
gaps AS (SELECT source, any_value(extra) - coalesce(max(upto) FILTER (first), 0) AS gap FROM prefix GROUP BY source),
closing AS (SELECT doc_id FROM (SELECT p.doc_id, row_number() OVER (PARTITION BY p.source
    ORDER BY abs(size - gap), odds, draw, p.doc_id, size) AS n
  FROM prefix p JOIN gaps g ON p.source IS NOT DISTINCT FROM g.source WHERE NOT first AND abs(size - gap) < gap) WHERE n = 1)
SELECT doc_id, size, source, source_size, target, certain + (first OR c.doc_id IS NOT NULL)::BIGINT AS copies,
  size * (certain + (first OR c.doc_id IS NOT NULL)::BIGINT) AS taken
FROM prefix LEFT JOIN closing c USING (doc_id)"""


@add("op6_source_mixing", MIXING_SQL)
def op6_source_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@add("op7_simhash")
def op7_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@add("op8_permutation_index")
def op8_permutation_index(spark, folder):
    return ann.nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@add("op9_language")
def op9_language(spark, folder):
    found = language.identify(table(spark, folder, "documents"), language.remainder("doc_id", 4) != 2)
    held_out = F.coalesce(language.remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@add("op10_lm_scoring")
def op10_lm_scoring(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    remainder = language.remainder("doc_id", 7)
    found = lm_scoring.score_texts(table(spark, folder, "documents"), remainder != 2, path, public_tokenizers.PATTERN)
    held_out = F.coalesce(remainder == 2, F.lit(False))
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@add("op11_sentencepiece")
def op11_sentencepiece(spark, folder):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = piece_bpe.encode(table(spark, folder, "documents"), path, decode=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


FILTER_AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic, [len(ws) < 100,
    100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails
  FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
walked AS (SELECT *, coalesce(list_min([i FOR i IN range(1, 6) IF fails[ascii(substr(o, i, 1)) - 64]]), 6) AS gone
  FROM cells, orders),
steps AS (SELECT *, ascii(substr(o, step, 1)) - 64 AS f FROM walked, (SELECT unnest(range(1, 6)) AS step)),
report AS (SELECT part, o AS filter_order, step::INT AS step, any_value(f) AS f,
    coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails[f] AND gone < step), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails[f] AND len([x FOR x IN fails IF x]) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost FROM steps GROUP BY part, o, step)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM report"""


@add("op12_filter_audit", FILTER_AUDIT_SQL)
def op12_filter_audit(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Trees as lists of nodes by level; a document's path is folded level by level. DuckDB has no crc32: it is a fold too.
MERKLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, source, n_chars, text, coalesce((xor(list_reduce(
    [4294967295] || flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)) % 3 = 0, false) AS hit FROM documents),
e AS (SELECT doc_id, lang, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head, text,
    CASE WHEN hit THEN {SQL_LOWER.format("text")} ELSE text END AS told FROM d),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(octet_length(encode(told)) || ':' || told, '-')) AS claimed FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
towers AS (SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1,
    [sha256(array_to_string(list_slice(nodes, 8 * i + 1, 8 * i + 8), '')) FOR i IN range(0, (len(nodes) + 7) // 8)]
  FROM towers WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS number
  FROM towers WHERE len(nodes) = 1),
crown AS (SELECT 0 AS level, list(subroot ORDER BY number) AS nodes FROM subroots
  UNION ALL SELECT level + 1,
    [sha256(array_to_string(list_slice(nodes, 8 * i + 1, 8 * i + 8), '')) FOR i IN range(0, (len(nodes) + 7) // 8)]
  FROM crown WHERE len(nodes) > 1),
levels AS (SELECT t.lang, level, nodes, depth, number FROM towers t JOIN subroots s ON t.lang IS NOT DISTINCT FROM s.lang
    WHERE len(nodes) > 1
  UNION ALL SELECT lang, depth + level, nodes, depth, number FROM subroots, crown WHERE len(nodes) > 1),
path AS (SELECT doc_id, p.lang, leaf, idx, level, array_to_string(list_slice(nodes, run + 1, place), '') AS l,
    array_to_string(list_slice(nodes, place + 2, run + 8), '') AS r
  FROM (SELECT p.*, level, nodes, place, place - place % 8 AS run FROM (SELECT p.*, level, nodes,
      CASE WHEN level < depth THEN idx // (8 ** level)::BIGINT ELSE number // (8 ** (level - depth))::BIGINT END AS place
    FROM placed p JOIN levels v ON p.lang IS NOT DISTINCT FROM v.lang) p) p),
paths AS (SELECT lang, idx, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM path GROUP BY lang, idx),
folds AS (SELECT p.*, coalesce(ls, []) AS ls, coalesce(rs, []) AS rs FROM placed p
  LEFT JOIN paths q ON p.lang IS NOT DISTINCT FROM q.lang AND p.idx = q.idx),
folded AS (SELECT lang, idx, 1 AS k, claimed AS h, ls, rs FROM folds
  UNION ALL SELECT lang, idx, k + 1, sha256(ls[k] || h || rs[k]), ls, rs FROM folded WHERE k <= len(ls)),
roots AS (SELECT nodes[1] AS root FROM crown WHERE len(nodes) = 1)
SELECT f.doc_id, f.leaf, subroot, root, sha256(array_to_string([f.ls[i] || f.rs[i] FOR i IN range(1, len(f.ls) + 1)], ''))
  AS proof_sha256, h AS folded_root, h = root AS verified
FROM folds f JOIN folded g ON f.lang IS NOT DISTINCT FROM g.lang AND f.idx = g.idx AND g.k = len(f.ls) + 1
JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang CROSS JOIN roots"""


@add("op13_merkle", MERKLE_SQL)
def op13_merkle(spark, folder):
    docs = table(spark, folder, "documents")
    found = merkle.manifest(docs, merkle.lowered_for_a_third(F.col("doc_id"), F.col("text")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
