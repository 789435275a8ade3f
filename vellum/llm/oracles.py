"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The ledger: measurements and bits of each row of documents.
_LEDGER = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), spans AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM (
    SELECT r, unnest(s) AS k, generate_subscripts(s, 1) AS i FROM (SELECT r, list_transform(generate_series(1, len(w) - 7), lambda i: md5(array_to_string(w[i:i + 7], ' '))) AS s FROM d))
), repeated AS (
  SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM spans, range(8) g(j) WHERE n > 1 GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line FROM d
), alike AS (
  SELECT r, sum(n - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')) AS n_letters
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN alike USING (r)
), ledger AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 5 THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_letters >= 20 AND 2 * n_upper > n_letters THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM measured
)"""

ORACLES: dict[str, str] = {
    "op4_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT parts.page_id, host, path, rule,
       CASE WHEN fits.verdict IS NOT NULL THEN fits.verdict WHEN host = '' THEN 'block'
            WHEN regexp_matches(host, '(^|[.-])(spam|casino|porn|xxx|viagra|malware)([.-]|$)') OR regexp_matches(path, '/(casino|porn|xxx)/') THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fits USING (page_id)""",
    "op9_source_mix": r"""
WITH alike AS (
  SELECT doc_id, source, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') || coalesce('=' || source, '') || ':' || md5(coalesce(text, '')) AS draw,
         row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS place
  FROM documents
), docs AS (
  SELECT doc_id, source, draw, place, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || draw || ':' || place), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
         / ((length(translate(text, '0123456789#*$%&|<>', '')) + 1)::DOUBLE / (length(text) + 1)::DOUBLE) AS e
  FROM alike
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM docs GROUP BY source
), caps AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap FROM sources
), filled AS (
  SELECT *, (SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS others
  FROM caps WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(rest, cap / weight) AS rest, arg_min(others, cap / weight) AS others FROM filled WHERE NOT (cap * others < rest * weight)
), targets AS (
  SELECT source, source_size, CASE WHEN filled.cap * filled.others < filled.rest * weight THEN cap ELSE coalesce(weight * level.rest / level.others, cap) END AS target
  FROM filled, level
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::BIGINT ELSE 0 END AS epochs FROM targets
), ranked AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
         (sum(size) OVER (PARTITION BY docs.source ORDER BY e, draw, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, size, source_size, target, (size * least(epochs + CASE WHEN upto - size / 2.0 <= budget AND budget > 0 THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM ranked""",
    "op1_substring_dedup": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), starts AS (
  SELECT r, doc_id, unnest(s) AS k, generate_subscripts(s, 1) AS i
  FROM (SELECT r, doc_id, list_transform(generate_series(1, len(w) - 12), lambda i: md5(array_to_string(w[i:i + 12], ' '))) AS s FROM d WHERE doc_id IS NOT NULL)
), gone AS (
  SELECT DISTINCT r, i + j AS i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM starts), range(13) g(j) WHERE first < doc_id
), each AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op7_chat_format": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(t)
), e AS (
  SELECT *, """
    + " + ".join(f"length({c}) + " + " + ".join(f"(length({c}) - length(replace({c}, {x}, ''))) // length({x})" for x in ("'<s>'", "'</s>'", "'[INST]'", "'[/INST]'", "'<|'", "'|>'", "'<<SYS>>'", "'<</SYS>>'", "chr(92)")) for c in ("role", "text"))
    + r""" AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(7 + 3 + 8 + n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_quality_rules": f"{_LEDGER} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 119 = 0 AS kept, fail_bits FROM ledger",
    "op8_ablation": f"""{_LEDGER}, rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 16), ('long_words', 32), ('capitals', 64))
SELECT rule, count_if(fail_bits & bit <> 0)::BIGINT AS failed, count_if(fail_bits & 119 = bit)::BIGINT AS only_this, count_if(fail_bits & 119 IN (0, bit))::BIGINT AS kept_without FROM ledger, rules GROUP BY rule""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 3], ' ')))) END AS s FROM d
), grams AS (
  SELECT r, unnest(s) AS g FROM sets WHERE doc_id IS NOT NULL
), pairs AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM pairs JOIN sets x ON x.r = pairs.a JOIN sets y ON y.r = pairs.b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets LEFT JOIN least ON doc_id = a""",
}
