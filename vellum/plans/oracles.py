"""DuckDB SQL with the same results as the queries of the library's own operators."""

from __future__ import annotations

from vellum.functions import text as X
from vellum.plans import file_queries
from vellum.plans.fixtures import ANNOTATIONS, MODELS, PAIRS, STEPS, sql_text
from vellum.sources.files import REPORT

#: The body of a document, fences, math, illegible marks and regions as patterns.
BODY = r"(?s)\\begin\{document\}(.*?)\\end\{document\}"
FENCE = r"(?s)```(?:latex|tex)?\s*\n?(.*?)```"
ILLEGIBLE = r"(?i)\\text\{.*?illegible.*?\}|\\textit\{.*?illegible.*?\}|\[.*?illegible.*?\]"
MATH = r"(?s)\$[^$]+\$|\\\[[^\\]+\\\]|\\begin\{[^}]+\}.*?\\end\{[^}]+\}"
REGION = r"(?s)<\|det\|>.*?<\|/det\|>"


def _ann(select: str) -> str:
    return f"WITH {ANNOTATIONS} SELECT id, {select} FROM ann"


def _count(c: str, piece: str) -> str:
    return f"((length({c}) - length(replace({c}, {piece}, ''))) // length({piece}))"


def _has(c: str, *pieces: str) -> str:
    return "(" + " OR ".join(f"strpos({c}, {p}) > 0" for p in pieces) + ")"


B = "chr(92)"


def _re(pattern: str) -> str:
    """A pattern as the other engine reads it: classes there are ASCII, as the pages are, and U would mean ungreedy."""
    return "'" + pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("\\A", "^").replace("\\z", "$").replace("'", "''") + "'"


def _sub(c: str, pattern: str, by: str, first: bool = False) -> str:
    return f"regexp_replace({c}, {_re(pattern)}, {_re(by)}{'' if first else ", 'g'"})"


def _strip(c: str) -> str:
    return _sub(c, r"\A\s+|\s+\z", "")


def _rstrip(c: str) -> str:
    return _sub(c, r"\s+\z", "", True)


def _or_all(c: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {_re(pattern)}) THEN regexp_extract({c}, {_re(pattern)}, 1) ELSE {c} END"


_BODY = _or_all("latex", BODY)
_THINK = "list_extract(string_split_regex(regexp_replace({c}, '(?is)<think>.*?</think>', '', 'g'), '(?i)<think>'), -1)"


def _canon(c: str) -> str:
    c = _or_all(c, BODY)
    for pattern, by in (*X.CANONICAL, (r"\s+", "")):
        c = _sub(c, pattern, by)
    return c


def _dollars(c: str) -> str:
    return f"(length(replace({c}, {B} || '$', '')) - length(replace(replace({c}, {B} || '$', ''), '$', ''))) % 2 <> 0"


def _brackets(c: str, variant: int) -> str:
    plain = c if variant == 1 else f"replace({c}, {B} || {B}, '')"
    return f"{_count(plain, B + " || '['")} <> {_count(plain, B + " || ']'")}"


def _envs(c: str) -> str:
    return f"{_count(c, B + " || 'begin{'")} <> {_count(c, B + " || 'end{'")}"


def _last(c: str) -> str:
    return f"trim(regexp_extract({_rstrip(c)}, '[^\n]*$'))"


def _truncated(variant: int, c: str = "body") -> str:
    """Whether a body breaks off."""
    return f"({_rstrip(c)} = '' OR regexp_matches({_last(c)}, {_re(X.DANGLING)}) OR {_dollars(c)} OR {_brackets(c, variant)} OR {_envs(c)})"


def _structure(c: str) -> str:
    equal = (("{", "}"), ("\\begin", "\\end"))
    return f"strpos({c}, {B} || 'documentclass') > 0 AND strpos({c}, {B} || 'end{{document}}') > 0 AND " + " AND ".join(f"{_count(c, sql_text(x))} = {_count(c, sql_text(y))}" for x, y in equal)


_LONE = r"\A```[a-zA-Z]*\n?", r"\n?```\z"


def _no_lone_fence(c: str) -> str:
    return _strip(_sub(_sub(c, _LONE[0], "", True), _LONE[1], "", True))


def _steps(start: str, *steps: str, column: str = "c") -> str:
    """Tables a0, a1, ...: each step is an expression over the column of the one before."""
    return ", ".join(f"a{i} AS (SELECT * REPLACE ({x} AS {column}) FROM {f'a{i - 1}' if i else start})" for i, x in enumerate(steps))


def _circled() -> str:
    c = "c"
    for i in range(20):
        c = f"replace({c}, '{chr(0x2460 + i)}', '({i + 1})')"
    return f"replace({c}, '\u2212', '-')"


_PREAMBLE = f"split_part(c, {sql_text(chr(92) + 'begin{document}')}, 1)"
_MISSING = "concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN {test}strpos({_PREAMBLE}, '{{{p}}}') = 0 THEN {sql_text(chr(92) + f'usepackage{{{p}}}')} END"
    for p, test in (*((p, "") for p in X.REQUIRED_PACKAGES), *((p, _has("c", *map(sql_text, t)) + " AND ") for p, t in X.TRIGGERED_PACKAGES.items()))
) + ")"
_CLASS_LINE = r"(?s)^(.*?\\documentclass[^\n]*)"
_LAST_PACKAGE = r"(?s)^(.*\\usepackage(?:\[[^\]]*\])?\{[^}]*\})"
_BEGIN, _END = sql_text(chr(92) + "begin{document}"), sql_text(chr(92) + "end{document}")
#: Tables up to a9, whose column c is the repaired page.
_FIXED = f"WITH {ANNOTATIONS}, s AS (SELECT id, latex, {_strip('latex')} AS c FROM ann), " + _steps(
    "s",
    f"CASE WHEN starts_with(c, '```') THEN {_no_lone_fence('c')} ELSE c END",
    _strip(f"replace(c, '{X.REVIEWED}', '')"),
    _sub(_sub("c", r"\\require\{[^}]*\}", ""), r"\\textcircled\{([^}]*)\}", r"(\1)"),
    _circled(),
    f"CASE WHEN strpos(c, {sql_text(chr(92) + 'documentclass')}) > 0 THEN c ELSE {sql_text(chr(92) + 'documentclass{article}' + chr(10))} || c END",
    f"CASE WHEN {_MISSING} = '' THEN c ELSE regexp_extract({_sub('c', r'\n\z', '', True)}, '{_CLASS_LINE}', 1) || chr(10) || {_MISSING} || regexp_extract({_sub('c', r'\n\z', '', True)}, '{_CLASS_LINE}(.*)$', 2) END",
    f"CASE WHEN strpos(c, {_BEGIN}) > 0 THEN c WHEN regexp_matches(c, '{_LAST_PACKAGE}') THEN regexp_extract(c, '{_LAST_PACKAGE}', 1) || chr(10) || chr(10) || {_BEGIN} || chr(10) || substr(c, length(regexp_extract(c, '{_LAST_PACKAGE}', 1)) + 1) ELSE c || chr(10) || {_BEGIN} || chr(10) END",
    f"CASE WHEN strpos(c, {_END}) > 0 THEN c ELSE {_rstrip('c')} || chr(10) || chr(10) || {_END} || chr(10) END",
)
_STATUS = f"{_FIXED}, j AS (SELECT id, latex, c, {_BODY} AS body, {_or_all('c', BODY)} AS fixed FROM a7), v AS (SELECT id, CASE WHEN {_truncated(2)} THEN 'TRUNCATED' WHEN {_structure('latex')} THEN 'PASS' WHEN {_structure('c')} AND NOT {_truncated(2, 'fixed')} THEN 'FIXED' ELSE 'FAIL' END AS status FROM j)"
_CLEANED = f"WITH {ANNOTATIONS}, s AS (SELECT id, {_strip(_THINK.format(c='latex'))} AS c FROM ann), " + _steps(
    "s",
    f"CASE WHEN regexp_matches(c, {_re(FENCE)}) THEN {_strip(f'regexp_extract(c, {_re(FENCE)}, 1)')} WHEN starts_with(c, '```') THEN {_no_lone_fence('c')} ELSE c END",
    f"CASE WHEN strpos(c, {sql_text(chr(92) + 'documentclass')}) = 0 THEN c WHEN strpos(reverse(c), reverse({_END})) > 0 THEN substr(c, strpos(c, {sql_text(chr(92) + 'documentclass')}), greatest(length(c) - strpos(reverse(c), reverse({_END})) + 2 - strpos(c, {sql_text(chr(92) + 'documentclass')}), 0)) ELSE substr(c, strpos(c, {sql_text(chr(92) + 'documentclass')})) END",
    _strip("c"),
)


def _no_tokens(c: str) -> str:
    return _sub(_sub(_sub(c, REGION, ""), X.SPECIAL, ""), X.PLACEHOLDER, "")


def _no_furniture(c: str) -> str:
    lines = f"string_split({_sub(c, r'\n\z', '', True)}, chr(10))"
    return f"array_to_string(list_filter({lines}, lambda l: NOT regexp_matches({_strip('l')}, {_re(X.FURNITURE)})), chr(10))"


def _wrapped(c: str) -> str:
    return f"{sql_text(X.PREAMBLE)} || {_strip(c)} || {sql_text(X.POSTAMBLE)}"


_DROPPED = ", ".join(f"'{r}'" for r in X.DROPPED_REGIONS)
_REGIONS = f"""WITH {ANNOTATIONS}, s AS (SELECT id, {_strip('latex')} AS c FROM ann),
p AS (SELECT id, c, list_transform(regexp_extract_all(c, {_re(X.DET)}, 1), lambda k: lower(k)) AS k, string_split_regex(c, {_re(X.DET)})[2:] AS t FROM s),
q AS (SELECT id, CASE WHEN len(k) = 0 THEN {_no_furniture(_no_tokens('c'))} ELSE array_to_string(list_filter(list_transform(list_filter(list_zip(k, t), lambda z: z[1] NOT IN ({_DROPPED})), lambda z: {_strip(_no_furniture(_no_tokens('z[2]')))}), lambda x: x <> ''), chr(10) || chr(10)) END AS b FROM p)"""
_UNMARKED = f"WITH {ANNOTATIONS}, s AS (SELECT id, {_strip(_sub(_sub(_strip('latex'), REGION, ''), X.SPECIAL, ''))} AS c FROM ann)"
_TOKENS = f"regexp_extract_all(latex, {_re(X.TOKEN)})[1:{X.MAX_TOKENS}]"


_WITH_BODY = f"WITH {ANNOTATIONS}, b AS (SELECT id, latex, {_BODY} AS body FROM ann)"
_REFUSED = _has("lower(latex)", "'please provide the image'", "'please attach'", "'no handwritten content provided'", "'i cannot see'", "'no image'", "'unable to process'")
_FLAGS = rf"""list_filter([
  CASE WHEN length(latex) < 300 THEN 'too_short' END, CASE WHEN length(latex) > 15000 THEN 'too_long' END,
  CASE WHEN body <> latex AND NOT regexp_matches(body, {_re(MATH)}) THEN 'no_math_detected' END,
  CASE WHEN {_dollars('latex')} THEN 'unbalanced_dollars' END,
  CASE WHEN {_count('latex', B + " || 'begin{'")} <> {_count('latex', B + " || 'end{'")} THEN 'unbalanced_environments' END,
  CASE WHEN regexp_matches(latex, {_re(ILLEGIBLE)}) THEN 'contains_illegible_marker' END,
  CASE WHEN strpos(lower(latex), '<think>') > 0 THEN 'contains_think_block' END], lambda x: x IS NOT NULL)"""
_SCORES = """s AS (SELECT l_returnflag AS model, l_linenumber AS ln, (l_orderkey * 31 + l_linenumber * 17) % 1000 AS n FROM lineitem),
r AS (SELECT model, n % 1000 / 1000.0::DOUBLE AS cer, n * 3 % 1000 / 1000.0::DOUBLE AS ncer, n * 7 % 1000 / 1000.0::DOUBLE AS charsim, n * 9 % 1000 / 1000.0::DOUBLE AS tok_err,
  n * 11 % 1000 / 1000.0::DOUBLE AS bleu, n * 13 % 1000 / 1000.0::DOUBLE AS rouge_l, n * 17 % 1000 / 1000.0::DOUBLE AS math_f1, n * 19 % 1000 / 1000.0::DOUBLE AS chrf,
  n * 21 % 1000 / 1000.0::DOUBLE AS len_rate, n * 23 % 1000 / 1000.0::DOUBLE AS latency_s, n % 3 = 0 AS struct, CASE WHEN ln <> 1 THEN n % 2 = 0 END AS compile_ok FROM s)"""
_NORM = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_GRAMS = f"""WITH {PAIRS}, {MODELS}, t AS (SELECT model, id,
  regexp_extract_all({_NORM.format(c='ref')}, '\\\\[a-zA-Z]+\\*?|\\\\.|[{{}}()\\[\\]^_&+=\\-*/<>|]|[a-zA-Z0-9]+|\\S')[1:1200] AS r,
  regexp_extract_all({_NORM.format(c='hyp')}, '\\\\[a-zA-Z]+\\*?|\\\\.|[{{}}()\\[\\]^_&+=\\-*/<>|]|[a-zA-Z0-9]+|\\S')[1:1200] AS h FROM models)"""



def _shown(c: str, form: str) -> str:
    """A value of the report as text."""
    if form == "time":
        return f"(({c} // 3600) || 'h ' || lpad(({c} % 3600 // 60)::VARCHAR, 2, '0') || 'm')"
    digits = int(form[2])
    value = f"round(round({c}, 4) * {100 if c == 'charsim' else 1}, {digits})" if digits != 1 or c == "charsim" else f"round({c}, 1)"
    return f"coalesce(printf('%.{digits}f', {value}) || '{form[4:].replace('%%', '%')}', 'N/A')"


def _overlaps(most: int, grams: str) -> str:
    """o(model, id, n, o): n-grams that both sides of t hold, each as often as the side that has fewer; grams: of {s}."""
    sides = ", ".join(f"{s}c AS (SELECT model, id, n, g, count(*) AS c FROM (SELECT model, id, n, unnest({grams.format(s=s)}) AS g FROM t CROSS JOIN range(1, {most + 1}) x(n)) GROUP BY ALL)" for s in "rh")
    return f"{sides}, o AS (SELECT model, id, n, sum(least(rc.c, hc.c)) AS o FROM rc JOIN hc USING (model, id, n, g) GROUP BY ALL)"


ORACLES: dict[str, str] = {
    "txt1_normalize": _ann(_NORM.format(c="latex") + " AS normalized"),
    "txt3_canonical": _ann(_canon("latex") + " AS canonical"),
    "txt4_strip_reasoning": _ann(_THINK.format(c="latex") + " AS stripped"),
    "txt7_truncated_v1": f"{_WITH_BODY} SELECT id, {_truncated(1)} AS truncated FROM b",
    "txt8_truncated_v2": f"{_WITH_BODY} SELECT id, {_truncated(2)} AS truncated FROM b",
    "txt14_strip_tokens": _ann(_no_tokens("latex") + " AS kept"),
    "txt15_body": _ann(_BODY + " AS body"),
    "txt16_math": rf"{_WITH_BODY} SELECT id, CASE WHEN body <> latex THEN regexp_matches(body, {_re(MATH)}) END AS has_math FROM b",
    "txt17_illegible": _ann(f"regexp_matches(latex, {_re(ILLEGIBLE)}) AS illegible"),
    "txt19_log_error": f"WITH {ANNOTATIONS}, s AS (SELECT id, regexp_extract(latex || CASE WHEN substr(id, 8, 1) < '5' THEN chr(10) || '! Undefined' || chr(10) || 'more' ELSE '' END, '(?m)^!.*') AS e FROM ann) SELECT id, CASE WHEN e = '' THEN 'Unknown error' ELSE {_strip('e')} END AS error FROM s",
    "txt20_labels": r"""WITH p AS (SELECT page_id, string_split_regex(regexp_replace(regexp_replace(coalesce(url, ''), '[?#].*', '') || CASE page_id % 3 WHEN 0 THEN '/final' WHEN 1 THEN '//' ELSE '' END, '[/\\]+$', ''), '[/\\]') AS n FROM pages)
SELECT page_id, regexp_replace(CASE WHEN n[-1] = 'final' AND len(n) > 1 THEN n[-2] ELSE n[-1] END, '[^A-Za-z0-9._-]', '_', 'g') AS label FROM p""",
    "txt21_content_hash": _ann("md5(latex) AS md5, substr(md5(latex), 1, 8) AS short"),
    "txt22_plain_panel": _ann("substr(translate(replace(latex, '$', ''), '_^', '  '), 1, 2000) AS panel"),
    "fil4_valid_v1": _ann(f"NOT {_REFUSED} AND (length(latex) >= 200 OR {_has('latex', chr(39) + '$' + chr(39), B + ' || ' + chr(39) + '[' + chr(39), B + ' || ' + chr(39) + 'begin{' + chr(39))}) AS valid"),
    "fil5_valid_v2": _ann(f"NOT {_REFUSED} AND strpos(lower(latex), '<think>') = 0 AND strpos(latex, {B} || 'documentclass') > 0 AND strpos(latex, {B} || 'end{{document}}') > 0 AS valid"),
    "fil7_structure": _ann(f"strpos(latex, {B} || 'documentclass') > 0 AND strpos(latex, {B} || 'end{{document}}') > 0 AND {_count('latex', chr(39) + '{' + chr(39))} = {_count('latex', chr(39) + '}' + chr(39))} AND {_count('latex', B + ' || ' + chr(39) + 'begin' + chr(39))} = {_count('latex', B + ' || ' + chr(39) + 'end' + chr(39))} AS ok"),
    "fil8_safe_id": r"WITH p AS (SELECT page_id, string_split(url, '/')[-1] || CASE page_id % 4 WHEN 0 THEN '..' ELSE '' END AS c FROM pages) SELECT page_id, regexp_full_match(c, '[A-Za-z0-9_.\-]+') AND strpos(c, '..') = 0 AS safe FROM p",
    "fil12_unreviewed": f"WITH {ANNOTATIONS} SELECT id, strpos(latex || CASE WHEN substr(id, 8, 1) < '5' THEN chr(10) || '% REVIEWED: OK' ELSE '' END, '{X.REVIEWED}') = 0 AS todo FROM ann",
    "fil6_skip_reason": _ann("CASE WHEN substr(id, 7, 2) = '07' THEN 'excluded' WHEN substr(id, 7, 2) = '11' THEN 'no_image' WHEN trim(latex) = '' THEN 'empty' WHEN length(trim(latex, ' ' || chr(10))) < 200 THEN 'too_short' WHEN " + _has("lower(latex)", "'please provide the image'", "'no handwritten content'", "'please attach'", "'i cannot see'") + " THEN 'refusal' END AS reason"),
    "txt23_assistant": "SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id",
    "txt24_error_class": """WITH m AS (SELECT event_id, lower(['HTTP 429 now', 'Rate limit', '402 pay', 'no credit left', '401', 'Unauthorized', 'timeout'][event_id % 7 + 1] || ' ' || event_type) AS m FROM events)
SELECT event_id, CASE WHEN regexp_matches(m, '429|rate') THEN 'backoff' WHEN regexp_matches(m, '402|insufficient|credit|401|unauthorized') THEN 'fatal' ELSE 'retry' END AS error_class, event_id % 600 IN (429, 500, 502, 503, 504) AS retryable FROM m""",
    "met2_char_metrics": f"""WITH {PAIRS}, {MODELS}, m AS (SELECT model, id, {_NORM.format(c='ref')} AS r, {_NORM.format(c='hyp')} AS h, {_canon('ref')} AS rc, {_canon('hyp')} AS hc FROM models)
SELECT model, id, round(levenshtein(r, h)::DOUBLE / greatest(1, length(r)), 4) AS cer, round(levenshtein(rc, hc)::DOUBLE / greatest(1, length(rc)), 4) AS ncer,
  round(greatest(0, 1 - levenshtein(r, h)::DOUBLE / greatest(1, length(r))), 4) AS charsim, r = h AS exact, round(length(h)::DOUBLE / greatest(1, length(r)), 3) AS len_rate,
  round(CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0 ELSE 1 END ELSE levenshtein(r, h)::DOUBLE / length(r) END, 4) AS cer_v3 FROM m""",
    "met10_bag_f1": f"""{_GRAMS}, rc AS (SELECT model, id, g, count(*) AS n FROM (SELECT model, id, unnest(r) AS g FROM t) GROUP BY ALL), hc AS (SELECT model, id, g, count(*) AS n FROM (SELECT model, id, unnest(h) AS g FROM t) GROUP BY ALL),
o AS (SELECT model, id, sum(least(rc.n, hc.n)) AS o FROM rc JOIN hc USING (model, id, g) GROUP BY ALL)
SELECT model, id, round(CASE WHEN coalesce(o, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * (o::DOUBLE / len(h)) * (o::DOUBLE / len(r)) / (o::DOUBLE / len(h) + o::DOUBLE / len(r)) END, 4) AS math_f1 FROM t LEFT JOIN o USING (model, id)""",
    "met16_self_consistency": f"""WITH {PAIRS}, {MODELS}, m AS (SELECT model || '_' || id AS id, {_NORM.format(c='ref')} AS a, CASE WHEN id % 10 <> 0 THEN {_NORM.format(c='hyp')} END AS b FROM models WHERE model <> 'd'),
c AS (SELECT id, levenshtein(a, b)::DOUBLE / greatest(1, length(a)) AS c FROM m) SELECT id, CASE WHEN c <= 0.1 THEN 'keep' ELSE 'reject' END AS verdict, round(c, 4) AS cer FROM c""",
    "agg1_summary": f"""WITH {_SCORES} SELECT model, count(*) AS samples, round(avg(cer), 4) AS mean_cer, round(avg(ncer), 4) AS norm_cer, round(avg(charsim), 4) AS charsim, round(avg(tok_err), 4) AS tok_err, round(avg(bleu), 4) AS bleu,
  round(avg(rouge_l), 4) AS rouge_l, round(avg(math_f1), 4) AS math_f1, round(avg(chrf), 4) AS chrf, round(avg(len_rate), 4) AS len_rate, round(median(cer), 4) AS median_cer, round(100.0::DOUBLE * count_if(struct) / count(*), 1) AS struct_pct,
  round(100.0::DOUBLE * count_if(compile_ok) / count(compile_ok), 1) AS compile_rate, round(100.0::DOUBLE * count_if(cer < 0.1) / count(*), 1) AS cer_under_10pct, round(100.0::DOUBLE * count_if(cer < 0.3) / count(*), 1) AS cer_under_30pct, round(avg(latency_s), 2) AS avg_latency_s FROM r GROUP BY model""",
    "agg9_improvement": f"WITH {_SCORES}, m AS (SELECT model, round(avg(cer), 4) AS c FROM r GROUP BY model) SELECT arg_min(model, (c, ascii(model))) AS best_model, round(100 * (max(c) FILTER (model = 'A') - min(c)) / greatest(1e-9, max(c) FILTER (model = 'A')), 1) AS improvement_pct FROM m",
    "agg3_length_stats": "SELECT lang, min(length(text))::INT AS min_len, max(length(text))::INT AS max_len, (sum(length(text)) // count(*))::BIGINT AS avg_len FROM documents GROUP BY lang",
    "agg4_issue_histogram": f"{_WITH_BODY}, f AS (SELECT unnest({_FLAGS}) AS issue FROM b) SELECT issue, count(*) AS n FROM f GROUP BY issue",
    "arr1_quality_flags": f"""{_WITH_BODY}, f AS (SELECT id, {_FLAGS} AS f, min(id) OVER (PARTITION BY md5(latex)) AS first FROM b)
SELECT id, array_to_string(CASE WHEN first <> id THEN list_append(f, 'duplicate_of_' || first) ELSE f END, ',') AS issues, first = id AND len(list_filter(f, lambda x: x <> 'contains_illegible_marker')) = 0 AS passed FROM f""",
    "agg5_verdict_tally": """WITH v AS (SELECT source, lpad(doc_id::VARCHAR, 8, '0') AS id, CASE doc_id % 7 WHEN 0 THEN 'NO' WHEN 1 THEN '?' WHEN 2 THEN 'ERR timeout' ELSE 'YES' END AS v FROM documents)
SELECT source, count_if(v = 'YES')::BIGINT AS n_yes, count_if(v = 'NO')::BIGINT AS n_no, count_if(v = '?' OR starts_with(v, 'ERR'))::BIGINT AS n_err, round(count_if(v = 'NO')::DOUBLE / greatest(1, count_if(v IN ('YES', 'NO'))), 4) AS no_share FROM v GROUP BY source""",
    "agg7_progress": "WITH d AS (SELECT lang, count(*) AS total, count_if(doc_id % 3 = 0)::BIGINT AS done FROM documents GROUP BY lang) SELECT lang, done, total, total - done AS remaining, round(100.0::DOUBLE * done / total, 1) AS pct, (done * 40 // total)::INT AS bar FROM d",
    "agg8_dry_run": "WITH d AS (SELECT doc_id % 5 <> 0 AS ok, doc_id % 40 / 4.0::DOUBLE AS s, n_chars AS c FROM documents) SELECT count_if(ok)::BIGINT AS n_ok, round(avg(s) FILTER (ok), 3) AS avg_seconds, round(avg(c) FILTER (ok), 1) AS avg_chars, round(avg(s) FILTER (ok) * 1000, 1) AS projected_seconds FROM d",
    "win4_split": "SELECT doc_id, CASE WHEN rn <= n * 9 // 10 THEN 'train' WHEN rn <= n * 9 // 10 + n * 5 // 100 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)",
    "agg10_split_sizes": "WITH s AS (SELECT doc_id, CASE WHEN rn <= n * 9 // 10 THEN 'train' WHEN rn <= n * 9 // 10 + n * 5 // 100 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)) SELECT split, count(*) AS n, count_if(doc_id % 3 = 0)::BIGINT AS n_blanked FROM s GROUP BY split",
    "agg11_char_counts": "SELECT sum(length(text))::BIGINT AS chars, count_if(trim(text) = '')::BIGINT AS n_blank, count_if(trim(text) <> '')::BIGINT AS n_filled, count_if(doc_id % 9 = 0)::BIGINT AS n_held_out, count_if(doc_id % 9 = 0 AND trim(text) = '')::BIGINT AS n_held_out_blank FROM documents",
    "agg13_funnel": "WITH c AS (SELECT 0 AS ord, 'all' AS stage, count(*) AS n FROM documents UNION ALL SELECT 1, 'long', count(*) FROM documents WHERE n_chars >= 200 UNION ALL SELECT 2, 'english', count(*) FROM documents WHERE n_chars >= 200 AND lang = 'en') SELECT ord, stage, n, round(100.0::DOUBLE * n / (SELECT n FROM c WHERE ord = 0), 1) AS pct FROM c",
    "agg14_mean_loss": "SELECT round(avg(value) FILTER (event_id % 10 <> 0), 6) AS val_loss, count(value) FILTER (event_id % 10 <> 0) AS n FROM events",
    "win1_duplicate_of": "SELECT doc_id AS id, CASE WHEN f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents)",
    "fil1_size_router": "SELECT doc_id, CASE WHEN octet_length(encode(text)) < 2048 THEN 'blank' ELSE 'content' END AS bucket FROM documents",
    "fil9_freshness": "SELECT event_id, epoch_us(m) - epoch_us(ts) < 86400000000 AS fresh, epoch_us(ts) >= epoch_us(m) - 5000000 AS since FROM events, (SELECT max(ts) AS m FROM events)",
    "fil10_completeness": "SELECT doc_id, doc_id % 4 > 0 AND (doc_id % 3 = 0 OR doc_id % 2 = 0) AS complete, octet_length(encode(text)) >= 50 AS done FROM documents",
    "fil14_first_n": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50",
    "fil15_seeded_sample": "SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 20",
    "fil17_prefilter": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE md5(text) END AS output, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars / 100.0::DOUBLE END AS latency_s FROM documents",
    "fil18_uploads": "SELECT 'upload_' || event_id AS name FROM events WHERE event_id % 3 = 0",
    "joi1_pending": "SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0",
    "joi2_pending_two": "SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 <> 0",
    "joi3_with_partner": "SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "joi4_minus_excluded": "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "joi5_blank_members": "SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN '' ELSE text END AS answer FROM documents",
    "joi6_lookup": "SELECT d.doc_id AS id, coalesce(quality::VARCHAR, '?') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "joi7_score_pairs": f"WITH {PAIRS} SELECT id, length(ref)::INT AS n_ref, length(hyp)::INT AS n_hyp FROM pairs WHERE id % 3 > 0",
    "joi8_missing": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "joi9_page_by_model": f"WITH {PAIRS}, {MODELS} SELECT id, " + ", ".join(f"max(md5(hyp)) FILTER (model = '{m}') AS {m}_tex, max(coalesce(compile_ok, false)) FILTER (model = '{m}') AS {m}_pdf, max(latency_s) FILTER (model = '{m}')::DOUBLE AS {m}_latency_s" for m in "abcd") + " FROM models GROUP BY id",
    "joi10_resume": """WITH m(ord, stage, missing) AS (SELECT 0, 'crop', 0::BIGINT UNION ALL SELECT 1, 'filter', 0 UNION ALL SELECT 2, 'deskew', count(*) FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 10 >= 7
  UNION ALL SELECT 3, 'convert', count(*) FROM documents WHERE doc_id % 5 <> 0)
SELECT ord, stage, missing, coalesce(ord = (SELECT min(ord) FROM m WHERE missing > 0), false) AS resume FROM m""",
    "joi11_all_ids": "SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels",
    "joi13_requeue": f"{_WITH_BODY} SELECT id, CASE WHEN NOT {_truncated(2)} THEN 'rescued' WHEN substr(id, 8, 1) < '6' THEN 'requeue' ELSE 'missing' END AS status FROM b WHERE {_truncated(1)}",
    "joi14_split_leaks": "SELECT doc_id AS id, 2::BIGINT AS n_splits, CASE WHEN doc_id % 14 = 0 THEN 2 ELSE 1 END::BIGINT AS dup FROM documents WHERE doc_id % 7 = 0",
    "ups1_last_wins": "SELECT user_id AS id, max(event_id) AS pos, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "ups2_replace_by_spec": "SELECT o_orderstatus AS spec, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 3 = 0",
    "ups3_insert_or_refresh": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM orders",
    "snk8_merge_progress": "SELECT doc_id, doc_id + 1 AS done, n_chars AS total, 0::BIGINT AS failed FROM documents",
    "win2_manifest_ids": "WITH s AS (SELECT s_name AS name, s_suppkey AS num FROM supplier), t AS (SELECT max(num) AS m FROM s WHERE num % 2 = 0), r AS (SELECT name, row_number() OVER (ORDER BY name) + m AS num FROM s, t WHERE s.num % 2 <> 0) SELECT name, num::BIGINT AS num, 'page_' || lpad(num::VARCHAR, 5, '0') AS id FROM r",
    "win6_running": f"""WITH {STEPS}, w AS (SELECT user_id, step, (us - lag(us) OVER o) / 1e6 AS s, min(loss) OVER o AS best, avg(loss) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, avg(loss) OVER (o ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS b, avg(loss) OVER (o ROWS UNBOUNDED PRECEDING) * (1000 - step) AS eta FROM steps WINDOW o AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, step, round(s, 3) AS seconds, best, CASE WHEN step >= 6 THEN CASE WHEN a < b THEN 'down' WHEN a > b THEN 'up' ELSE 'flat' END END AS trend, round(eta, 6) AS eta FROM w""",
    "win9_bounded_history": f"WITH {STEPS} SELECT user_id, step, loss FROM steps QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) <= 5",
    "win11_progress": "WITH d AS (SELECT o_orderkey, o_orderkey % 100 AS p, o_orderkey % 7 AS b, (o_orderkey % 11)::DOUBLE AS e FROM orders), r AS (SELECT *, CASE WHEN e > 0 AND p > b THEN (p - b) / e END AS rate FROM d) SELECT o_orderkey, round(rate, 2) AS items_per_sec, round((200 - p) / rate, 0) AS eta_seconds, round(100.0::DOUBLE * p / 200, 1) AS pct FROM r",
    "win12_batches": "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, rn, (rn - 1) // 4 AS batch, (rn - 1) % 3 AS key, 'page_' || lpad(rn::VARCHAR, 5, '0') AS page FROM n",
    "win16_backoff": "SELECT event_id, i AS step, least(60 * pow(2.0::DOUBLE, least(i, 4) - 1), 300) AS wait, pow(2.0::DOUBLE, i) + 1 AS http_wait, chr((96 + i)::INT) AS letter FROM (SELECT event_id, event_id % 8 + 1 AS i FROM events)",
    "arr4_finite": "WITH v AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS v FROM events) SELECT event_id, CASE WHEN isfinite(v) THEN v END AS value FROM v",
    "arr5_key_list": "WITH k AS (SELECT doc_id, list_filter(list_transform(string_split(text || ', ,' || source, ','), lambda x: trim(x)), lambda x: x <> '') AS k FROM documents) SELECT doc_id, array_to_string(k[1:3], '|') AS keys, len(k)::INT AS n FROM k",
    "img5_sizes": """WITH p AS (SELECT p_partkey, (p_partkey * 37 % 3000 + 1)::INT AS h, (p_partkey * 53 % 2500 + 1)::INT AS w FROM part), q AS (SELECT *, greatest(h, w) AS big, sqrt(1204224.0::DOUBLE / (h::DOUBLE * w)) AS k, abs(sin(radians(3.0::DOUBLE))) AS s, abs(cos(radians(3.0::DOUBLE))) AS c FROM p)
SELECT p_partkey, CASE WHEN big <= 2048 THEN h ELSE floor(h * 2048.0::DOUBLE / big) END::INT AS side_h, CASE WHEN big <= 2048 THEN w ELSE floor(w * 2048.0::DOUBLE / big) END::INT AS side_w,
  CASE WHEN h * w <= 1204224 THEN h ELSE greatest(1, round_even(h * k, 0)) END::INT AS budget_h, CASE WHEN h * w <= 1204224 THEN w ELSE greatest(1, round_even(w * k, 0)) END::INT AS budget_w, floor(h * c + w * s)::INT AS rot_h, floor(h * s + w * c)::INT AS rot_w FROM q""",
    "src9_file_totals": "SELECT count(*) AS n_files, round(sum(n_chars) / 1048576.0::DOUBLE, 1) AS size_mb FROM documents",
    "src10_inventory": "SELECT source AS folder, count_if(doc_id % 4 = 0)::BIGINT AS images, count_if(doc_id % 4 = 1)::BIGINT AS tex, count_if(doc_id % 4 = 2)::BIGINT AS json, count(*) AS total FROM documents GROUP BY source",
    "src12_latest_checkpoint": "SELECT 'checkpoint-' || max(o_orderkey) FILTER (o_orderkey % 3 = 0 AND 520000 + o_orderkey % 10000 >= 524288) AS name FROM orders",
    "src13_newest": "SELECT arg_max(event_type, (ts, event_type)) AS path FROM events",
    "src14_log_tail": "SELECT event_id AS line, event_type FROM events ORDER BY event_id DESC LIMIT 20",
    "src15_log_after": "SELECT event_id AS id, event_type FROM events WHERE event_id > 900",
    "src17_data_url": "SELECT doc_id, 'data:image/jpeg;base64,' || to_base64(encode(text)) AS url FROM documents",
    "snk2_json_report": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""",
    "str5_resume_plan": "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'generate' WHEN doc_id % 3 = 0 OR doc_id % 2 <> 0 THEN 'metrics' ELSE 'done' END AS need FROM documents",
    "str6_changes": "SELECT user_id, event_type AS state, event_id AS ord FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type",
    "str8_liveness": "SELECT user_id AS source, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) < 3600000000 AS alive FROM events GROUP BY user_id",
    "str9_idle_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "txt2_tokenize": _ann(f"array_to_string({_TOKENS}, chr(31)) AS tokens, len({_TOKENS})::BIGINT AS n_tokens"),
    "txt5_clean_response": f"{_CLEANED} SELECT id, c AS cleaned FROM a2",
    "txt6_clean_response_v1": _ann(_strip(_sub(_sub(_strip("latex"), r"\A```(?:latex|tex)?", "", True), r"```\z", "", True)) + " AS cleaned"),
    "txt9_truncation_reason": f"{_WITH_BODY} SELECT id, CASE WHEN NOT {_truncated(1)} THEN 'compile_fail' WHEN {_dollars('body')} THEN 'unbalanced_dollars' WHEN {_brackets('body', 1)} THEN 'unbalanced_brackets' WHEN {_envs('body')} THEN 'unbalanced_envs' WHEN regexp_matches({_last('body')}, '\\\\\\\\\\s*$') THEN 'ends_with_double_backslash' ELSE 'dangling_operator' END AS reason FROM b",
    "txt10_auto_fix": f"{_FIXED} SELECT id, c AS fixed FROM a7",
    "txt11_to_document": f"{_REGIONS} SELECT id, {_wrapped(_sub(_sub('b', X.HEADING, ''), r'\n{3,}', chr(10) * 2))} AS document FROM q",
    "txt12_finish_document": f"{_UNMARKED} SELECT id, CASE WHEN strpos(c, {sql_text(chr(92) + 'documentclass')}) > 0 AND strpos(c, {_END}) > 0 THEN c ELSE {_wrapped(_sub('c', X.HEADING, ''))} END AS document FROM s",
    "txt13_drop_furniture": _ann(_no_furniture("latex") + " AS kept"),
    "txt18_yes_no": f"WITH {ANNOTATIONS}, s AS (SELECT id, latex || CASE WHEN substr(id, 8, 1) < '5' THEN ' Yes.' ELSE ' nothing' END AS c FROM ann), v AS (SELECT id, regexp_extract(upper({_THINK.format(c='c')}), '\\b(YES|NO)\\b', 1) AS v FROM s) SELECT id, CASE WHEN v = '' THEN '?' ELSE v END AS verdict FROM v",
    "txt26_messages": _ann("""'[{"role":"system","content":"Transcribe."},{"role":"user","content":' || to_json(latex) || '}]' AS request"""),
    "met8_bleu": f"""{_GRAMS}, {_overlaps(4, "list_transform(generate_series(1, len({s}) - n + 1), lambda i: array_to_string({s}[i:i + n - 1], chr(31)))")},
k AS (SELECT t.model, t.id, n, coalesce(o, 0) AS o, greatest(len(h) - n + 1, 0) AS c, CASE WHEN len(h) >= len(r) THEN 1.0::DOUBLE ELSE exp(1 - len(r)::DOUBLE / greatest(1, len(h))) END AS bp, len(r) > 0 AND len(h) > 0 AS filled FROM t CROSS JOIN range(1, 5) x(n) LEFT JOIN o USING (model, id, n))
SELECT model, id, round(CASE WHEN any_value(filled) THEN any_value(bp) * exp(sum(ln((o + 1e-9::DOUBLE) / (c + 1e-9::DOUBLE))) / 4) ELSE 0 END, 4) AS bleu,
  round(CASE WHEN any_value(filled) THEN any_value(bp) * exp(sum(ln((o + 1e-4::DOUBLE) / (greatest(c, 1) + 1e-4::DOUBLE))) / 4) ELSE 0 END, 4) AS bleu_v2 FROM k GROUP BY model, id""",
    "met11_chrf": f"""WITH {PAIRS}, {MODELS}, t AS (SELECT model, id, {_NORM.format(c='ref')} AS r, {_NORM.format(c='hyp')} AS h FROM models), {_overlaps(6, "list_transform(generate_series(1, length({s}) - n + 1), lambda i: substr({s}, i, n))")},
k AS (SELECT t.model, t.id, n, coalesce(o, 0)::DOUBLE AS o, greatest(length(r) - n + 1, 0) AS nr, greatest(length(h) - n + 1, 0) AS nh FROM t CROSS JOIN range(1, 7) x(n) LEFT JOIN o USING (model, id, n)),
f AS (SELECT model, id, coalesce(avg(o / nh) FILTER (nr > 0 AND nh > 0), 0) AS p, coalesce(avg(o / nr) FILTER (nr > 0 AND nh > 0), 0) AS q FROM k GROUP BY model, id)
SELECT model, id, round(CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) ELSE 0 END, 4) AS chrf FROM f""",
    "agg2_status_counts": f"{_STATUS} SELECT status, count(*) AS n FROM v GROUP BY status",
    "orc3_validate": f"{_STATUS} SELECT id, status FROM v",
    "agg6_agreement": f"""WITH {PAIRS}, {MODELS}, m AS (SELECT {_NORM.format(c='ref')} AS a, CASE WHEN id % 10 <> 0 THEN {_NORM.format(c='hyp')} END AS b FROM models WHERE model <> 'd'),
c AS (SELECT levenshtein(a, b)::DOUBLE / greatest(1, length(a)) AS c FROM m) SELECT count_if(coalesce(c <= 0.1, false))::BIGINT AS kept, count_if(NOT coalesce(c <= 0.1, false))::BIGINT AS rejected, median(round(c, 4)) AS median_cer FROM c""",
    "win5_ema": f"""WITH RECURSIVE {STEPS}, e(user_id, step, a, b) AS (SELECT user_id, step, loss, loss FROM steps WHERE step = 1
  UNION ALL SELECT s.user_id, s.step, 0.8::DOUBLE * a + (1 - 0.8::DOUBLE) * loss, 0.85::DOUBLE * b + (1 - 0.85::DOUBLE) * loss FROM e JOIN steps s ON s.user_id = e.user_id AND s.step = e.step + 1)
SELECT user_id, round(arg_max(a, step), 6) AS ema, round(arg_max(b, step), 6) AS ema_slow FROM e GROUP BY user_id""",
    "win10_early_stop": f"""WITH RECURSIVE {STEPS}, e(user_id, step, best, bad) AS (SELECT user_id, step, loss, 0 FROM steps WHERE step = 1
  UNION ALL SELECT s.user_id, s.step, CASE WHEN loss < best - 1e-4::DOUBLE THEN loss ELSE best END, CASE WHEN loss < best - 1e-4::DOUBLE THEN 0 ELSE bad + 1 END FROM e JOIN steps s ON s.user_id = e.user_id AND s.step = e.step + 1 WHERE bad < 3)
SELECT user_id, max(step) FILTER (bad >= 3) AS stop, arg_max(best, step) AS best FROM e GROUP BY user_id""",
    "arr8_state_hash": """SELECT n_nationkey, substr(md5('{"n_name":' || to_json(n_name) || ',"n_regionkey":' || n_regionkey || '}'), 1, 12) AS state FROM nation""",
    "arr11_labels": """WITH d AS (SELECT doc_id, range(1, doc_id % 4 + 2) AS p, range(10, doc_id % 9 + 11) AS t FROM documents)
SELECT doc_id, array_to_string(list_resize(list_concat(list_transform(p, lambda x: -100), list_concat(t[1:greatest(12 - len(p) - 1, 0)], [2])), 12, -100), ',') AS labels, array_to_string(list_resize(list_concat(p, t), 12, 0), ',') AS ids FROM d""",
    "arr12_loss_start": """WITH d AS (SELECT doc_id, list_concat([5, 7], list_concat(CASE WHEN doc_id % 3 > 0 THEN [7, 9] ELSE [9, 9] END, [1, 2])) AS ids FROM documents),
s AS (SELECT doc_id, ids, (len(ids) - list_position(list_reverse(ids), 7) + 1)::INT AS pos FROM d), b AS (SELECT doc_id, ids, pos + CASE WHEN ids[pos + 1] = 9 THEN 1 ELSE 0 END AS start FROM s)
SELECT doc_id, start, array_to_string(list_concat(list_transform(range(start), lambda x: -100), ids[start + 1:]), ',') AS labels FROM b""",
    "snk11_report": f"WITH {_SCORES}, m AS (SELECT model, count(*) AS samples, " + ", ".join(f"avg({c}) AS {n}" for c, n in (("cer", "mean_cer"), ("ncer", "norm_cer"), ("charsim", "charsim"), ("bleu", "bleu"), ("rouge_l", "rouge_l"), ("math_f1", "math_f1"), ("chrf", "chrf"))) + """,
  median(cer) AS median_cer, 100.0::DOUBLE * count_if(struct) / count(*) AS struct_pct, CASE WHEN model <> 'N' THEN 100.0::DOUBLE * count_if(compile_ok) / count(compile_ok) END AS compile_rate,
  100.0::DOUBLE * count_if(cer < 0.1) / count(*) AS cer_under_10pct, 100.0::DOUBLE * count_if(cer < 0.3) / count(*) AS cer_under_30pct, round(avg(latency_s), 2) AS avg_latency_s, floor(round(avg(latency_s), 2) * count(*))::BIGINT AS total_s FROM r GROUP BY model)
""" + " UNION ALL ".join(f"SELECT model, {i} AS ord, '| {g} | {n} | ' || {_shown(c, form)} || ' |' AS line FROM m" for i, (g, n, c, form) in enumerate(REPORT)),
    "met17_compile": _ann(f"strpos(latex, {B} || 'documentclass') > 0 AND (length(latex) - length(replace(latex, '$', ''))) % 2 = 0 AS compile_ok"),
    "agg6_reject_list": f"""WITH {PAIRS}, {MODELS}, m AS (SELECT model || '_' || id AS id, {_NORM.format(c='ref')} AS a, CASE WHEN id % 10 <> 0 THEN {_NORM.format(c='hyp')} END AS b FROM models WHERE model <> 'd'),
c AS (SELECT id, levenshtein(a, b)::DOUBLE / greatest(1, length(a)) AS c FROM m) SELECT id, round(c, 4) AS cer FROM c WHERE NOT coalesce(c <= 0.1, false)""",
    **file_queries.ORACLES,
    "orc4_evaluate": file_queries.ORACLES["orc4_evaluate"].format(pairs=PAIRS, models=MODELS),
    "str4_merged_columns": file_queries.ORACLES["str4_merged_columns"].format(pairs=PAIRS, models=MODELS),
}
