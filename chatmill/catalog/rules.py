"""Constraint rules as rows, over document texts dressed up so that the rules meet both outcomes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query
from chatmill.functions import constraints as K
from chatmill.plans.tables import documents

# around every document's text, by doc_id modulo their number; each keeps the text. {t} is the text, {i} the document's number
DRESS = [
    "<<A title>>\n{t}\nP.S. the end",
    "* one\n* two\n- three\n{t}",
    '"{t}"',
    "{t} ****** {t}",
    "{t}\nMy answer is yes. Section 1",
    "{t} *** second [a] [b] *bold* **strong** now",
    "{t}******other",
    '{{"a": "{t}"}}',
    "Say *{t}* now",
    "Twice******{t}",
    "[{i}] [{t}]",
    "{t} * * * two THREE FOUR",
    "Now zero {t} or now",
    "{t} the fact.",
    "<<{t}>> <<c d>>",
]
SAMPLE = '{"a": 7}'

_TOKEN = r"[\p{L}\p{M}\p{N}_]+"
_PUNCT = rf"[^\p{{L}}\p{{M}}\p{{N}}_{S.WS}]"
_FULL = f"regexp_matches(p, '[^{S.WS}]')"


def _sentences(c: str) -> str:
    cut = f"string_split(regexp_replace(replace({c}, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda p: {S.strip('p')}), lambda p: p <> '')"


def _tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{_TOKEN}(?:[-'']{_TOKEN})*|{_PUNCT}')"


def _parts(pieces: str, check: str) -> str:
    """``check`` on the non-blank pieces ``q``; false when an inner piece is blank."""
    inner = f"len(list_filter({pieces}[2:len({pieces}) - 1], lambda p: NOT {_FULL})) = 0"
    return f"{inner} AND ({check.replace('@', f'list_filter({pieces}, lambda p: {_FULL})')})"


def _count(pattern: str, c: str = "t") -> str:
    return f"len(regexp_extract_all({c}, {S.q(pattern)}))"


def _bare(c: str) -> str:
    return f"lower(regexp_replace({c}, '{_PUNCT}', '', 'g'))"


def _n_word(w: str) -> str:
    return f"len(list_filter(low_words, lambda x: x = {S.q(w)}))"


_STARS = r"string_split_regex(t, '\s?\*\*\*\s?')"
_TWO = "string_split(t, '******')"
_JSON = rf"json_valid({S.strip(chr(114) + 'egexp_replace(regexp_replace(' + S.strip('t') + r", '\A```(?:json|Json|JSON)?', ''), '```\z', '')")})"

RULES = [
    ("length_constraints:number_sentences", {"num_sentences": 5, "relation": "at least"}, "len(sents) >= 5"),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, _parts(_STARS, "len(@) = 2")),
    ("paragraphs:paragraphs", {}, _parts(_STARS, "len(@) = 2")),
    ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 1, "nth_paragraph": 1, "first_word": "the"},
     f"len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: {_FULL})) = 1 AND regexp_extract(lower({S.words('string_split(t, chr(10) || chr(10))[1]')}[1]), '^''*\"*([^.,?!''\"]*)', 1) = 'the'"),
    ("detectable_content:number_placeholders", {"num_placeholders": 2}, _count(r"\[.*?\]") + " >= 2"),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}, r"regexp_matches(lower(t), 'p\.\s?s\.')"),
    ("detectable_format:number_bullet_lists", {"num_bullets": 3}, _count(r"(?m)^\s*\*[^*].*$") + " + " + _count(r"(?m)^\s*-.*$") + " = 3"),
    ("detectable_format:constrained_response", {}, "contains(t, 'My answer is yes.') OR contains(t, 'My answer is no.') OR contains(t, 'My answer is maybe.')"),
    ("multi-turn:constrained_start", {"starter": "The"}, r"regexp_matches(t, '(?m)^\s*The.*$')"),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2},
     " + ".join(f"len(list_filter(regexp_extract_all(t, '{p}', 1), lambda p: {_FULL}))" for p in (r"\*([^\n*]*)\*", r"\*\*([^\n*]*)\*\*")) + " >= 2"),
    ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 1}, r"regexp_matches(t, '\s?Section\s?\d+\s?')"),
    ("detectable_format:rephrase", {"original_message": "Say *it* now"}, r"regexp_matches(t, '\*.*\*') AND regexp_replace(t, '\*.*\*', '', 'g') = 'Say  now'"),
    ("detectable_format:json_format", {}, _JSON),
    ("detectable_format:title", {}, rf"len(list_filter(regexp_extract_all(t, '<<[^\n]+>>'), lambda p: {_FULL.replace('(p', chr(40) + 'regexp_replace(p, ' + chr(39) + r'\A<+|>+\z' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')', 1)})) > 0"),
    ("keywords:word_count_different_numbers", {"keyword": "er", "frequency": 40, "relation": "at least"}, _count("(?i)er") + " >= 40"),
    ("keywords:word_once", {"keyword": "now"}, _count("(?i)now") + " = 1"),
    ("count:count_increment_word", {"keyword1": "zero", "keyword2": "now"}, _count("(?i)zero") + " = 1 AND " + _count("(?i)now") + " = 2"),
    ("keywords:key_sentences", {"key_sentences": ["My answer is yes."], "num_sentences": 1}, "list_contains(sents, 'My answer is yes.')"),
    ("keywords:forbidden_words", {"forbidden_words": ["the", "und"]}, f"{_n_word('the')} + {_n_word('und')} = 0"),
    ("letters:letter_counting2", {"letter": "E", "let_frequency": 200, "let_relation": "less than"}, "length(t) - length(replace(lower(t), 'e', '')) < 200"),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "the of and the", "low": 2, "high": 3},
     f"least({_n_word('the')}, 2) + least({_n_word('of')}, 1) + least({_n_word('and')}, 1) BETWEEN 2 AND 3"),
    ("combination:two_responses", {}, _parts(_TWO, f"len(@) = 2 AND {S.strip(_TWO + '[1]')} <> {S.strip(_TWO + '[2]')}")),
    ("combination:repeat_prompt", {"prompt_to_repeat": " say *"}, f"starts_with(lower({S.strip('t')}), 'say *')"),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, "len(list_filter(toks, lambda w: w = upper(w) AND w <> lower(w) AND NOT contains(w, 'ß'))) >= 2"),
    ("change_case:english_capital", {}, "t = upper(t) AND t <> lower(t) AND NOT contains(t, 'ß')"),
    ("change_case:english_lowercase", {}, "t = lower(t) AND t <> upper(t)"),
    ("punctuation:punctuation_dot", {}, "NOT contains(t, '.')"),
    ("copy:copy", {"prompt_to_repeat": SAMPLE}, f"lower({S.strip('t')}) = '{SAMPLE}'"),
    ("copy:copying_simple", {"prompt_to_repeat": " THE fact."}, f"lower({S.strip('t')}) = 'the fact.'"),
    ("new:copy_span_idx", {"prompt_to_repeat": f"xx{SAMPLE}yy", "n_start": 2, "n_end": 10}, f"lower({S.strip('t')}) = '{SAMPLE}'"),
    ("copy:copying_multiple", {"N": 2, "prompt_to_repeat": "twice"}, f"len({_TWO}) = 2 AND len(list_filter({_TWO}, lambda p: lower({S.strip('p')}) <> 'twice')) = 0"),
    ("detectable_format:sentence_hyphens", {},
     f"len(list_filter(list_zip(string_split(t, '-'), {_sentences(chr(114) + 'eplace(t, ' + S.q('-') + ', ' + S.q(' ') + ')')}), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL AND NOT ({S.strip('z[1]')} = z[1] AND z[1] = z[2]))) = 0"),
    ("keywords:no_adjacent_consecutive", {}, "len(list_filter(range(1, len(ws)), lambda i: ascii(lower(ws[i + 1][1])) - ascii(lower(ws[i][1])) = 1)) = 0"),
    ("detectable_format:square_brackets", {}, "len(list_filter(ws, lambda w: NOT (starts_with(w, '[') AND ends_with(w, ']')))) = 0"),
    ("first_word:first_word_sent", {"first_word": "The"}, f"len(list_filter(sents, lambda s: lower({S.words('s')}[1]) <> 'the')) = 0"),
    ("last_word:last_word_sent", {"last_word": "fact"}, f"len(list_filter(sents, lambda s: {_bare(S.words('s') + '[-1]')} <> 'fact')) = 0"),
    ("last_word:last_word_answer", {"last_word": "now"}, f"{_bare('ws[-1]')} = 'now'"),
    ("detectable_format:bigram_wrapping", {}, "len(list_filter(range(0, len(ws) - 1), lambda i: i % 2 = 0 AND NOT (starts_with(ws[i + 1], '<<') AND ends_with(ws[i + 2], '>>')))) = 0"),
    ("count:count_unique", {}, "len(toks) = len(list_distinct(toks))"),
    ("keywords:keyword_specific_position", {"n": 1, "m": 2, "keyword": "fact"}, f"{_tokens('sents[1]')}[2] = 'fact'"),
    ("keywords:start_end", {}, "len(toks) >= 2 AND lower(toks[1]) = lower(toks[-1])"),
    ("validate_forbidden_words", {"forbidden_words": ["Twice", "ever"]}, "NOT contains(lower(t), 'twice') AND NOT contains(lower(t), 'ever')"),
    ("verify_paragraph_count", {"N": 2}, f"len(string_split(t, '* * *')) = 2 AND len(list_filter(string_split(t, '* * *'), lambda p: NOT {_FULL})) = 0"),
    ("verify_postscript", {"postscript_marker": "P.S."}, f"contains(t, 'P.S.') AND length({S.strip(chr(115) + 'ubstr(t, instr(t, ' + S.q('P.S.') + '))')}) > 4"),
    ("validate_placeholders", {"N": 2}, _count(r"\[(.*?)\]") + " >= 2"),
    ("verify_bullet_points", {"N": 3}, f"len(list_filter(string_split(t, chr(10)), lambda p: regexp_matches({S.strip('p')}, '\\A[*-]'))) = 3"),
    ("validate_title", {}, "regexp_matches(t, '<<(.*?)>>')"),
    ("validate_choice", {"options": [f"x {SAMPLE} y", "no"]}, f"contains('x {SAMPLE} y', t) OR contains('no', t)"),
    ("validate_highlighted_sections", {"N": 2}, _count(r"\*(.*?)\*") + " >= 2"),
    ("validate_sections", {"N": 2, "section_splitter": "Section"}, "len(string_split(t, 'Section')) - starts_with(t, 'Section')::INTEGER = 2"),
    ("validate_json_format", {}, "json_valid(t)"),
    ("validate_repeat_prompt", {"original_prompt": "Say *"}, "starts_with(t, 'Say *')"),
    ("validate_lowercase", {}, "t = lower(t)"),
    ("validate_frequency_capital_words", {"N": 2, "quantifier": "at least"}, f"len(list_filter(regexp_extract_all(t, '{_TOKEN}'), lambda w: regexp_full_match(w, '[A-Z]+'))) >= 2"),
    ("validate_end", {"end_phrase": "now"}, "ends_with(t, 'now')"),
    ("validate_quotation", {}, "starts_with(t, '\"') AND ends_with(t, '\"')"),
]


def _dressed_sql(dress=DRESS) -> str:
    out = []
    for i, d in enumerate(dress):
        text = S.q(d.replace("{{", "{").replace("}}", "}")).replace("{t}", "' || text || '").replace("{i}", "' || doc_id || '")
        out.append(f"WHEN {i} THEN {text}")
    return f"SELECT doc_id, CASE doc_id % {len(dress)} {' '.join(out)} END AS t FROM documents"


def _dressed(dress=DRESS):
    out = None
    for i, d in enumerate(dress):
        text = F.lit(d.replace("{{", "{").replace("}}", "}"))
        text = F.replace(F.replace(text, F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{t}"), F.col("text"))
        at = F.col("doc_id") % len(dress) == i
        out = F.when(at, text) if out is None else out.when(at, text)
    return out


def _units(rows: str, more: str = "") -> str:
    return f"SELECT doc_id, {more}t, {_sentences('t')} AS sents, {S.words('t')} AS ws, {_tokens('t')} AS toks, regexp_extract_all(lower(t), '{_TOKEN}') AS low_words FROM ({rows}) WHERE t IS NOT NULL"


_UNITS = _units(_dressed_sql())
_WHOLE = _units(f"SELECT doc_id, false AS dressed, text AS t FROM documents UNION ALL SELECT doc_id, true AS dressed, t FROM ({_dressed_sql()})", "dressed, ")


def _judged(d, keys: list[str]):
    """Per rule and ``keys``: rows, those that meet the rule, and the sum of their numbers."""
    units = K.units(F.col("t"))
    check = lambda r, a: K.check(F.lit(r), F.col("t"), F.from_json(F.lit(json.dumps(a)), K.ARGS), [r], {k: F.col(k) for k in units})
    checks = [F.struct(F.lit(r).alias("rule"), check(r, a).alias("met")) for r, a, _ in RULES]
    flat = d.withColumns(units).select(*keys, "doc_id", F.explode(F.array(*checks)).alias("c")).select(*keys, "doc_id", "c.*")
    return flat.groupBy("rule", *keys).agg(
        F.count("*").alias("n"), F.count_if("met").alias("n_met"), F.coalesce(F.sum(F.when(F.col("met"), F.col("doc_id"))), F.lit(0).cast("long")).alias("met_ids")
    )


@query(
    "constraint_rules",
    f"WITH u AS MATERIALIZED ({_UNITS}) SELECT rule, count(*) AS n, count(*) FILTER (WHERE met) AS n_met, coalesce(sum(doc_id) FILTER (WHERE met), 0)::BIGINT AS met_ids FROM ("
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, doc_id, coalesce(({sql}), false) AS met FROM u" for r, _, sql in RULES)
    + ") GROUP BY 1",
)
def constraint_rules(spark, sf):
    """2.9.1: the rules that no other query holds, in one pass over the texts; which documents meet a rule shows in the sum of
    their numbers. Every document's whole text is judged, with something around it that makes more rules meet both outcomes."""
    return _judged(documents(spark, sf).select("doc_id", _dressed().alias("t")).filter("t is not null"), [])


@query(
    "constraint_rules_whole",
    f"WITH u AS MATERIALIZED ({_WHOLE}) SELECT rule, dressed, count(*) AS n, count(*) FILTER (WHERE met) AS n_met, coalesce(sum(doc_id) FILTER (WHERE met), 0)::BIGINT AS met_ids FROM ("
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, dressed, doc_id, coalesce(({sql}), false) AS met FROM u" for r, _, sql in RULES)
    + ") GROUP BY 1, 2",
)
def constraint_rules_whole(spark, sf):
    """2.9.1: every document's text as it is by the same rules, and once more with something around it."""
    rows = F.array(F.struct(F.lit(False).alias("dressed"), F.col("text").alias("t")), F.struct(F.lit(True).alias("dressed"), _dressed().alias("t")))
    return _judged(documents(spark, sf).select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*").filter("t is not null"), ["dressed"])
