"""SQL fragments the oracle statements share (DuckDB dialect)."""

from __future__ import annotations

# the same white-space class as chatmill.functions.text.WS, in RE2 syntax
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PUNCT = r"""!-/:-@\[-`{-~"""
SEP = r'[ ,.?!:;()"\-\n\\]+'


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[{WS}]+'), lambda w: w <> '')"


def n_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{WS}]+'))"


def phrase_tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), {q(SEP)}), lambda w: w <> '')"


def normalise(c: str) -> str:
    c = f"regexp_replace(lower({c}), '[{PUNCT}]', '', 'g')"
    # RE2's word boundary is ASCII; look at the neighbours instead
    c = f"regexp_replace({c}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g')"
    c = f"regexp_replace({c}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g')"
    return f"regexp_replace({strip(c)}, '[{WS}]+', ' ', 'g')"


def hash_key(seed, *ids: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(ids)}))"


def hash_int(seed, *ids: str) -> str:
    return f"(('0x' || substr({hash_key(seed, *ids)}, 1, 8))::UBIGINT::BIGINT)"


def hash_unit(seed, *ids: str) -> str:
    return f"({hash_int(seed, *ids)} / 4294967296.0::DOUBLE)"


def chat(content: str = "text") -> str:
    """messages as a list of structs per conversation."""
    return f"SELECT conv_id, list({{'role': role, 'content': {content}}} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id"


def describe(c: str, name: str, cond: str | None = None) -> str:
    f = f" FILTER (WHERE {cond})" if cond else ""
    return f"""count({c}){f} AS {name}_count, avg({c}){f} AS {name}_mean, stddev_samp({c}){f} AS {name}_std, min({c}){f} AS {name}_min,
      quantile_cont(({c})::DOUBLE, 0.25){f} AS {name}_p25, quantile_cont(({c})::DOUBLE, 0.5){f} AS {name}_p50,
      quantile_cont(({c})::DOUBLE, 0.75){f} AS {name}_p75, max({c}){f} AS {name}_max"""
