"""Text expressions shared by filters, joins and verifiers. All native Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatmill.functions.arrays import let, token_counts

# White space as str.strip() and str.split() see it: the Unicode property plus four separators. Regular
# expressions name the property, which Java tests far faster than a list of ranges.
WS = r"\s\x1c-\x1f"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ASCII_PUNCT = r"""!-/:-@\[-`{-~"""
# Separators of the phrase analyzer: space , . ? ! : ; ( ) " - newline backslash
PHRASE_SEPARATORS = r'[ ,.?!:;()"\-\n\\]+'


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(f"(?U)[^{WS}]")


def words(c: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(c, f"(?U)[{WS}]+"), lambda w: w != "")


def first_word(c: Column) -> Column:
    """The first of ``words``, null when there is none."""
    return F.nullif(F.regexp_extract(c, f"(?U)[^{WS}]+", 0), F.lit(""))


def last_word(c: Column) -> Column:
    """The last of ``words``, null when there is none; looked for behind the last space first."""
    end = lambda c: F.nullif(F.regexp_extract(c, rf"(?Us)\A.*(?<![^{WS}])([^{WS}]+)[{WS}]*\z", 1), F.lit(""))
    return F.coalesce(end(F.substring_index(c, " ", -1)), end(c))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"(?U)[^{WS}]+"))


def phrase_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), PHRASE_SEPARATORS), lambda w: w != "")


def normalise_answer(c: Column) -> Column:
    """Lower case, drop ASCII punctuation, drop articles, squeeze white space."""
    c = F.regexp_replace(F.lower(c), f"[{ASCII_PUNCT}]", "")
    c = F.regexp_replace(c, r"(?U)\b(a|an|the)\b", " ")
    return F.regexp_replace(strip(c), f"(?U)[{WS}]+", " ")


def after_last(c: Column, marker: str) -> Column:
    return F.substring_index(c, marker, -1)


def before_first(c: Column, marker: str) -> Column:
    return F.substring_index(c, marker, 1)


def remove_thinking(c: Column) -> Column:
    """Text after the last closing think tag, with answer tags and the assistant marker gone."""
    c = after_last(strip(F.replace(c, F.lit("<|assistant|>"), F.lit(""))), "</think>")
    return strip(F.replace(F.replace(c, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit("")))


def last_code_block(c: Column) -> Column:
    """Body of the last fenced block, null when there is none."""
    return strip(F.get(F.slice(F.regexp_extract_all(c, F.lit(r"(?s)```(?:python)?(.*?)```"), 1), -1, 1), F.lit(0)))


def sentences(c: Column) -> Column:
    """Non-blank pieces between runs of . ! ?"""
    return F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\n"), strip), lambda s: s != "")


def literal_any(c: Column, needles: list[str]) -> Column:
    """Case-insensitive substring test against a fixed list, in one pass."""
    pattern = "|".join(r"\Q" + n.lower() + r"\E" for n in needles)
    return F.lower(c).rlike(pattern)


def replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def token_f1(prediction: Column, truth: Column) -> Column:
    """Multiset token F1 of two normalised texts; 0 when they share nothing."""

    def score(p, t):
        counts = lambda tp: let(token_counts(p), lambda bag: F.aggregate(
            F.map_entries(tp), F.lit(0), lambda acc, e: acc + F.least(F.coalesce(F.try_element_at(bag, e["key"]), F.lit(0)), e["value"])
        ))
        same = let(token_counts(t), counts)
        return let(same, lambda n: F.when(n > 0, 2.0 * n / (F.size(p) + F.size(t))).otherwise(F.lit(0.0)))

    return let(words(normalise_answer(prediction)), lambda p: let(words(normalise_answer(truth)), lambda t: score(p, t)))


def final_answer(c: Column) -> Column:
    """Answer tag if there is one, else the text after the first closing think tag, else the text
    without assistant markers (trimmed only when a marker was removed)."""
    after_think = F.substring(c, F.instr(c, "</think>") + 8, F.length(c))
    unmarked = F.replace(c, F.lit("<|assistant|>"), F.lit(""))
    return (
        F.when(c.rlike(r"(?s)<answer>.*?</answer>"), strip(F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1)))
        .when(c.contains("</think>"), strip(after_think))
        .when(unmarked != c, strip(unmarked))
        .otherwise(c)
    )


def user_query(c: Column) -> Column:
    """Last user turn of a rendered chat that precedes an opened assistant think block; the text when none."""
    tags = r"(?s)<\|user\|>\n(.*?)\n<\|assistant\|>\n<think>"
    im = (
        r"(?s)<\|im_start\|>user\n((?:(?!<\|im_end\|>).)*?)(?:\n<functions>(?:(?!</functions>).)*</functions>)?<\|im_end\|>\n"
        r"(?=.*?<\|im_start\|>assistant\n<think>)"
    )
    last = lambda p: F.get(F.slice(F.regexp_extract_all(c, F.lit(p), 1), -1, 1), F.lit(0))
    return strip(F.coalesce(F.when(c.rlike(tags), last(tags)), F.when(c.rlike(im), last(im)), c))


def salvage_json(c: Column) -> Column:
    """Outermost braces of a model response, code fences removed; null when there are none."""
    body = F.regexp_replace(c, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


# Fixed value. How a JSON value begins, and how many characters tell.
JSON_START, JSON_LOOK = r'(?:[\[{"0-9-]|true|false|null)', 5


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value. The parser stops after the first value, so the text is set in an array
    and in an object: what closes one of them early is an error in the other. A text that does not begin as a value, most
    prose, is not parsed: an error costs the parser far more than a look."""
    inside = lambda before, after: F.try_parse_json(F.concat(F.lit(before), c, F.lit(after))).isNotNull()
    begin = F.substring(F.ltrim(c, F.lit(" \t\n\r")), 1, JSON_LOOK)
    return F.when(begin.rlike(rf"\A{JSON_START}"), inside("[", "]") & inside('{"v":', "}")).otherwise(F.lit(False))
