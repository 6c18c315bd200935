"""Instruction constraints as column expressions.

A rule is a builder (text, args) -> boolean column; ``args`` gives the constraint's arguments by name out
of one map column. Rules are picked per row by name, so a table may mix any constraints in one pass.
Word and sentence splitting is by regular expression.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import pairwise
from operator import or_
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.functions import text as X
from chatmill.functions.arrays import indices, last, let, token_counts

# Fixed values. Constraint arguments that are numbers or lists; all others are texts.
INT_ARGS = [
    "num_sentences", "num_placeholders", "num_bullets", "num_highlights", "num_sections", "num_paragraphs", "nth_paragraph",
    "num_words", "frequency", "let_frequency", "capital_frequency", "low", "high", "small_n", "n_start", "n_end", "N", "n", "m", "i",
    "n_sent", "n_words",
]
LIST_ARGS = ["keywords", "keyword_list", "forbidden_words", "key_sentences", "options"]
# Arguments arrive as a JSON object; a map keeps names that differ in case only apart.
ARGS = T.MapType(T.StringType(), T.StringType())
CONSTRAINTS = T.StructType([T.StructField("instruction_id", T.ArrayType(T.StringType())), T.StructField("kwargs", T.ArrayType(ARGS))])


def argument(args: Column, name: str) -> Column:
    value = F.try_element_at(args, F.lit(name))
    if name in INT_ARGS:
        return value.try_cast("int")
    return F.from_json(value, "array<string>") if name in LIST_ARGS else value


# Fixed values. Answers of the closed-choice constraint.
FIXED_RESPONSES = ["My answer is yes.", "My answer is no.", "My answer is maybe."]

# Fixed value. Sentence ends of the function form: after . or ? but not inside abbreviations.
SENTENCE_BREAK = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"


class Given:
    """What a rule gets beside the text: its arguments by name, and what several rules need of the text. ``units`` gives that for
    a table whose rows are judged by many rules; a caller that keeps it in columns has it worked out once a row."""

    def __init__(self, args: Column, low: Column, begin: Column):
        self.args, self.low, self.begin = args, low, begin

    def __call__(self, name: str) -> Column:
        return argument(self.args, name)


Rule = Callable[[Column, Given], Column]
RULES: dict[str, Rule] = {}


def rule(*names: str):
    def register(fn: Rule) -> Rule:
        for n in names:
            RULES[n] = fn
        return fn

    return register


def relate(n: Column, relation: Column, bound: Column) -> Column:
    return F.when(relation == "less than", n < bound).when(relation == "at least", n >= bound)


def quantify(n: Column, quantifier: Column, bound: Column, around: Column) -> Column:
    return F.when(quantifier == "at least", n >= bound).when(quantifier == "at most", n <= bound).when(quantifier == "around", around).otherwise(F.lit(False))


def count(c: Column, pattern: Column | str) -> Column:
    return F.regexp_count(c, F.lit(pattern) if isinstance(pattern, str) else pattern)


# Fixed value. Words of ASCII letters of which no other character becomes one by lower case or by (?iu): all but i, k and s.
OWN_LETTERS = r"\A[A-HJLM-RT-Za-hjlm-rt-z]+\z"


def any_case(pattern: Column) -> Column:
    return F.concat(F.lit("(?iu)"), pattern)


def count_any_case(c: Column, low: Column, pattern: Column) -> Column:
    """Occurrences of the pattern in ``c``, of which ``low`` is the lower case; letters are counted without a search by pattern."""
    return F.when(pattern.rlike(OWN_LETTERS), occurrences(low, F.lower(pattern))).otherwise(count(c, any_case(pattern)))


def occurrences(c: Column, part: Column) -> Column:
    gone = F.octet_length(c) - F.octet_length(F.replace(c, part, F.lit("")))
    return (gone / F.greatest(F.octet_length(part), F.lit(1))).cast("int")


def only_if(possible: Column, full: Column, none: Column) -> Column:
    """``full``, which goes through the whole text, unless a cheaper test shows that it gives ``none``. Not ``&``: Spark takes
    what both its sides share as needed and works it out beforehand."""
    return F.when(~possible, none).otherwise(full)


def unless(broken: Column, full: Column) -> Column:
    return only_if(~broken, full, F.lit(False))


# Fixed value. Characters of ``head``.
HEAD = 400


def head(c: Column, n: int = HEAD) -> Column:
    """The words that end in the first ``n`` characters, up to and with the white space behind the last of them; empty when
    there is none. Words, tokens and sentences of it are those the text begins with; only its last sentence may go on."""
    return F.regexp_extract(F.substring(c, 1, n), r"(?Us)\A.*\s", 0)


def units(c: Column) -> dict[str, Column]:
    """The lower case of a text and the sentences of its ``head``."""
    return {"low": F.lower(c), "begin": sentences(head(c))}


def split_at(c: Column, sep: str, pattern: str) -> Column:
    """``F.split`` by a pattern of which every match holds ``sep``."""
    return only_if(c.contains(sep), F.split(c, pattern), F.array(c))


def sentences(c: Column) -> Column:
    """Non-blank pieces behind . ! ? and white space, without white space around them: none is left inside the stripped text,
    since a piece ends with one of the three marks and all white space behind it goes."""
    flat = X.strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.filter(F.split(flat, rf"\s(?<=[.!?]\s)(?U:[{X.WS}]*)"), lambda s: s != "")


# What ``word_tokens`` finds, and the begin of a word among it: words are joined by single - and '. The letter U+10000 belongs
# to \w as it is, and U+10FFFF to \p{Cn}; with them Java looks back by characters and not by halves of them. CAPITAL finds the
# tokens without a-z that may have a letter; its first character comes before the looks back, which cost more. A letter that is
# too new for Java, though lower() and upper() know its case, is \p{Cn} and a token by itself.
TOKEN = r"(?:\w++(?:[-']\w++)*+|[^\w\s])"
WORD_START = "\\b(?<![\\w\U00010000][-'])"
_NO_LOWER = r"[[^a-z]&&\w]"
CAPITAL = (
    r"(?U)[[^a-z]&&[\w\p{Cn}]](?:" + "(?<=\\b[\\w\U00010000])(?<![\\w\U00010000][-'][\\w\U00010000])"
    rf"{_NO_LOWER}*+(?:[-']{_NO_LOWER}++)*+(?!\w)(?![-']\w)" + "|(?<=[\\p{Cn}\U0010ffff]))"
)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+(?:[-']\w+)*|[^\w\s]"), 0)


def same_text(a: Column, b: Column) -> Column:
    """Lower case never makes a text shorter, so a text with more behind as many characters as ``b`` has differs."""
    low = F.lower(X.strip(b))
    rest = F.ltrim(F.substring(F.ltrim(a, F.lit(X.WS_CHARS)), F.length(low) + 1, F.lit(64)), F.lit(X.WS_CHARS))
    return only_if(rest == "", F.lower(X.strip(a)) == low, F.lit(False))


def literal_split(c: Column, sep: str) -> Column:
    return split_at(c, sep, r"\Q" + sep + r"\E")


def only_ends_blank(pieces: Column, check: Callable[[Column], Column]) -> Column:
    """False when an inner piece is blank; else ``check`` on the non-blank pieces."""

    def body(p):
        n = F.size(p)
        inner = F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0)))
        return ~F.exists(inner, X.is_blank) & check(F.filter(p, lambda x: ~X.is_blank(x)))

    return let(pieces, body)


def bare_word(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\s]", "")


# -- registered constraints -----------------------------------------------------------------------


@rule("length_constraints:number_sentences")
def _(t, a):
    n = F.when(F.size(a.begin) >= a("num_sentences"), F.size(a.begin)).otherwise(F.size(sentences(t)))
    return let(n, lambda n: relate(n, a("relation"), a("num_sentences")))


@rule("length_constraints:number_words")
def _(t, a):
    return relate(count(t, r"(?U)\w+"), a("relation"), a("num_words"))


@rule("length_constraints:number_paragraphs")
def _(t, a):
    parted = only_ends_blank(F.split(t, r"\s?\*\*\*\s?"), lambda p: F.size(p) == a("num_paragraphs"))
    return only_if(t.contains("***"), parted, F.when(X.is_blank(t), 0).otherwise(1) == a("num_paragraphs"))


@rule("paragraphs:paragraphs")
def _(t, a):
    return unless(~t.contains("***"), only_ends_blank(F.split(t, r"\s?\*\*\*\s?"), lambda p: F.size(p) == 2))


@rule("paragraphs:paragraphs2")
def _(t, a):
    return unless(~t.contains("\n\n"), only_ends_blank(F.split(t, "\n\n"), lambda p: F.size(p) == 2))


@rule("length_constraints:nth_paragraph_first_word")
def _(t, a):
    def body(p):
        n = F.size(F.filter(p, lambda x: ~X.is_blank(x)))
        word = X.first_word(F.get(p, a("nth_paragraph") - 1))
        first = F.regexp_extract(F.lower(word), r"""^'*"*([^.,?!'"]*)""", 1)
        return (a("nth_paragraph") <= n) & (n == a("num_paragraphs")) & (first == F.lower(a("first_word")))

    return let(split_at(t, "\n\n", "\n\n"), body)


@rule("detectable_content:number_placeholders")
def _(t, a):
    return only_if(t.contains("["), count(t, r"\[.*?\]"), F.lit(0)) >= a("num_placeholders")


@rule("detectable_content:postscript")
def _(t, a):
    marker, p = a("postscript_marker"), a.low.contains("p.")
    return (
        F.when(marker == "P.P.S", only_if(p, a.low.rlike(r"p\.\s?p\.\s?s"), F.lit(False)))
        .when(marker == "P.S.", only_if(p, a.low.rlike(r"p\.\s?s\."), F.lit(False)))
        .otherwise(F.rlike(a.low, F.lower(marker)))
    )


@rule("detectable_format:number_bullet_lists")
def _(t, a):
    stars = only_if(t.contains("*"), count(t, r"(?md)^\s*\*[^*].*$"), F.lit(0))
    return stars + only_if(t.contains("-"), count(t, r"(?md)^\s*-.*$"), F.lit(0)) == a("num_bullets")


@rule("detectable_format:constrained_response")
def _(t, a):
    return reduce(or_, (t.contains(r) for r in FIXED_RESPONSES))


@rule("multi-turn:constrained_start")
def _(t, a):
    return F.rlike(t, F.concat(F.lit(r"(?m)^\s*"), a("starter"), F.lit(".*$")))


@rule("detectable_format:number_highlighted_sections")
def _(t, a):
    full = lambda p: F.size(F.filter(F.regexp_extract_all(t, F.lit(p), 1), lambda x: ~X.is_blank(x)))
    return only_if(t.contains("*"), full(r"\*([^\n*]*)\*") + full(r"\*\*([^\n*]*)\*\*"), F.lit(0)) >= a("num_highlights")


@rule("detectable_format:multiple_sections")
def _(t, a):
    spliter = a("section_spliter")
    found = count(t, F.concat(F.lit(r"\s?"), spliter, F.lit(r"\s?\d+\s?")))
    return only_if(F.contains(t, spliter) | ~spliter.rlike(r"\A[A-Za-z0-9 ]+\z"), found, F.lit(0)) >= a("num_sections")


@rule("detectable_format:rephrase")
def _(t, a):
    bare = lambda c: F.regexp_replace(c, r"\*.*\*", "")
    return unless(~t.contains("*"), only_if(t.rlike(r"\*.*\*"), bare(t) == bare(a("original_message")), F.lit(False)))


@rule("detectable_format:json_format")
def _(t, a):
    body = F.regexp_replace(F.regexp_replace(X.strip(t), r"\A```(?:json|Json|JSON)?", ""), r"```\z", "")
    begin = F.substring(F.ltrim(t, F.lit(X.WS_CHARS)), 1, X.JSON_LOOK)
    return unless(~begin.rlike(rf"\A(?:```|{X.JSON_START})"), let(X.strip(body), X.is_json))


@rule("detectable_format:title")
def _(t, a):
    found = F.regexp_extract_all(t, F.lit(r"(?d)<<[^\n]+>>"), 0)
    return unless(~t.contains("<<"), F.exists(found, lambda s: ~X.is_blank(F.regexp_replace(s, r"\A<+|>+\z", ""))))


@rule("keywords:existence")
def _(t, a):
    return F.forall(a("keywords"), lambda k: F.rlike(t, any_case(k)))


@rule("keywords:frequency", "keywords:word_count_different_numbers")
def _(t, a):
    return let(count_any_case(t, a.low, a("keyword")), lambda n: relate(n, a("relation"), a("frequency")))


@rule("keywords:word_once")
def _(t, a):
    return count_any_case(t, a.low, a("keyword")) == 1


@rule("count:count_increment_word")
def _(t, a):
    return (count_any_case(t, a.low, a("keyword1")) == 1) & (count_any_case(t, a.low, a("keyword2")) == 2)


@rule("keywords:key_sentences")
def _(t, a):
    # a text without one of the words of a key has not the key
    possible = F.filter(a("key_sentences"), lambda k: F.forall(F.split(k, "[ \n]"), lambda w: F.contains(t, w)))
    found = lambda keys: let(sentences(t), lambda s: F.size(F.filter(keys, lambda k: F.array_contains(s, k))))
    return let(possible, lambda keys: only_if(F.size(keys) > 0, found(keys), F.lit(0))) == a("num_sentences")


@rule("keywords:forbidden_words")
def _(t, a):
    # \b costs more than a letter, so where it can it comes behind the word
    own = lambda w: only_if(F.contains(a.low, F.lower(w)), F.rlike(t, F.concat(F.lit("(?iU)"), w, F.lit(r"(?<=\b"), w, F.lit(r")\b"))), F.lit(False))
    any_of = lambda w: F.when(w.rlike(OWN_LETTERS), own(w)).otherwise(F.rlike(t, F.concat(F.lit(r"(?iU)\b"), w, F.lit(r"\b"))))
    return ~F.exists(a("forbidden_words"), any_of)


@rule("keywords:exclude_word_harder")
def _(t, a):
    return ~F.contains(t, F.concat(F.lit(" "), a("keyword"), F.lit(" ")))


@rule("keywords:letter_frequency", "letters:letter_counting2")
def _(t, a):
    letter = F.lower(a("letter"))
    n = F.length(letter) * occurrences(a.low, letter)
    return F.when(a("let_relation") == "less than", n < a("let_frequency")).otherwise(n >= a("let_frequency"))


@rule("detectable_content:rephrase_paragraph")
def _(t, a):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)
    original = words(a("original_paragraph"))
    shared = lambda v: F.aggregate(
        F.map_entries(token_counts(original)), F.lit(0), lambda s, e: s + F.least(e["value"], F.coalesce(F.try_element_at(v, e["key"]), F.lit(0)))
    )
    # only words of the original are looked for, by their first letters
    any_of = F.array_join(F.array_distinct(original), "|")
    initials = F.regexp_replace(any_of, r"([^|])[^|]*\|?", "$1")
    pattern = F.concat(F.lit("(?U)(?=["), initials, F.lit(r"])\b(?:"), any_of, F.lit(r")\b"))
    found = F.when(F.size(original) > 0, F.regexp_extract_all(a.low, pattern, F.lit(0))).when(t.isNotNull(), F.array().cast("array<string>"))
    return let(let(token_counts(found), shared), lambda n: n.between(a("low"), a("high")))


@rule("combination:two_responses")
def _(t, a):
    differ = lambda p: F.coalesce((F.size(p) == 2) & (X.strip(F.get(p, F.lit(0))) != X.strip(F.get(p, F.lit(1)))), F.lit(False))
    return unless(~t.contains("******"), only_ends_blank(literal_split(t, "******"), differ))


@rule("combination:repeat_prompt")
def _(t, a):
    # only a sigma has a lower case that depends on what stands around it
    prompt = F.lower(X.strip(a("prompt_to_repeat")))
    begin = F.substring(F.ltrim(t, F.lit(X.WS_CHARS)), F.lit(1), F.length(prompt))
    return F.when(~begin.contains("\u03a3"), F.startswith(F.lower(begin), prompt)).otherwise(F.startswith(F.lower(X.strip(t)), prompt))


@rule("startend:end_checker")
def _(t, a):
    return F.endswith(F.lower(F.regexp_replace(X.strip(t), r'\A"+|"+\z', "")), F.lower(X.strip(a("end_phrase"))))


@rule("startend:quotation")
def _(t, a):
    return X.strip(t).rlike(r'(?s)\A".*"\z')


@rule("change_case:capital_word_frequency")
def _(t, a):
    # a token with one of a-z, or a mark, is none
    tokens = F.regexp_extract_all(t, F.lit(CAPITAL), 0)
    n = F.size(F.filter(tokens, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    return F.when(a("capital_relation") == "less than", n < a("capital_frequency")).otherwise(n >= a("capital_frequency"))


@rule("change_case:english_capital")
def _(t, a):
    return only_if(~t.rlike("[a-z]"), (t == F.upper(t)) & (t != F.lower(t)), F.lit(False))


@rule("change_case:english_lowercase")
def _(t, a):
    return only_if(~t.rlike("[A-Z]"), (t == F.lower(t)) & (t != F.upper(t)), F.lit(False))


@rule("punctuation:no_comma")
def _(t, a):
    return ~t.contains(",")


@rule("punctuation:punctuation_dot")
def _(t, a):
    return ~t.contains(".")


@rule("punctuation:punctuation_exclamation")
def _(t, a):
    return ~t.contains("!")


@rule("copy:repeat_phrase")
def _(t, a):
    def body(ref):
        n = F.size(ref)
        pattern = F.concat(F.get(ref, F.lit(0)), F.lit(" .*? "), F.get(ref, n - 1))
        diffs = F.transform(
            F.regexp_extract_all(t, pattern, F.lit(0)),
            lambda p: let(
                X.words(p),
                lambda w: F.when(F.size(w) == n, F.size(F.filter(F.zip_with(w, ref, lambda x, y: x != y), lambda d: d))).otherwise(F.lit(99)),
            ),
        )
        return let(diffs, lambda d: (F.size(d) == a("small_n")) & F.forall(d, lambda x: x <= 1) & F.coalesce(last(d) == 1, F.lit(False)))

    return let(X.words(a("phrase")), body)


@rule("copy:copy", "copy:copying_simple")
def _(t, a):
    return same_text(t, a("prompt_to_repeat"))


@rule("new:copy_span_idx")
def _(t, a):
    span = a("prompt_to_repeat").substr(a("n_start") + 1, F.greatest(a("n_end") - a("n_start"), F.lit(0)))
    return same_text(t, span)


@rule("copy:copying_multiple")
def _(t, a):
    parts = literal_split(t, "******")
    return (F.size(parts) == a("N")) & F.forall(parts, lambda p: same_text(p, a("prompt_to_repeat")))


@rule("detectable_format:sentence_hyphens")
def _(t, a):
    gold, parts = lambda c: sentences(F.replace(c, F.lit("-"), F.lit(" "))), split_at(t, "-", "-")
    pairs = F.filter(F.arrays_zip(parts.alias("p"), gold(t).alias("g")), lambda z: z["p"].isNotNull() & z["g"].isNotNull())
    full = F.forall(pairs, lambda z: z["p"] == z["g"])  # a sentence has no white space around it
    # the first pair decides most texts; a first sentence without - is the same with and without them
    wrong = lambda g: (F.size(g) > 1) & (F.substring_index(t, "-", 1) != F.get(g, F.lit(0)))
    return unless(wrong(a.begin) & ~F.get(a.begin, F.lit(0)).contains("-"), let(gold(head(t)), lambda g: unless(wrong(g), full)))


# Two words, the first of ASCII characters, that begin with neighbouring letters: most of what the rule looks for.
STEP = r"[ \n](?:" + "|".join(rf"[{a}{a.upper()}][!-~]*+[ \n]++[{b}{b.upper()}]" for a, b in pairwise(ascii_lowercase)) + ")"


@rule("keywords:no_adjacent_consecutive")
def _(t, a):
    initials = F.transform(X.words(t), lambda w: F.ascii(F.lower(F.substring(w, 1, 1))))
    return unless(t.rlike(STEP), let(initials, lambda c: ~F.exists(indices(F.size(c) - 1), lambda i: F.get(c, i + 1) - F.get(c, i) == 1)))


@rule("detectable_format:square_brackets")
def _(t, a):
    return ~t.rlike(rf"(?U)(?<![^{X.WS}])[^{X.WS}\[]|[^{X.WS}\]](?![^{X.WS}])")


@rule("first_word:first_word_sent")
def _(t, a):
    all_of = lambda s: F.forall(s, lambda s: F.lower(X.first_word(s)) == F.lower(a("first_word")))
    return unless(~all_of(a.begin), all_of(sentences(t)))


@rule("first_word:first_word_answer")
def _(t, a):
    return F.coalesce(F.lower(F.get(X.words(t), F.lit(0))) == F.lower(a("first_word")), F.lit(False))


@rule("last_word:last_word_sent")
def _(t, a):
    all_of = lambda s: F.forall(s, lambda s: F.lower(bare_word(X.last_word(s))) == F.lower(a("last_word")))
    ended = F.slice(a.begin, F.lit(1), F.greatest(F.size(a.begin) - 1, F.lit(0)))
    return unless(~all_of(ended), all_of(sentences(t)))


@rule("last_word:last_word_answer")
def _(t, a):
    return F.coalesce(F.lower(bare_word(X.last_word(t))) == F.lower(a("last_word")), F.lit(False))


@rule("detectable_format:bigram_wrapping")
def _(t, a):
    broken = rf"(?U)\A[{X.WS}]*+(?:(?!<<)[^{X.WS}]++[{X.WS}]++[^{X.WS}]|[^{X.WS}]++[{X.WS}]++(?![^{X.WS}]*>>(?![^{X.WS}]))[^{X.WS}])"
    wrapped = let(
        X.words(t),
        lambda w: F.forall(
            F.filter(indices(F.size(w) - 1), lambda i: i % 2 == 0), lambda i: F.get(w, i).startswith("<<") & F.get(w, i + 1).endswith(">>")
        ),
    )
    return unless(t.rlike(broken), wrapped)  # in the first two words


@rule("count:lowercase_counting")
def _(t, a):
    return count(t, r"(?U)\b[a-z]+\b") <= a("N")


@rule("letters:letter_counting")
def _(t, a):
    return relate(count(t, "[a-zA-Z]"), a("relation"), a("N"))


@rule("count:counting_composition")
def _(t, a):
    ok = lambda p: let(sentences(p), lambda s: (F.size(s) == a("n_sent")) & F.forall(s, lambda x: F.size(word_tokens(x)) == a("n_words")))
    pieces = F.split(t, r"\s?\*\*\*\s?")
    return (F.size(pieces) == 3) & F.forall(pieces, ok)


@rule("count:count_unique")
def _(t, a):
    unique = lambda c: let(word_tokens(c), lambda w: F.size(w) == F.size(F.array_distinct(w)))
    return unless(~unique(head(t, HEAD // 2)), unique(t))


@rule("keywords:palindrome")
def _(t, a):
    return F.exists(X.words(t), lambda w: w == F.reverse(w))


@rule("keywords:keyword_specific_position")
def _(t, a):
    sentence = F.get(F.when(F.size(a.begin) > a("n"), a.begin).otherwise(sentences(t)), a("n") - 1)
    return F.coalesce(F.get(word_tokens(sentence), a("m") - 1) == a("keyword"), F.lit(False))


@rule("keywords:start_end")
def _(t, a):
    # a token has no space in it
    end = lambda c: F.nullif(F.regexp_extract(c, rf"(?Us)\A.*((?:{WORD_START}\w++(?:[-']\w++)*+|[^\w\s]))\s*\z", 1), F.lit(""))
    same = F.lower(F.regexp_extract(t, f"(?U){TOKEN}", 0)) == F.lower(F.coalesce(end(F.substring_index(t, " ", -1)), end(t)))
    return unless(~t.rlike(rf"(?U)\A\s*{TOKEN}\s*+\S"), same)


# -- function form --------------------------------------------------------------------------------


@rule("verify_keywords")
def _(t, a):
    return F.forall(a("keyword_list"), lambda k: F.contains(F.lower(t), F.lower(k)))


@rule("verify_keyword_frequency")
def _(t, a):
    w = F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\b\w+\b"), 0)
    return F.size(F.filter(w, lambda x: x == F.lower(a("word")))) == a("N")


@rule("validate_forbidden_words")
def _(t, a):
    return ~F.exists(a("forbidden_words"), lambda k: F.contains(a.low, F.lower(k)))


@rule("verify_letter_frequency")
def _(t, a):
    return F.length(t) - F.length(F.replace(t, a("letter"), F.lit(""))) == a("N")


@rule("verify_paragraph_count")
def _(t, a):
    return let(literal_split(t, "* * *"), lambda p: (F.size(p) == a("N")) & ~F.exists(p, X.is_blank))


@rule("validate_word_constraint")
def _(t, a):
    n, bound = X.word_count(t), a("N")
    return quantify(n, a("quantifier"), bound, F.abs(n - bound) <= F.greatest(F.bround(bound * 0.1), F.lit(1.0)))


@rule("verify_sentence_constraint")
def _(t, a):
    n = F.size(F.split(t, SENTENCE_BREAK))
    return quantify(n, a("quantifier"), a("N"), F.abs(n - a("N")) <= 1)


@rule("validate_paragraphs")
def _(t, a):
    return let(F.split(t, "\n\n"), lambda p: (F.size(p) == a("N")) & F.startswith(X.strip(F.get(p, a("i") - 1)), a("first_word")))


@rule("verify_postscript")
def _(t, a):
    tail = t.substr(F.instr(t, a("postscript_marker")), F.length(t))
    return F.contains(t, a("postscript_marker")) & (F.length(X.strip(tail)) > F.length(a("postscript_marker")))


@rule("validate_placeholders")
def _(t, a):
    return only_if(t.contains("["), count(t, r"(?d)\[(.*?)\]"), F.lit(0)) >= a("N")


@rule("verify_bullet_points")
def _(t, a):
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(rf"(?U)\A[{X.WS}]*[*-]"))
    return only_if(t.contains("*") | t.contains("-"), F.size(lines), F.lit(0)) == a("N")


@rule("validate_title")
def _(t, a):
    return unless(~t.contains("<<"), t.rlike(r"(?d)<<(.*?)>>"))


@rule("validate_choice")
def _(t, a):
    return F.exists(a("options"), lambda o: F.contains(o, t))


@rule("validate_highlighted_sections")
def _(t, a):
    return only_if(t.contains("*"), count(t, r"(?d)\*(.*?)\*"), F.lit(0)) >= a("N")


@rule("validate_sections")
def _(t, a):
    n = F.size(F.split(t, F.concat(F.lit(r"\Q"), a("section_splitter"), F.lit(r"\E"))))
    n = only_if(F.contains(t, a("section_splitter")), n, F.lit(1))
    return n - F.when(F.startswith(t, a("section_splitter")), 1).otherwise(0) == a("N")


@rule("validate_json_format")
def _(t, a):
    return X.is_json(t)


@rule("validate_repeat_prompt")
def _(t, a):
    return F.startswith(t, a("original_prompt"))


@rule("validate_two_responses")
def _(t, a):
    p = literal_split(t, "******")
    return (F.size(p) == 2) & F.coalesce(X.strip(F.get(p, F.lit(0))) != X.strip(F.get(p, F.lit(1))), F.lit(False))


@rule("validate_uppercase")
def _(t, a):
    return t == F.upper(t)


@rule("validate_lowercase")
def _(t, a):
    return only_if(~t.rlike("[A-Z]"), t == F.lower(t), F.lit(False))


@rule("validate_frequency_capital_words")
def _(t, a):
    n = count(t, r"(?U)[A-Z](?<=\b[A-Z])[A-Z]*+\b")
    return quantify(n, a("quantifier"), a("N"), n == a("N"))


@rule("validate_end")
def _(t, a):
    return F.endswith(t, a("end_phrase"))


@rule("validate_quotation")
def _(t, a):
    return t.startswith('"') & t.endswith('"')


@rule("validate_no_commas")
def _(t, a):
    return ~t.contains(",")


def check(name: Column, text: Column, args: Column, rules: list[str] | None = None, given: dict[str, Column] | None = None) -> Column:
    """Whether the text meets the constraint a row names; null for an unknown name. ``rules`` limits the
    branches to those a table uses, which keeps the generated code small. ``given`` are the text's ``units``."""
    out, given = None, Given(args, **(given or units(text)))
    for r in rules or RULES:
        met = F.coalesce(RULES[r](text, given), F.lit(False))
        out = F.when(name == r, met) if out is None else out.when(name == r, met)
    return out
