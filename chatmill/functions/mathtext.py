"""String-level comparison of final math answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatmill.functions import text as X
from chatmill.functions.arrays import let, pipe

# Fixed values. Substitutions applied in this order to a final answer.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
# Fixed values. Expressions removed in this order from a final answer.
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points",
    "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Fixed values. Pattern rewrites applied in this order after the removals.
REWRITES = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
]
# Fixed values. Literal replacements that open the second normal form.
STRIP_REPLACEMENTS = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
]


def braces_close(c: Column, start: Column) -> Column:
    """0-based position of the brace that closes the first one at or after ``start``; null when none does.
    Walks the pieces between braces once."""

    def walk(p):
        zero = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"), F.lit(0).alias("at"))

        def step(a, piece):
            up = F.when(piece.startswith("{"), 1).when(piece.startswith("}"), -1).otherwise(0)
            closed = a["end"].isNull() & (a["depth"] + up == 0) & (up == -1)
            return F.struct((a["depth"] + up).alias("depth"), F.when(closed, a["at"]).otherwise(a["end"]).alias("end"), (a["at"] + F.length(piece)).alias("at"))

        return F.aggregate(F.split(p, "(?=[{}])"), zero, step, lambda a: a["end"])

    tail = c.substr(start + 1, F.length(c))
    return start + let(tail, walk)


def last_boxed(c: Column) -> Column:
    """Content of the last boxed span, else of the last framed one; null when there is none or it is not closed."""
    spaced = X.before_first(X.after_last(c, "\\boxed "), "$")
    # position of the last marker = length of everything before the last piece
    closed = lambda b: let(braces_close(c, b - 1), lambda end: F.when(end.isNotNull(), c.substr(b + 1, end - b)))
    braced = lambda mark: F.when(c.contains(mark), let(F.length(c) - F.length(X.after_last(c, mark)), closed))
    return F.when(c.contains("\\boxed "), spaced).when(c.contains("\\boxed"), braced("\\boxed{")).otherwise(braced("\\fbox{"))


def final_answer_span(c: Column) -> Column:
    """Span of the 'Final Answer' sentence, null when there is none."""
    p = r"Final Answer: The final answer is(.*?). I hope it is correct."
    closed = F.concat(c, F.lit("I hope it is correct."))
    return F.when(closed.rlike(p), X.strip(F.regexp_extract(closed, p, 1)))


def normalise_final_answer(c: Column) -> Column:
    def rewrite(x):
        x = X.replace_all(X.after_last(x, "="), SUBSTITUTIONS + [(e, "") for e in REMOVED])
        for pattern, new in REWRITES:
            x = F.regexp_replace(x, pattern, new)
        return F.replace(x, F.lit("$"), F.lit(""))

    def join_digits(x):
        bare = F.replace(x, F.lit(","), F.lit(""))
        return F.when(bare.rlike(r"(?U)^\d+$"), bare).otherwise(x)

    return pipe(c, rewrite, join_digits)


def _fix_fracs(c: Column) -> Column:
    """\\frac1b, \\frac12 and \\frac1{72} with braces; a frac followed by fewer than two characters stays."""
    return F.regexp_replace(F.regexp_replace(c, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])(\{)", r"\\frac{$1}$2")


def strip_form(c: Column) -> Column:
    """Second normal form."""

    def units(x):
        return F.when(F.size(F.split(x, r"\\text\{ ")) == 2, X.before_first(x, "\\text{ ")).otherwise(x)

    def leading_zero(x):
        return F.when(x.startswith("."), F.concat(F.lit("0"), x)).otherwise(x)

    def right_side(x):
        return let(F.split(x, "="), lambda p: F.when((F.size(p) == 2) & (F.length(F.get(p, F.lit(0))) <= 2), F.get(p, F.lit(1))).otherwise(x))

    def braces(x):
        return _fix_fracs(F.replace(F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit("")))

    def fractions(x):
        half = F.when(x == "0.5", F.lit("\\frac{1}{2}")).otherwise(x)
        return F.regexp_replace(half, r"^(-?(?:0|[1-9][0-9]*))/(-?(?:0|[1-9][0-9]*))$", r"\\frac{$1}{$2}")

    return pipe(
        X.replace_all(c, STRIP_REPLACEMENTS), units, lambda x: X.replace_all(x, [("\\%", ""), (" .", " 0."), ("{.", "{0.")]), leading_zero, right_side, braces, fractions
    )


def same_answer(a: Column, b: Column) -> Column:
    """Equal as given or in the second normal form."""
    return F.coalesce((a == b) | (strip_form(a) == strip_form(b)), F.lit(False))


def last_dollar_span(c: Column) -> Column:
    """Text between the last two dollar signs, null with fewer than two."""
    parts = F.split(c, r"\$")
    return F.when(F.size(parts) > 2, F.get(parts, F.size(parts) - 2))


def math_candidates(c: Column) -> Column:
    """Answers to compare: boxed and stated spans, else the last dollar span, else the whole text."""
    plain = lambda span: let(span, lambda x: F.when(x.isNotNull(), normalise_final_answer(x)))
    found = F.filter(F.array(last_boxed(c), plain(final_answer_span(c))), lambda x: x.isNotNull())
    dollars = F.filter(F.array(plain(last_dollar_span(c))), lambda x: x.isNotNull())
    return pipe(
        found,
        lambda f: F.when(F.size(f) > 0, f).otherwise(dollars),
        lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(normalise_final_answer(c), c)),
    )


def math_score(prediction: Column, label: Column) -> Column:
    return let(strip_form(label), lambda s: F.exists(math_candidates(prediction), lambda a: F.coalesce((a == label) | (strip_form(a) == s), F.lit(False)))).cast("double")


def strict_math_score(prediction: Column, label: Column) -> Column:
    answer = normalise_final_answer(F.coalesce(final_answer_span(prediction), prediction))
    return let(answer, lambda a: same_answer(a, label)).cast("double")
