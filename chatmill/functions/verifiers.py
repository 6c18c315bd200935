"""Rule-based scores of completions as column expressions, and parsers of judge output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatmill.functions import constraints as K
from chatmill.functions import mathtext as M
from chatmill.functions import text as X
from chatmill.functions.arrays import last, let

# A verifier builds a score from the prediction, its label and the token count of the prediction.
Verifier = Callable[[Column, Column, Column], Column]
DEFAULT_MAX_LENGTH = 32768


def score(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def gsm8k(p: Column, label: Column, n: Column = None) -> Column:
    text = F.regexp_replace(p, r"(?U)(\d),(\d)", "$1$2")
    found = last(F.regexp_extract_all(text, F.lit(r"(?U)[-+]?\d*\.\d+|\d+"), 0))
    return score(F.lower(F.coalesce(found, text)) == F.lower(label))


def math(p: Column, label: Column, n: Column = None) -> Column:
    return M.math_score(p, label)


def strict_math(p: Column, label: Column, n: Column = None) -> Column:
    return M.strict_math_score(p, label)


def _constraint_list(label: Column) -> Column:
    """JSON constraint record, alone or as the only item of a list."""
    body = F.regexp_replace(X.strip(label), r"(?s)\A\[(.*)\]\z", "$1")
    return F.from_json(body, K.CONSTRAINTS)


def constraints_score(p: Column, label: Column, rules: list[str] | None = None) -> Column:
    """Share of constraints met by the answer behind the thinking; 0 for an empty answer."""
    answer = X.remove_thinking(p)

    def each(record):
        pairs = F.zip_with(record["instruction_id"], record["kwargs"], lambda i, k: F.struct(i.alias("id"), k.alias("args")))
        met = lambda t: F.transform(pairs, lambda c: F.coalesce(K.check(c["id"], t, c["args"], rules), F.lit(False)).cast("double"))
        return let(answer, lambda t: let(met(t), lambda m: F.when(F.size(m) > 0, F.aggregate(m, F.lit(0.0), lambda a, x: a + x) / F.size(m))))

    return F.when((F.length(p) == 0) | (F.length(answer) == 0), F.lit(0.0)).otherwise(F.coalesce(let(_constraint_list(label), each), F.lit(0.0)))


def ifeval(p: Column, label: Column, n: Column = None) -> Column:
    return constraints_score(p, label)


def ifeval_old(p: Column, label: Column, n: Column = None) -> Column:
    """One constraint named by ``func_name``."""
    functions = [r for r in K.RULES if ":" not in r]
    return let(F.from_json(label, K.ARGS), lambda a: let(X.remove_thinking(p), lambda t: score(K.check(K.argument(a, "func_name"), t, a, functions))))


def flan(p: Column, label: Column, n: Column = None) -> Column:
    answer = X.strip(X.after_last(p, "The answer is: "))
    return score(X.normalise_answer(answer) == X.normalise_answer(label))


def string_matcher(p: Column, label: Column, n: Column = None) -> Column:
    answer = X.before_first(X.after_last(p, "<answer>"), "</answer>")
    return score(p.contains("<answer>") & p.contains("</answer>") & (X.normalise_answer(answer) == X.normalise_answer(label)))


def string_f1(p: Column, label: Column, n: Column = None) -> Column:
    """F1 with the label, or the best one where the label is a JSON list."""
    listed = F.when(label.rlike(r"^\s*\["), F.from_json(label, "array<string>"))
    return let(X.remove_thinking(p), lambda t: F.when(listed.isNotNull(), best_f1(t, listed)).otherwise(X.token_f1(t, label)))


def best_f1(p: Column, labels: Column) -> Column:
    """Highest F1 over several labels."""
    return F.coalesce(F.array_max(F.transform(labels, lambda lab: X.token_f1(p, lab))), F.lit(0.0))


def puzzle(p: Column, label: Column, n: Column = None) -> Column:
    return score(X.normalise_answer(X.remove_thinking(p)) == X.normalise_answer(label))


def json_labels(label: Column) -> Column:
    """Labels out of a JSON list, a JSON scalar, or plain text."""
    listed = F.from_json(label, "array<string>")
    scalar = F.get(F.from_json(F.concat(F.lit("["), label, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(label.rlike(r"^\s*\["), F.coalesce(listed, F.array(X.strip(label)))).otherwise(F.array(F.coalesce(scalar, X.strip(label))))


def re_search_f1(p: Column, label: Column, n: Column = None) -> Column:
    answer = X.before_first(X.after_last(p, "<finish>"), "</finish>")
    f1 = best_f1(answer, json_labels(label))
    tagged = p.contains("<finish>") | p.contains("</finish>")
    return F.when(~tagged | (F.length(answer) == 0), F.lit(0.0)).otherwise(let(f1, lambda s: F.when(s == 0, F.lit(0.1)).otherwise(s)))


def re_search(p: Column, label: Column, n: Column = None) -> Column:
    answer = X.strip(F.regexp_extract(p, r"(?is)<finish>(.*?)</finish>", 1))
    hit = let(X.normalise_answer(answer), lambda a: F.exists(json_labels(label), lambda lab: X.normalise_answer(lab) == a))
    return score((F.length(answer) > 0) & hit)


def max_length(p: Column, label: Column, n: Column, limit: int = DEFAULT_MAX_LENGTH) -> Column:
    return 1 - F.abs(n - label.try_cast("double")) / limit


def up_to_max_length(p: Column, label: Column, n: Column, limit: int = DEFAULT_MAX_LENGTH) -> Column:
    over = n - label.try_cast("double")
    return F.when(over < 0, F.lit(1.0)).otherwise(1 - over / limit)


def passthrough(p: Column, label: Column, n: Column = None) -> Column:
    return F.lit(0.0)


def format_reward(p: Column, scale: float = 1.0) -> Column:
    return F.when(p.rlike(r"(?sU)\A.*?</think>\s*<answer>.*?</answer>"), F.lit(float(scale))).otherwise(F.lit(0.0))


# Fixed values. Verifier names and their scores; every weight is 1 unless a job sets another.
VERIFIERS: dict[str, Verifier] = {
    "gsm8k": gsm8k,
    "math": math,
    "strict_math": strict_math,
    "ifeval": ifeval,
    "ifeval_old": ifeval_old,
    "flan": flan,
    "string_matcher": string_matcher,
    "string_f1": string_f1,
    "puzzle": puzzle,
    "re_search_f1": re_search_f1,
    "re_search": re_search,
    "max_length": max_length,
    "up_to_max_length": up_to_max_length,
    "passthrough": passthrough,
}


def registry(remap: str | None = None, extra: dict[str, Verifier] | None = None) -> dict[str, Verifier]:
    """Verifiers by lower-case name, with user additions and an ``old=new`` alias."""
    table = dict(VERIFIERS) | {k.lower(): v for k, v in (extra or {}).items()}
    if remap:
        old, new = remap.split("=")
        if new.lower() not in table:
            raise ValueError(f"verifier {new} not found")
        table[old.lower()] = table[new.lower()]
    return table


# -- judge output ---------------------------------------------------------------------------------


def judge_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)<think>\s*.*?\s*</think>\s*", "")
    return X.replace_all(c, [("<answer>", ""), ("</answer>", "")])


def json_score(c: Column) -> Column:
    """SCORE of a JSON judgement; by pattern when the JSON is broken; else 0."""
    body = F.regexp_replace(F.regexp_replace(X.strip(c), r"\A```(?:json)?", ""), r"```\z", "")
    body = X.strip(X.replace_all(body, [("\r\n", "\n"), ("\n", "\\n")]))
    parsed = F.coalesce(F.get_json_object(body, "$.SCORE").try_cast("double"), F.lit(0.0))
    found = F.regexp_extract(body, r'"SCORE"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)"?', 1).try_cast("double")
    return F.when(X.is_json(body), parsed).otherwise(F.coalesce(found, F.lit(0.0)))


def json_score_of_ten(c: Column) -> Column:
    return json_score(c) / 10.0


def yes_no_score(c: Column) -> Column:
    return score(F.lower(c).contains("final decision: yes"))


def free_text_score(c: Column) -> Column:
    """First ratio, else first percentage, else first number, else a yes/no word, else 0."""
    number = r"(\d+\.?\d*|\.\d+)"
    top, bottom = F.regexp_extract(c, r"(\d+)/(\d+)", 1).try_cast("double"), F.regexp_extract(c, r"(\d+)/(\d+)", 2).try_cast("double")
    return (
        F.when(c.rlike(r"\d+/\d+"), F.try_divide(top, bottom))
        .when(c.rlike(number + "%"), F.regexp_extract(c, number + "%", 1).try_cast("double") / 100.0)
        .when(c.rlike(number), F.regexp_extract(c, number, 1).try_cast("double"))
        .when(F.lower(c).rlike("yes|correct|good|true|pass"), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


# Fixed values. Judge kinds and how their text becomes a score.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "quality": json_score_of_ten,
    "quality_rubric": json_score,
    "quality_ref": json_score_of_ten,
    "safety": json_score,
    "factuality": json_score,
    "creative_writing": json_score,
    "refusal": json_score,
    "web_instruct_general_verifier": yes_no_score,
}


def judge_score(kind: Column, c: Column, extractors=None) -> Column:
    """Score of a judgement by its kind; a ``general-`` prefix on the kind is ignored."""
    name, table = F.regexp_replace(kind, "^general-", ""), extractors or EXTRACTORS

    def pick(body):
        out = F.when(F.lit(False), F.lit(0.0))
        for f in dict.fromkeys(table.values()):
            out = out.when(name.isin([k for k, g in table.items() if g is f]), f(body))
        return out.otherwise(F.lit(0.0))

    return F.coalesce(let(judge_text(c), pick), F.lit(0.0))


def rating_list(c: Column, typed: bool) -> Column:
    """Ratings (strings) of the blank-line separated blocks of a rating text; "1" where a block has none."""
    p = r"(?s)Type: (.+?)\nRationale: (.+?)\nRating: (.+?)\nRationale: (.+)" if typed else r"(?s)Rating: (.+?)\nRationale: (.+)"
    group = 3 if typed else 1

    def one(block):
        field = F.regexp_extract(block, p, group)
        digits = F.coalesce(F.nullif(F.regexp_extract(field, r"(?U)\b(\d+)\b", 1), F.lit("")), F.lit("1"))
        rating = digits if typed else F.when(field == "N/A", F.lit("N/A")).otherwise(digits)
        return F.when(block.rlike(p), rating).otherwise(F.lit("1"))

    return F.transform(F.split(c, "\n\n"), one)


def rationale_list(c: Column, typed: bool) -> Column:
    p = r"(?s)Type: (.+?)\nRationale: (.+?)\nRating: (.+?)\nRationale: (.+)" if typed else r"(?s)Rating: (.+?)\nRationale: (.+)"
    return F.transform(
        F.split(c, "\n\n"), lambda b: F.when(b.rlike(p), F.regexp_extract(b, p, 2)).otherwise(F.lit("None" if typed else ""))
    )


def between_markers(c: Column, first: str, second: str) -> tuple[Column, Column]:
    """(text between the markers, text after the second up to a repeated marker); null when a marker is missing."""
    after = F.get(F.split(c, r"\Q" + first + r"\E"), F.lit(1))
    head = F.get(F.split(after, r"\Q" + second + r"\E"), F.lit(0))
    return X.strip(head), X.strip(F.get(F.split(c, r"\Q" + second + r"\E"), F.lit(1)))


def judged_pair(c: Column, shuffled: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(chosen, rejected, comparison) from a verdict on two answers shown in the order
    (pair[shuffled], pair[1 - shuffled]); nulls for a verdict that is neither 0 nor 1."""
    comparison, preferred = between_markers(c, "Comparison:", "Preferred:")
    pick = F.when(preferred == "0", shuffled).when(preferred == "1", 1 - shuffled)
    return F.when(pick == 0, a).when(pick == 1, b), F.when(pick == 0, b).when(pick == 1, a), comparison


def prompt_verdict(c: Column) -> tuple[Column, Column]:
    """(explanation, lower-case decision)."""
    explanation, decision = between_markers(c, "Explanation:", "Decision:")
    return explanation, F.lower(decision)
