import json

import pytest
from pyspark.sql import functions as F

from chatmill.functions import mathtext as M
from chatmill.functions import text as X
from chatmill.functions import verifiers as V
from chatmill.operators import scoring as SC


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


CASES = [
    ("gsm8k", "so it is 1,234.", "1234", 1.0),
    ("gsm8k", "first 3 then -4.5", "-4.5", 1.0),
    ("gsm8k", "first 3 then -4", "-4", 0.0),
    ("gsm8k", "no digits", "NO DIGITS", 1.0),
    ("flan", "The answer is: wrong The answer is: the Cat!", "cat", 1.0),
    ("flan", "dog", "cat", 0.0),
    ("string_matcher", "<answer>x</answer> <answer>A dog.</answer>", "dog", 1.0),
    ("string_matcher", "dog", "dog", 0.0),
    ("string_f1", "<think>z</think> the cat sat", "cat sat down", 0.8),
    ("string_f1", "nothing", "cat", 0.0),
    ("string_f1", "<think>z</think> the cat sat", '["dog", "cat sat down", "a cow"]', 0.8),
    ("string_f1", "the dog", '["dog", 7]', 1.0),
    ("string_f1", "cow", "[]", 0.0),
    ("string_f1", "[sic] cat", "[sic] cat", 1.0),
    ("puzzle", "<think>a</think><answer>An Apple</answer>", "apple", 1.0),
    ("re_search_f1", "<finish>cat sat</finish>", '["dog", "cat sat"]', 1.0),
    ("re_search_f1", "<finish>cow</finish>", '["dog", "cat"]', 0.1),
    ("re_search_f1", "cat", '["cat"]', 0.0),
    ("re_search_f1", "<finish></finish>", '["cat"]', 0.0),
    ("re_search", "<FINISH>The Cat</Finish>", '["dog", "cat"]', 1.0),
    ("re_search", "<finish>cat</finish>", "cat", 1.0),
    ("re_search", "<finish> </finish>", "cat", 0.0),
    ("passthrough", "a", "b", 0.0),
    ("math", r"thus \boxed{\frac12}", r"\frac{1}{2}", 1.0),
    ("math", r"thus \boxed{3} no \boxed{{4}+1}", "{4}+1", 1.0),
    ("math", "Final Answer: The final answer is 5 dollars. I hope it is correct.", "5", 1.0),
    ("math", "we get $x = 7$ units", "7", 1.0),
    ("math", "1,000", "1000", 1.0),
    ("math", r"\boxed{2}", "3", 0.0),
    ("strict_math", "Final Answer: The final answer is $0.5$. I hope it is correct.", "0.5", 1.0),
    ("strict_math", r"\boxed{4}", "5", 0.0),
    ("ifeval_old", "no commas here", json.dumps({"func_name": "validate_no_commas"}), 1.0),
    ("ifeval_old", "a word", json.dumps({"func_name": "verify_keywords", "keyword_list": ["word", "x"]}), 0.0),
]


def test_rule_verifiers(spark):
    df = spark.createDataFrame([(i, n, p, lab) for i, (n, p, lab, _) in enumerate(CASES)], "i int, name string, p string, label string")
    names = sorted({c[0] for c in CASES})
    scored = SC.score(df.withColumns({"ground_truth": F.array("label"), "dataset": F.array("name")}), "p", use=names)
    got = {r["i"]: r["reward"] for r in scored.select("i", "reward").collect()}
    assert [(CASES[i], got[i]) for i in got if abs(got[i] - CASES[i][3]) > 1e-9] == []


def test_lengths(spark):
    df = spark.createDataFrame([("120", 100), ("80", 100)], "label string, n int")
    r = df.select(V.max_length(F.lit(""), F.col("label"), F.col("n"), 10).alias("a"), V.up_to_max_length(F.lit(""), F.col("label"), F.col("n"), 10).alias("b")).collect()
    assert [(x["a"], x["b"]) for x in r] == [(-1.0, 1.0), (-1.0, -1.0)]


def test_score_job_weights_unknown_and_mismatch(spark):
    df = spark.createDataFrame([("5", ["5", "x"], ["gsm8k", "nope"])], "prediction string, ground_truth array<string>, dataset array<string>")
    r = SC.score(df, mult=10.0, weights={"gsm8k": 0.5}, use=["gsm8k"]).first()
    assert r["reward"] == 5.0 and len(r["rewards"]) == 1
    bad = spark.createDataFrame([("5", ["5"], ["gsm8k", "nope"])], "prediction string, ground_truth array<string>, dataset array<string>")
    with pytest.raises(Exception, match="differ in number"):
        SC.score(bad, use=["gsm8k"]).collect()
    with pytest.raises(ValueError):
        V.registry("a=missing")
    assert V.registry("Old=gsm8k")["old"] is V.gsm8k


LATEX = [
    (r"\dfrac{1}{2}", r"\frac{1}{2}"),
    (r"\frac12", r"\frac{1}{2}"),
    (r"\frac1{72}", r"\frac{1}{72}"),
    ("3/4", r"\frac{3}{4}"),
    ("0.5", r"\frac{1}{2}"),
    (".5", r"\frac{1}{2}"),
    (r"\sqrt3", r"\sqrt{3}"),
    (r"10\%", "10"),
    (r"x = 5", "5"),
    (r"90^\circ", "90"),
    (r"5\text{ cm}", "5"),
    (r"\left( 1 \right)", "(1)"),
    ("", ""),
]


def test_strip_form(spark):
    df = spark.createDataFrame(LATEX, "a string, b string")
    got = [(r["a"], r["x"], r["b"]) for r in df.select("a", "b", M.strip_form(F.col("a")).alias("x")).collect()]
    assert [g for g in got if g[1] != g[2]] == []


def test_judgements(spark):
    rows = [
        ("general-quality", '<think>x</think>{"REASONING": "r", "SCORE": 7}', 0.7),
        ("safety", '```json\n{"SCORE": "0.5"}\n```', 0.5),
        ("safety", 'bad "SCORE": 1 }', 1.0),
        ("safety", "nothing", 0.0),
        ("web_instruct_general_verifier", "Final Decision: Yes", 1.0),
        ("unknown", "5", 0.0),
    ]
    df = spark.createDataFrame(rows, "k string, t string, e double")
    assert all(r["e"] == pytest.approx(r["s"]) for r in df.select("e", V.judge_score(F.col("k"), F.col("t")).alias("s")).collect())
    free = [("4/5", 0.8), ("85%", 0.85), ("is .5", 0.5), ("Correct!", 1.0), ("bad", 0.0), ("?", 0.0)]
    df = spark.createDataFrame(free, "t string, e double")
    assert all(r["e"] == pytest.approx(r["s"]) for r in df.select("e", V.free_text_score(F.col("t")).alias("s")).collect())


def test_ratings_and_verdicts(spark):
    t = "Rating: 4\nRationale: good\n\nRating: N/A\nRationale: none\n\njunk\n\nRating: great\nRationale: x"
    assert one(spark, V.rating_list(F.col("t"), False), t=t) == ["4", "N/A", "1", "1"]
    typed = "Type: 1, 2\nRationale: a\nRating: 3\nRationale: b\n\njunk"
    assert one(spark, V.rating_list(F.col("t"), True), t=typed) == ["3", "1"]
    c, r, why = V.judged_pair(F.col("t"), F.lit(1), F.lit("A"), F.lit("B"))
    assert one(spark, F.array(c, r, why), t="Comparison: b wins Preferred: 0") == ["B", "A", "b wins"]
    e, d = V.prompt_verdict(F.col("t"))
    assert one(spark, F.array(e, d), t="Explanation: odd\nDecision: B") == ["odd", "b"]


def test_answer_extraction(spark):
    assert one(spark, X.final_answer(F.col("t")), t="a<answer> b </answer>") == "b"
    assert one(spark, X.final_answer(F.col("t")), t="x</think> y ") == "y"
    assert one(spark, X.final_answer(F.col("t")), t="<|assistant|> y ") == "y"
    assert one(spark, X.final_answer(F.col("t")), t=" y ") == " y "
    im = "<|im_start|>user\nfirst<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n<|im_start|>user\nsecond\n<functions>f</functions><|im_end|>\n<|im_start|>assistant\n<think>"
    assert one(spark, X.user_query(F.col("t")), t=im) == "second"
    assert one(spark, X.user_query(F.col("t")), t="plain") == "plain"


def test_salvage_json(spark):
    assert one(spark, X.salvage_json(F.col("t")), t='note ```json {"a": {"b": 1}} ``` end') == '{"a": {"b": 1}}'
    assert one(spark, X.salvage_json(F.col("t")), t="none") is None


def test_combine_rewards(spark):
    def run(**kw):
        return one(spark, SC.combine_rewards(F.lit(3.0), **kw), x=1)

    turns = F.array(F.lit(1.0), F.lit(2.0))
    assert run() == 3.0
    assert run(turn_rewards=turns) == 5.0
    assert run(turn_rewards=turns, aggregator="sum") == 6.0
    assert run(turn_rewards=F.array().cast("array<double>"), aggregator="sum") == 3.0
    assert run(format_score=F.lit(1.0), additive=True) == 4.0
    assert run(format_score=F.lit(0.0)) == 0.0
    assert run(format_score=F.lit(2.0)) == 0.0  # the gate needs exactly 1
    assert run(format_score=F.lit(1.0), good=F.lit(False)) == 1.0
    assert run(finish_reason=F.lit("length"), penalty=-10.0) == -10.0


def test_code_and_rubric_scores(spark):
    r = spark.createDataFrame([(1, True, 0.5), (1, False, 0.5), (2, False, 0.1)], "id int, ok boolean, t double")
    got = {x["id"]: x["score"] for x in SC.code_scores(r, "id", "ok", "t", 0.5, 1.0).collect()}
    assert got == {1: 0.25, 2: 0.0}
    w = spark.createDataFrame([(1, 2.0, 1.0), (1, 1.0, -1.0), (2, 2.0, 0.0)], "id int, score double, weight double")
    got = {x["id"]: x["score"] for x in SC.rubric_scores(w, "id").collect()}
    assert got == {1: 0.25, 2: 0.0}
