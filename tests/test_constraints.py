"""Every constraint with texts that meet it and texts that do not."""

import json

from pyspark.sql import functions as F

from chatmill.functions import constraints as K
from chatmill.functions import text as X
from chatmill.functions import verifiers as V

# (rule, arguments, text, met)
CASES = [
    ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One here. Two here!", True),
    ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "less than"}, "One here. Two here!", False),
    ("length_constraints:number_words", {"num_words": 3, "relation": "at least"}, "a b c", True),
    ("length_constraints:number_words", {"num_words": 3, "relation": "less than"}, "a b c", False),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a *** b", True),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "***\na *** b\n***", True),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 3}, "a *** *** b", False),
    ("paragraphs:paragraphs", {}, "a\n***\nb", True),
    ("paragraphs:paragraphs2", {}, "a\n\nb", True),
    ("paragraphs:paragraphs2", {}, "a\n\n\n\nb", False),
    ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "Then"}, "First x.\n\n'Then, y", True),
    ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 3, "first_word": "then"}, "a\n\nthen", False),
    ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a] and [b]", True),
    ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a]", False),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}, "Bye\nP.S. more", True),
    ("detectable_content:postscript", {"postscript_marker": "P.P.S"}, "Bye\nP. P. S more", True),
    ("detectable_content:postscript", {"postscript_marker": "NB:"}, "bye", False),
    ("detectable_format:number_bullet_lists", {"num_bullets": 3}, "* a\n- b\n\n* c", True),
    ("detectable_format:number_bullet_lists", {"num_bullets": 1}, "**bold** x", False),
    ("detectable_format:constrained_response", {}, "I think: My answer is maybe. ok", True),
    ("detectable_format:constrained_response", {}, "perhaps", False),
    ("multi-turn:constrained_start", {"starter": "I believe"}, "x\n  I believe so", True),
    ("multi-turn:constrained_start", {"starter": "I believe"}, "So I believe", False),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and **b**", True),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* * *", False),
    ("detectable_format:multiple_sections", {"section_spliter": "SECTION", "num_sections": 2}, "SECTION 1\na\nSECTION 2\nb", True),
    ("detectable_format:multiple_sections", {"section_spliter": "SECTION", "num_sections": 3}, "SECTION 1\na", False),
    ("detectable_format:rephrase", {"original_message": "I *like* it"}, "I *love* it", True),
    ("detectable_format:rephrase", {"original_message": "I *like* it"}, "You *love* it", False),
    ("detectable_format:json_format", {}, '```json\n{"a": [1, 2]}\n```', True),
    ("detectable_format:json_format", {}, "{a", False),
    ("detectable_format:title", {}, "<<my title>>\ntext", True),
    ("detectable_format:title", {}, "<< >> text", False),
    ("keywords:existence", {"keywords": ["Fox", "dog"]}, "the fox and the DOG", True),
    ("keywords:existence", {"keywords": ["fox", "cat"]}, "the fox", False),
    ("keywords:frequency", {"keyword": "ab", "frequency": 2, "relation": "at least"}, "ab AB", True),
    ("keywords:word_count_different_numbers", {"keyword": "ab", "frequency": 2, "relation": "less than"}, "ab AB", False),
    ("keywords:word_once", {"keyword": "ab"}, "x ab y", True),
    ("keywords:word_once", {"keyword": "ab"}, "ab ab", False),
    ("count:count_increment_word", {"keyword1": "one", "keyword2": "two"}, "one two two", True),
    ("count:count_increment_word", {"keyword1": "one", "keyword2": "two"}, "one two", False),
    ("keywords:key_sentences", {"key_sentences": ["A b.", "C d."], "num_sentences": 1}, "A b. X y.", True),
    ("keywords:key_sentences", {"key_sentences": ["A b.", "C d."], "num_sentences": 2}, "A b. X y.", False),
    ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "concatenate", True),
    ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "a Cat!", False),
    ("keywords:exclude_word_harder", {"keyword": "so"}, "also sofa", True),
    ("keywords:exclude_word_harder", {"keyword": "so"}, "and so on", False),
    ("keywords:letter_frequency", {"letter": "E", "let_frequency": 2, "let_relation": "at least"}, "eE", True),
    ("letters:letter_counting2", {"letter": "e", "let_frequency": 2, "let_relation": "less than"}, "eE", False),
    ("letters:letter_counting", {"N": 3, "relation": "at least"}, "a1b2c", True),
    ("letters:letter_counting", {"N": 3, "relation": "less than"}, "a1b2c", False),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "a b b c", "low": 3, "high": 3}, "b b c z", True),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "a b b c", "low": 3, "high": 3}, "b z", False),
    ("combination:two_responses", {}, "a ****** b", True),
    ("combination:two_responses", {}, "a ****** a", False),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say Hi"}, " say hi then hi", True),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say Hi"}, "hi", False),
    ("startend:end_checker", {"end_phrase": " The End. "}, 'x "the end."', True),
    ("startend:end_checker", {"end_phrase": "The end."}, "the end. no", False),
    ("startend:quotation", {}, ' "all of it" ', True),
    ("startend:quotation", {}, '"', False),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, "GO now PLEASE", True),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "less than"}, "GO now PLEASE", False),
    ("change_case:english_capital", {}, "ALL UP 1", True),
    ("change_case:english_capital", {}, "Not", False),
    ("change_case:english_lowercase", {}, "all low", True),
    ("change_case:english_lowercase", {}, "123", False),
    ("punctuation:no_comma", {}, "a b", True),
    ("punctuation:no_comma", {}, "a, b", False),
    ("punctuation:punctuation_dot", {}, "a.", False),
    ("punctuation:punctuation_exclamation", {}, "a!", False),
    ("copy:repeat_phrase", {"phrase": "we go home now", "small_n": 2}, "we go home now and we run home now", True),
    ("copy:repeat_phrase", {"phrase": "we go home now", "small_n": 2}, "we go home now and we run away now", False),
    ("copy:copy", {"prompt_to_repeat": "Abc "}, " abc", True),
    ("copy:copying_simple", {"prompt_to_repeat": "Abc"}, "abcd", False),
    ("new:copy_span_idx", {"prompt_to_repeat": "hello world", "n_start": 6, "n_end": 11}, "World", True),
    ("new:copy_span_idx", {"prompt_to_repeat": "hello world", "n_start": 0, "n_end": 5}, "World", False),
    ("copy:copying_multiple", {"prompt_to_repeat": "Hi", "N": 2}, "hi ****** HI", True),
    ("copy:copying_multiple", {"prompt_to_repeat": "Hi", "N": 3}, "hi ****** hi", False),
    ("detectable_format:sentence_hyphens", {}, "One is here.-Two is here.", True),
    ("detectable_format:sentence_hyphens", {}, "One is here. - Two is here.", False),
    ("keywords:no_adjacent_consecutive", {}, "apple cat egg", True),
    ("keywords:no_adjacent_consecutive", {}, "apple Bat", False),
    ("detectable_format:square_brackets", {}, "[a] [b]", True),
    ("detectable_format:square_brackets", {}, "[a] b", False),
    ("first_word:first_word_sent", {"first_word": "We"}, "We go. we stay.", True),
    ("first_word:first_word_sent", {"first_word": "We"}, "We go. They stay.", False),
    ("first_word:first_word_answer", {"first_word": "we"}, " We go", True),
    ("first_word:first_word_answer", {"first_word": "we"}, "", False),
    ("last_word:last_word_sent", {"last_word": "now"}, "Go now. Stay NOW!", True),
    ("last_word:last_word_sent", {"last_word": "now"}, "Go now. Stay.", False),
    ("last_word:last_word_answer", {"last_word": "now"}, "go (now).", True),
    ("last_word:last_word_answer", {"last_word": "now"}, "now go", False),
    ("detectable_format:bigram_wrapping", {}, "<<a b>> <<c d>> e", True),
    ("detectable_format:bigram_wrapping", {}, "<<a b>> c d", False),
    ("count:lowercase_counting", {"N": 2}, "one Two three", True),
    ("count:lowercase_counting", {"N": 1}, "one two", False),
    ("count:counting_composition", {"n_sent": 1, "n_words": 3}, "Go on. *** Do it. *** Be so.", True),
    ("count:counting_composition", {"n_sent": 1, "n_words": 3}, "Go on. *** Do it.", False),
    ("count:count_unique", {}, "one two three", True),
    ("count:count_unique", {}, "one two one", False),
    ("keywords:palindrome", {}, "say level up", True),
    ("keywords:palindrome", {}, "no such", False),
    ("keywords:keyword_specific_position", {"keyword": "stay", "n": 2, "m": 2}, "We go. We stay here.", True),
    ("keywords:keyword_specific_position", {"keyword": "stay", "n": 3, "m": 2}, "We go. We stay.", False),
    ("keywords:start_end", {}, "Go and go", True),
    ("keywords:start_end", {}, "Go", False),
    ("verify_keywords", {"keyword_list": ["A", "b"]}, "ab", True),
    ("verify_keyword_frequency", {"word": "The", "N": 2}, "the cat, the; other", True),
    ("validate_forbidden_words", {"forbidden_words": ["cat"]}, "concatenate", False),
    ("verify_letter_frequency", {"letter": "e", "N": 1}, "eE", True),
    ("verify_paragraph_count", {"N": 2}, "a\n* * *\nb", True),
    ("verify_paragraph_count", {"N": 2}, "a\n* * *\n", False),
    ("validate_word_constraint", {"N": 10, "quantifier": "around"}, "a b c d e f g h i", True),
    ("validate_word_constraint", {"N": 10, "quantifier": "at most"}, "a b", True),
    ("validate_word_constraint", {"N": 10, "quantifier": "at least"}, "a b", False),
    ("verify_sentence_constraint", {"N": 2, "quantifier": "at least"}, "One is. Two is.", True),
    ("verify_sentence_constraint", {"N": 3, "quantifier": "at least"}, "e.g. this one", False),
    ("validate_paragraphs", {"N": 2, "i": 2, "first_word": "Second"}, "First\n\n Second one", True),
    ("verify_postscript", {"postscript_marker": "P.S."}, "x P.S. y", True),
    ("verify_postscript", {"postscript_marker": "P.S."}, "x P.S.", False),
    ("validate_placeholders", {"N": 1}, "[x]", True),
    ("verify_bullet_points", {"N": 2}, "* a\n - b\nc", True),
    ("validate_title", {}, "<<t>>", True),
    ("validate_choice", {"options": ["yes it is", "no"]}, "yes", True),
    ("validate_highlighted_sections", {"N": 2}, "*a* *b*", True),
    ("validate_sections", {"N": 2, "section_splitter": "S#"}, "S#aS#b", True),
    ("validate_sections", {"N": 2, "section_splitter": "S#"}, "aS#b", True),
    ("validate_json_format", {}, "[1, 2]", True),
    ("validate_repeat_prompt", {"original_prompt": "Do it"}, "Do it now", True),
    ("validate_two_responses", {}, "a******b", True),
    ("validate_uppercase", {}, "ABC 1", True),
    ("validate_lowercase", {}, "aBc", False),
    ("validate_frequency_capital_words", {"N": 1, "quantifier": "around"}, "GO on", True),
    ("validate_end", {"end_phrase": "end"}, "the end", True),
    ("validate_quotation", {}, '"a"', True),
    ("validate_no_commas", {}, "a,b", False),
]


def test_every_rule_is_covered():
    assert {c[0] for c in CASES} == set(K.RULES)


def test_rules(spark):
    df = spark.createDataFrame([(i, r, json.dumps(a), t) for i, (r, a, t, _) in enumerate(CASES)], "i int, rule string, args string, text string")
    df = df.withColumn("a", F.from_json("args", K.ARGS))
    got = {}
    names = sorted({c[0] for c in CASES})
    for part in (names[:30], names[30:]):  # two smaller expressions
        for r in df.filter(F.col("rule").isin(part)).select("i", K.check(F.col("rule"), F.col("text"), F.col("a"), part).alias("met")).collect():
            got[r["i"]] = r["met"]
    wrong = [(CASES[i][:3], got[i]) for i in range(len(CASES)) if got[i] is not CASES[i][3]]
    assert not wrong


def test_constraint_score(spark):
    label = json.dumps([{"instruction_id": ["punctuation:no_comma", "keywords:existence"], "kwargs": [{}, {"keywords": ["cat"]}]}])
    rows = [("<think>a, b</think> no comma", 0.5), ("<think>x</think> a cat", 1.0), ("<think>x</think>", 0.0), ("", 0.0)]
    df = spark.createDataFrame([(t, label, e) for t, e in rows], "t string, l string, e double")
    got = df.select("e", V.constraints_score(F.col("t"), F.col("l"), ["punctuation:no_comma", "keywords:existence"]).alias("s")).collect()
    assert all(r["e"] == r["s"] for r in got)


def test_whole_text_is_json(spark):
    good = ["{}", '{"a": [1, 2]}', "[1]", "3", '"x"', " null ", '{"a": {"b": "}]"}}']
    bad = ["", "1 2", "[1] [2]", "1] [2", "1, 2", '1, "b": 2', '1} {"v": 2', '{"a": 1} x', "{", "text", "]", "[1]]"]
    df = spark.createDataFrame([(t, t in good) for t in good + bad], "t string, want boolean")
    assert df.filter(X.is_json(F.col("t")) != F.col("want")).collect() == []


def test_every_document_is_judged_whole(spark, tmp_path):
    from chatmill.catalog import queries, rules

    assert all("{t}" in d for d in rules.DRESS)
    n = 4 * len(rules.DRESS)
    texts = [(i, "My answer is yes. So it is, [a] and [b]." if i % 2 else "Nothing of it.") for i in range(n)] + [(n, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["rule"], r["dressed"]): r for r in queries()["constraint_rules_whole"](spark, str(tmp_path)).collect()}
    assert set(got) == {(r, d) for r, _, _ in rules.RULES for d in (False, True)} and all(r["n"] == n for r in got.values())
    for rule in ("detectable_format:constrained_response", "detectable_content:number_placeholders"):
        plain = got[rule, False]
        assert (plain["n_met"], plain["met_ids"]) == (n // 2, sum(range(1, n, 2))) and got[rule, True]["n_met"] >= n // 2


def test_first_word_is_the_first_of_words(spark):
    from chatmill.functions import text as X

    texts = [None, "", " \t\x1c\u3000", "one", " \u2003'The' end", "\n\nÉ x", "a\x1fb", "\u200bz w"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.first_word(F.col("t")).alias("a"), F.get(X.words(F.col("t")), F.lit(0)).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[4]["a"] == "'The'"


def test_rephrased_words_are_counted_among_others(spark):
    t = spark.createDataFrame([("x " * 50 + "The the the of z",), ("and",), ("",)], "t string")
    for low, high, want in ((3, 3, [True, False, False]), (1, 2, [False, True, False]), (0, 0, [False, False, True])):
        args = F.from_json(F.lit(json.dumps({"original_paragraph": "the of and The", "low": low, "high": high})), K.ARGS)
        met = K.check(F.lit("detectable_content:rephrase_paragraph"), F.col("t"), args, ["detectable_content:rephrase_paragraph"])
        assert [r["met"] for r in t.select(met.alias("met")).collect()] == want


# (rule, arguments, text, met): texts whose first words do not decide, and characters whose case or width is odd
_LONG = "Go on. " * 80
LONG_CASES = [
    ("length_constraints:number_sentences", {"num_sentences": 81, "relation": "at least"}, _LONG + "End.", True),
    ("length_constraints:number_sentences", {"num_sentences": 82, "relation": "at least"}, _LONG + "End.", False),
    ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One.　 \x1c", False),
    ("first_word:first_word_sent", {"first_word": "go"}, _LONG + "Go", True),
    ("first_word:first_word_sent", {"first_word": "go"}, _LONG + "We go", False),
    ("last_word:last_word_sent", {"last_word": "on"}, _LONG + "Go (on)", True),
    ("last_word:last_word_sent", {"last_word": "on"}, _LONG + "Go off", False),
    ("last_word:last_word_answer", {"last_word": "end"}, _LONG + "the end. \x1f", True),
    ("keywords:keyword_specific_position", {"keyword": "late", "n": 81, "m": 2}, _LONG + "So late", True),
    ("keywords:keyword_specific_position", {"keyword": "late", "n": 82, "m": 2}, _LONG + "So late", False),
    ("keywords:key_sentences", {"key_sentences": ["So late", "on."], "num_sentences": 1}, _LONG + "So\nlate", True),
    ("detectable_format:sentence_hyphens", {}, "One is here.-Two is here.-" + "Go on.", True),
    ("detectable_format:sentence_hyphens", {}, _LONG + "-End.", False),
    ("detectable_format:sentence_hyphens", {}, "-One.", False),
    ("keywords:no_adjacent_consecutive", {}, "apple cat " * 60 + "egg", True),
    ("keywords:no_adjacent_consecutive", {}, "apple cat " * 60 + "Dog", False),
    ("keywords:no_adjacent_consecutive", {}, "ж з", False),
    ("detectable_format:square_brackets", {}, "[a] " * 200 + "\U0001f600", False),
    ("detectable_format:square_brackets", {}, "[a]　[\U0001f600]", True),
    ("detectable_format:square_brackets", {}, "[", False),
    ("detectable_format:bigram_wrapping", {}, "<<a b>> " * 100 + "<<a b", False),
    ("detectable_format:bigram_wrapping", {}, "<<a", True),
    ("count:count_unique", {}, " ".join(f"w{i}" for i in range(200)), True),
    ("count:count_unique", {}, " ".join(f"w{i}" for i in range(200)) + " w0", False),
    ("keywords:start_end", {}, "Well-known it is, " * 30 + "well-known", True),
    ("keywords:start_end", {}, "known it is well-known", False),
    ("keywords:start_end", {}, "\U0001d400 \U0001d400-x", False),
    ("keywords:start_end", {}, "Σ x σ", True),
    ("change_case:capital_word_frequency", {"capital_frequency": 1, "capital_relation": "at least"}, "a-BC \U00010428-BC b'C xA Ax", False),
    ("change_case:capital_word_frequency", {"capital_frequency": 3, "capital_relation": "at least"}, "\U0001f600-BC A-B' 1 2É 3", True),
    ("copy:copy", {"prompt_to_repeat": "İ end"}, " İ END 　", True),
    ("copy:copy", {"prompt_to_repeat": "the end"}, "the end" + " " * 300 + "x", False),
    ("copy:copy", {"prompt_to_repeat": "the end"}, "the end" + " " * 300, True),
    ("combination:repeat_prompt", {"prompt_to_repeat": "ΑΣ"}, "ΑΣΑ", False),
    ("combination:repeat_prompt", {"prompt_to_repeat": "ΑΣ"}, "ΑΣ Α", True),
    ("keywords:word_count_different_numbers", {"keyword": "kiss", "frequency": 2, "relation": "at least"}, "KIſS, kıss", True),
    ("keywords:word_once", {"keyword": "a.c"}, "xABCx", True),
    ("count:count_increment_word", {"keyword1": "one", "keyword2": "two"}, "ONE Two tWo" + " x" * 400, True),
    ("count:count_increment_word", {"keyword2": "the"}, "THE the", False),
    ("keywords:forbidden_words", {"forbidden_words": ["kiss"]}, "a Kiss", False),
    ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "Cat́", True),
    ("letters:letter_counting2", {"letter": "É", "let_frequency": 2, "let_relation": "less than"}, "é É", False),
    ("letters:letter_counting2", {"letter": "", "let_frequency": 1, "let_relation": "less than"}, "any", True),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "the then été", "low": 3, "high": 3}, "other then, The ÉTÉ the", True),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "the", "low": 0, "high": 0}, "thé bathe \U0001d400the the_", True),
    ("detectable_content:rephrase_paragraph", {"original_paragraph": "...", "low": 0, "high": 0}, "any text", True),
    ("detectable_format:multiple_sections", {"section_spliter": "S.c", "num_sections": 1}, "Sec 1", True),
    ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "\n\n- a - b\n *\n* c", True),
    ("detectable_format:json_format", {}, "　```json {}", True),
    ("change_case:english_lowercase", {}, "été İ", False),
    ("change_case:english_capital", {}, "ÉTÉ é", False),
    ("validate_frequency_capital_words", {"N": 2, "quantifier": "at least"}, "AB \U0001d400C D_ ÉE x F", True),
    ("validate_frequency_capital_words", {"N": 3, "quantifier": "at least"}, "AB \U0001d400C D_ ÉE x F", False),
]


def test_rules_beyond_the_first_words(spark):
    df = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(LONG_CASES)], "i int, t string").withColumns(K.units(F.col("t")))
    of = lambda r, a, given: K.check(F.lit(r), F.col("t"), F.from_json(F.lit(json.dumps(a)), K.ARGS), [r], given)
    for given in (None, {"low": F.col("low"), "begin": F.col("begin")}):
        checks = F.array(*(F.when(F.col("i") == i, of(r, a, given)) for i, (r, a, _, _) in enumerate(LONG_CASES)))
        got = {r["i"]: r["met"] for r in df.select("i", F.get(checks, F.col("i")).alias("met")).collect()}
        assert [LONG_CASES[i][:3] for i in got if got[i] is not LONG_CASES[i][3]] == []


def test_a_text_is_gone_through_once(spark, tmp_path):
    from chatmill.catalog import queries

    planned = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    args = F.from_json(F.lit(json.dumps({"original_paragraph": "the of", "low": 1, "high": 2})), K.ARGS)
    name = "detectable_content:rephrase_paragraph"
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "The end.")], "doc_id long, text string").write.parquet(path)
    # its words are looked for once, though their number is held against two bounds
    assert planned(spark.read.parquet(path).select(K.check(F.lit(name), F.col("text"), args, [name]))).count("regexp_extract_all(lower(text#") == 1
    # what many rules need of a text is a column below them
    for q in ("constraint_rules", "constraint_rules_whole"):
        plan = planned(queries()[q](spark, str(tmp_path)))
        assert plan.count(" AS low#") == plan.count(" AS begin#") == 1


def test_last_word_is_the_last_of_words(spark):
    texts = [None, "", " \t\x1c　", "one", "a  'The' ", "x y　z\x1f", "x y　 ", "a \U0001f600", "a\x1fb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.last_word(F.col("t")).alias("a"), F.get(F.slice(X.words(F.col("t")), -1, 1), F.lit(0)).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[5]["a"] == "z"
