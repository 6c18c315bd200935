"""Projections from raw record shapes to one ``messages`` schema, and edits of message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions import text as X
from chatmill.functions.arrays import indices, last, let
from chatmill.functions.rand import hash_int, hash_key, hash_unit
from chatmill.functions.wordlists import INSTRUCTION_WITH_INPUT, ROLE_NAMES, SPECIAL_TOKENS
from chatmill.operators.ordering import dense_index, top_n_per_key
from chatmill.schema import MESSAGES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), _c(content).alias("content"))


def from_pair(user, assistant) -> Column:
    return F.array(message("user", user), message("assistant", assistant))


def fill(template: str, **values) -> Column:
    """Literal template with {name} slots as a concat; unlike replace, filled text is never rescanned."""
    parts, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, key = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(_c(values[key]))
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def from_instruction_input_output(instruction="instruction", input="input", output="output") -> Column:
    return from_pair(fill(INSTRUCTION_WITH_INPUT, instruction=instruction, input=input), _c(output))


def from_system_question_response(system="system_prompt", question="question", response="response") -> Column:
    return F.array(message("system", system), message("user", question), message("assistant", response))


def _role_map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def from_conversations(conversations="conversations", names: dict[str, str] = ROLE_NAMES, on_unknown: str = "raise") -> Column:
    """Rename from/value to role/content. An unknown sender raises, or nulls the conversation."""
    conv, roles = _c(conversations), _role_map(names)
    unknown = F.exists(conv, lambda m: ~m["from"].isin(list(names)))
    renamed = F.transform(conv, lambda m: message(F.element_at(roles, m["from"]), m["value"]))
    bad = F.raise_error(F.lit("unknown sender in conversation")).cast(MESSAGES) if on_unknown == "raise" else F.lit(None).cast(MESSAGES)
    return F.when(unknown, bad).otherwise(renamed)


def from_alternating_list(turns) -> Column:
    """Even positions are user turns; an odd-length list loses its last item."""
    t = _c(turns)
    even = F.slice(t, F.lit(1), F.size(t) - F.size(t) % 2)
    return F.transform(even, lambda x, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), x))


def from_transcript(text) -> Column:
    """``\\n\\nHuman: …\\n\\nAssistant: …`` transcripts. Each marker of one kind is paired with the
    marker of the other kind of the same rank; unpaired markers stay inside the text."""
    c = _c(text)
    human, assistant = "\n\nHuman: ", "\n\nAssistant: "

    def offsets(pieces, marker):
        # the k-th marker starts after k pieces and k-1 markers
        ends = F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, p: F.struct(
                (s["at"] + F.length(p) + len(marker)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out")
            ),
            lambda s: s["out"],
        )
        return ends

    def turns(cuts):
        def one(i):
            skip = F.when(i % 2 == 0, len(human)).otherwise(len(assistant))
            start, end = F.get(cuts, i) + skip, F.get(cuts, i + 1)
            return message(F.when(i % 2 == 0, "user").otherwise("assistant"), c.substr(start + 1, F.greatest(F.lit(0), end - start)))

        return F.transform(indices(F.size(cuts) - 1), one)

    h, a = F.split(c, r"\Q" + human + r"\E"), F.split(c, r"\Q" + assistant + r"\E")
    rounds = F.least(F.size(h), F.size(a)) - 1
    pairs = F.zip_with(
        F.slice(offsets(h, human), F.lit(1), rounds), F.slice(offsets(a, assistant), F.lit(1), rounds), lambda x, y: F.array(x, y)
    )
    return let(F.concat(F.flatten(pairs), F.array(F.length(c))), turns)


def from_marked_rounds(text, user_marker: str = "[|Human|]", assistant_marker: str = "[|AI|]") -> Column:
    """Rounds that have both markers, trimmed; text before the first user marker is ignored."""
    c = _c(text)
    rounds = F.split(c, r"\Q" + user_marker + r"\E")
    rounds = F.filter(F.slice(rounds, F.lit(2), F.size(rounds)), lambda r: r.contains(assistant_marker))
    return F.flatten(
        F.transform(
            rounds,
            lambda r: F.array(
                message("user", X.strip(X.before_first(r, assistant_marker))),
                message("assistant", X.strip(F.get(F.split(r, r"\Q" + assistant_marker + r"\E"), F.lit(1)))),
            ),
        )
    )


def append_turn(messages, role: str, content) -> Column:
    return F.concat(_c(messages), F.array(message(role, content)))


def chosen_as_messages(chosen="chosen") -> Column:
    return _c(chosen)


def to_messages(df: DataFrame, names: dict[str, str] = ROLE_NAMES) -> DataFrame:
    """Add ``messages`` by the first record shape the columns match; no-op when already there."""
    have = set(df.columns)
    if "messages" in have:
        return df
    shapes = [
        ({"instruction", "output"}, lambda: from_instruction_input_output()),
        ({"prompt", "completion"}, lambda: from_pair("prompt", "completion")),
        ({"conversations"}, lambda: from_conversations("conversations", names)),
        ({"question", "response"}, lambda: from_system_question_response()),
        ({"query", "answer"}, lambda: from_pair("query", "answer")),
        ({"query", "response"}, lambda: from_pair("query", "response")),
        ({"chosen", "rejected", "reference_completion"}, lambda: chosen_as_messages()),
    ]
    for needed, projection in shapes:
        if needed <= have:
            return df.withColumn("messages", projection())
    raise ValueError(f"no converter for columns {sorted(have)}")


def convert_sft(df: DataFrame, messages: Column, filters=(), keep=("id",), source: str | None = None) -> DataFrame:
    """Projection to ``messages``, then each filter (DataFrame → DataFrame) in order."""
    out = df.select(*[c for c in keep if c in df.columns], messages.alias("messages"))
    if source is not None:
        out = tag_source(out, source)
    for f in filters:
        out = out.transform(f)
    return out


# -- prompts --------------------------------------------------------------------------------------


def prompt_newline_rule(prompt) -> Column:
    c = _c(prompt)
    return F.when(c.endswith("\n") | X.strip(c).endswith(":"), c).otherwise(F.concat(c, F.lit("\n")))


def few_shot_prompt(queries: DataFrame, exemplars: DataFrame, task: str, k: int, seed, ids: str, constant_prefix: str = "") -> DataFrame:
    """Prefix k sampled exemplars (input, output) per task and add the query's input. Only k rows per
    task leave the exemplar table, so it stays a small table of one row per task."""
    picked = top_n_per_key(exemplars, task, k, [hash_key(seed, ids), F.col(ids)])
    block = F.concat(F.lit("Input:\n"), X.strip(F.col("input")), F.lit("\nOutput:\n"), X.strip(F.col("output")), F.lit("\n\n"))
    shots = picked.groupBy(task).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(hash_key(seed, ids).alias("h"), F.col(ids).alias("i"), block.alias("b")))), lambda s: s["b"]), "").alias("_shots")
    )
    joined = queries.join(shots, task, "left")
    head = F.lit(constant_prefix) if constant_prefix else F.concat(X.strip(F.col("instruction")), F.lit("\n\n"))
    return joined.withColumn(
        "prompt", F.concat(head, F.coalesce("_shots", F.lit("")), F.lit("Input:\n"), X.strip(F.col("input")), F.lit("\nOutput:\n"))
    ).drop("_shots")


def weighted_template(templates: list[tuple[str, float]], seed, ids, **values) -> Column:
    """Pick a template by weight from the row's hash and fill its {name} slots."""
    total, edge = sum(w for _, w in templates), 0.0
    u, out = hash_unit(seed, ids), None
    for text, weight in templates:
        edge += weight / total
        filled = fill(text, **{k: X.strip(_c(v)) for k, v in values.items()})
        out = F.when(u < edge, filled) if out is None else out.when(u < edge, filled)
    return out.otherwise(filled)


def weighted_instruction(with_input, without_input, seed, ids, instruction="instruction", input="input") -> Column:
    """Template family depends on whether the input is blank."""
    return F.when(X.is_blank(_c(input)), weighted_template(without_input, seed, ids, instruction=instruction)).otherwise(
        weighted_template(with_input, seed, ids, instruction=instruction, input=input)
    )


def instruction_prompt(instruction="instruction", input="input") -> Column:
    i, x = X.strip(_c(instruction)), X.strip(_c(input))
    return F.when(X.is_blank(_c(input)), F.concat(i, F.lit("\n\n"))).otherwise(F.concat(i, F.lit("\n\n"), x, F.lit("\n\n")))


def gt_after_hashes(c) -> Column:
    return X.strip(X.after_last(_c(c), "####"))


def gt_aliases(c) -> Column:
    return F.to_json(_c(c))


def gt_last_boxed(c) -> Column:
    from chatmill.functions.mathtext import last_boxed

    return last_boxed(_c(c))


def make_verifiable(df: DataFrame, question: Column, ground_truth: Column, verifier: str) -> DataFrame:
    return df.select(
        F.array(message("user", question)).alias("messages"), ground_truth.alias("ground_truth"), F.lit(verifier).alias("dataset")
    )


def multiple_choice(correct, wrongs: list) -> tuple[Column, Column]:
    """(letter of the correct choice, rendered ``A: …`` list); choices sorted without regard to case,
    in the given order among equals."""
    options = F.array(*[F.struct(F.lower(_c(c)).alias("k"), F.lit(i).alias("i"), _c(c).alias("v")) for i, c in enumerate([correct, *wrongs])])
    ordered = F.transform(F.sort_array(options), lambda o: o["v"])
    letter = F.char(F.lit(64) + F.array_position(ordered, _c(correct)))
    shown = F.array_join(F.transform(ordered, lambda v, i: F.concat(F.char(F.lit(65) + i), F.lit(": "), v)), ", ")
    return letter, shown


def length_target(low: int, high: int, seed, ids) -> Column:
    """Uniform integer in [low, high) from the row's hash."""
    return F.pmod(hash_int(seed, ids), F.lit(high - low)) + low


def length_constraint(problem, answer, target: Column, mode: str = "budget") -> tuple[Column, Column, Column]:
    """(prompt, ground truths, verifiers). ``budget``: appended upper limit with both ground truths in
    one string; ``length``: target only; ``answer_length``: answer and target with two verifiers."""
    n = target.cast("string")
    think = F.concat(
        X.strip(_c(problem)), F.lit(" Let's think step by step and output the final answer within \\boxed{}. Think for "), n, F.lit(" tokens.")
    )
    if mode == "budget":
        return F.concat(_c(problem), F.lit("\nUse no more than "), n, F.lit(" tokens.")), F.array(F.concat(_c(answer), F.lit("<sep>"), n)), F.array(F.lit("MATH,max_length"))
    if mode == "length":
        return think, F.array(n), F.array(F.lit("max_length"))
    return think, F.array(_c(answer), n), F.array(F.lit("math"), F.lit("max_length"))


# -- reasoning tags -------------------------------------------------------------------------------


def think_format(messages, open_token="<|reserved_special_token_246|>", close_token="<|reserved_special_token_247|>") -> Column:
    """Reserved tokens to think/answer tags; an opened answer is closed at the end of its message."""

    def fix(m):
        c = X.replace_all(m["content"], [(open_token, "<think>"), (close_token, "</think><answer>")])
        return message(m["role"], F.when(c.contains("<answer>"), F.concat(c, F.lit("</answer>"))).otherwise(c))

    return F.transform(_c(messages), fix)


def answer_after_think(messages) -> Column:
    return X.replace_all(X.after_last(last(_c(messages))["content"], "</think>"), [("<answer>", ""), ("</answer>", "")])


def think_from_parts(df: DataFrame, question: str, reasoning: str, answer: str) -> DataFrame:
    """Build thinking conversations; rows with a null or empty part are dropped."""
    ok = F.lit(True)
    for c in (question, reasoning, answer):
        ok = ok & (F.length(c) > 0)
    body = F.concat(F.lit("<think>"), F.col(reasoning), F.lit("</think><answer>"), F.col(answer), F.lit("</answer>"))
    return df.filter(ok).withColumn("messages", from_pair(question, body)).withColumn("ground_truth", F.col(answer))


def edit_last(messages, edit) -> Column:
    """Apply ``edit`` to the content of the last message."""
    m = _c(messages)
    n = F.size(m)
    return F.transform(m, lambda x, i: message(x["role"], F.when(i == n - 1, edit(x["content"])).otherwise(x["content"])))


def _newline_after_think(c: Column) -> Column:
    return F.when(c.contains("</think>\n"), c).otherwise(F.replace(c, F.lit("</think>"), F.lit("</think>\n")))


def add_answer_text(c: Column) -> Column:
    c = _newline_after_think(c)
    c = F.when(c.contains("<answer>"), c).otherwise(F.replace(c, F.lit("</think>"), F.lit("</think>\n<answer>")))
    return F.when(c.endswith("</answer>"), c).otherwise(F.concat(c, F.lit("\n</answer>")))


def remove_answer_text(c: Column) -> Column:
    return _newline_after_think(X.strip(X.replace_all(c, [("<answer>", ""), ("</answer>", "")])))


def add_answer(messages="messages") -> Column:
    return edit_last(messages, add_answer_text)


def remove_answer(messages="messages") -> Column:
    return edit_last(messages, remove_answer_text)


def strip_special_tokens(c) -> Column:
    return X.replace_all(_c(c), SPECIAL_TOKENS)


def strip_special_tokens_in(structs, fields: list[str], edited: list[str]) -> Column:
    """The same on string fields of an array of structs."""
    return F.transform(_c(structs), lambda s: F.struct(*[(strip_special_tokens(s[f]) if f in edited else s[f]).alias(f) for f in fields]))


# -- text forms -----------------------------------------------------------------------------------


def messages_to_text(messages, style: str = "labels") -> Column:
    """``labels``: 'User: …' blocks with special tokens stripped and empty messages skipped;
    ``lines``: 'role: content'; ``sides``: 'User A'/'User B' lines."""
    m = _c(messages)
    if style == "lines":
        return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    if style == "sides":
        return F.array_join(
            F.transform(m, lambda x: F.concat(F.when(x["role"] == "user", "User A: ").otherwise("User B: "), X.strip(x["content"]))), "\n"
        )
    role = lambda x: F.lower(x["role"])
    label = lambda x: (
        F.when(role(x).isin("user", "human"), "User")
        .when(role(x).isin("assistant", "ai"), "Assistant")
        .otherwise(F.concat(F.upper(F.substring(role(x), 1, 1)), F.substring(role(x), 2, 1 << 30)))
    )
    full = F.filter(m, lambda x: F.length(x["content"]) > 0)
    return F.array_join(F.transform(full, lambda x: F.concat(label(x), F.lit(": "), strip_special_tokens(x["content"]))), "\n\n")


def split_prompt(messages, mode: str = "last_if_assistant", system_override: str | None = None) -> Column:
    """Prompt part of a conversation: all but the last message when there are several, or only when
    the last is an assistant's. An override replaces a leading system message or is put first."""
    m = _c(messages)
    drop = F.size(m) > 1
    if mode == "last_if_assistant":
        drop = drop & (F.element_at(m, -1)["role"] == "assistant")
    prompt = F.when(drop, F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m)
    if system_override is None:
        return prompt
    rest = F.when(F.get(prompt, F.lit(0))["role"] == "system", F.slice(prompt, F.lit(2), F.size(prompt))).otherwise(prompt)
    return F.concat(F.array(message("system", F.lit(system_override))), rest)


def fill_placeholders(messages, values: dict[str, str | None], system: str | None = None) -> Column:
    """Replace placeholders in every message; add the system prompt only where there is none; skip
    messages without role or content."""
    pairs = [(k, v) for k, v in values.items() if v is not None]
    m = F.filter(_c(messages), lambda x: x["role"].isNotNull() & x["content"].isNotNull())
    out = F.transform(m, lambda x: message(x["role"], X.replace_all(x["content"], pairs)))
    if system is None:
        return out
    for k, v in pairs:
        system = system.replace(k, v)
    first = F.array(message("system", F.lit(system)))
    return F.when(F.exists(_c(messages), lambda x: x["role"] == "system"), out).otherwise(F.concat(first, out))


def normalise_verifier_lists(df: DataFrame, columns=("ground_truth", "dataset")) -> DataFrame:
    """Scalar verifier and ground truth to one-element arrays."""
    scalar = df.schema[columns[1]].dataType.typeName() != "array"
    return df.withColumns({c: F.array(F.col(c)) for c in columns}) if scalar else df


def resolve_tools(definitions, tools) -> Column:
    """Definitions the row names; all when it names none; null when none match."""
    d, t = _c(definitions), _c(tools)
    named = F.filter(d, lambda x: F.array_contains(t, x["name"]))
    return F.when(t.isNull(), d).when(F.size(named) > 0, named)


def merge_env_config(base: dict[str, str], row) -> Column:
    """Row entries override base entries; the base applies only when it names an environment."""
    r = _c(row)
    empty = F.create_map().cast("map<string,string>")
    if "env_name" not in base:
        return r
    b = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    own = F.coalesce(r, empty)
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(own, k)), own)


def extract_code(text, default: str | None = None) -> Column:
    """Last fenced block; else ``default``, or the whole text."""
    c = _c(text)
    return F.coalesce(X.last_code_block(c), c if default is None else F.lit(default))


def describe_problem(description, input_format=None, output_format=None, examples=None, note=None) -> Column:
    """Question text from optional parts; null without a description. Null or empty parts are left out."""

    def part(head, c):
        return F.lit("") if c is None else F.when(F.length(_c(c)) > 0, F.concat(F.lit(f"\n\n{head}\n\n"), _c(c))).otherwise(F.lit(""))

    shown = F.lit("")
    if examples is not None:
        e = _c(examples)
        one = lambda x: F.concat(
            F.coalesce(F.concat(F.lit("\n\nInput\n\n"), x["input"]), F.lit("")), F.coalesce(F.concat(F.lit("\n\nOutput\n\n"), x["output"]), F.lit(""))
        )
        shown = F.when(F.size(e) > 0, F.concat(F.lit("\n\nExamples"), F.array_join(F.transform(e, one), ""))).otherwise(F.lit(""))
    d = _c(description)
    return F.when(F.length(d) > 0, F.concat(d, part("Input", input_format), part("Output", output_format), shown, part("Note", note)))


def strip_prompt_markers(c) -> Column:
    return X.strip(F.regexp_replace(F.regexp_replace(X.strip(_c(c)), r"\AHuman:", ""), r"Assistant:\z", ""))


def quoted_context(question, quotes, kind: str = "list") -> Column:
    """Question followed by its extracts: given text, or a numbered list."""
    q = _c(quotes)
    body = q if kind == "text" else F.array_join(F.transform(q, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n\n")
    return F.concat(_c(question), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def render_judge_prompts(df: DataFrame, aspects: dict[str, str], instruction: str, completions: str) -> DataFrame:
    """One row per aspect: the aspect's template with {instruction} and numbered {completions}."""
    texts = F.array_join(F.transform(F.col(completions), lambda x, i: F.concat(F.lit("<text "), (i + 1).cast("string"), F.lit("> "), x)), "\n")
    rows = F.array(
        *[F.struct(F.lit(a).alias("aspect"), fill(t, instruction=instruction, completions=texts).alias("prompt")) for a, t in aspects.items()]
    )
    return df.withColumn("_a", F.explode(rows)).select("*", "_a.*").drop("_a")


def split_shared_prefix(a, b) -> tuple[Column, Column, Column]:
    """(longest common prefix, rest of a, rest of b). The length is found by bisection on prefixes, so
    the work is about one pass over the shorter text."""
    x, y = _c(a), _c(b)
    most = F.least(F.length(x), F.length(y))
    start = F.struct(F.lit(0).alias("lo"), most.alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = x.substr(F.lit(1), mid) == y.substr(F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(most + 2)).cast("int"))
    n = F.aggregate(rounds, start, lambda s, r: F.when(s["lo"] < s["hi"], step(s, r)).otherwise(s), lambda s: s["lo"])
    rest = lambda c: c.substr(n + 1, F.length(c))
    return x.substr(F.lit(1), n), rest(x), rest(y)


# -- columns and identity -------------------------------------------------------------------------


def align_columns(tables: list[DataFrame], keep: list[str]) -> DataFrame:
    """Union of the kept columns, missing ones null, cast to the first table's types."""
    first = tables[0]
    types = {f.name: f.dataType for t in reversed(tables) for f in t.schema.fields}
    out = None
    for t in tables:
        row = t.select(*[(F.col(c) if c in t.columns else F.lit(None)).cast(types[c]).alias(c) for c in keep if c in types])
        out = row if out is None else out.unionByName(row)
    return out if out is not None else first


def select_rename(df: DataFrame, drop=(), rename: dict[str, str] | None = None, select=None) -> DataFrame:
    df = df.drop(*drop).withColumnsRenamed(rename or {})
    return df.select(*select) if select else df


def tag_source(df: DataFrame, name: str, column: str = "source") -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(name))


def ensure_id(df: DataFrame, name: str, order_by, column: str = "id", split: str | None = None) -> DataFrame:
    """Positional ids ``{name}_{i}`` (or ``{name}_{i}_{split}``) where the table has none."""
    if column in df.columns:
        return df
    tail = [F.lit(split)] if split else []
    return dense_index(df, order_by, "_i").withColumn(column, F.concat_ws("_", F.lit(name), F.col("_i").cast("string"), *tail)).drop("_i")


def hash_id(text) -> Column:
    return F.sha2(_c(text), 256)
