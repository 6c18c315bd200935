"""Chat rendering: one row of a template table per family, one Column expression for all of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatmill.functions import text as X

END = "<|im_end|>\n"
NO_FUNCTIONS = " You do not currently have access to any functions. <functions></functions>"

# Fixed value. Reasoning preamble.
REASONING_PREAMBLE = (
    "A conversation between User and Assistant. "
    "The user asks a question, and the Assistant solves it. "
    "The assistant first thinks about the reasoning process in "
    "the mind and then provides the user with the answer. "
    "The reasoning process and answer are enclosed within <think> </think> "
    "and <answer> </answer> tags, respectively, "
    "i.e., <think> reasoning process here </think> "
    "<answer> answer here </answer>.\n\n"
)
# Fixed value. Sentence put before every message by the boxed-answer variant.
BOXED_REQUEST = (
    "You must put your answer inside <answer> </answer> tags, i.e., <answer> answer here </answer>. "
    "And your final answer will be extracted automatically by the \\boxed{} tag. This is the problem: "
)
# Fixed values. Step-by-step preambles with the reminders that end the prompt.
ANSWER_LINE = (
    "Solve the following problem step by step. The last line of your response should be the answer to the "
    "problem in form Answer: $Answer (without quotes) where $Answer is the answer to the problem.\n\n"
)
ANSWER_LINE_REMINDER = '\nRemember to put your answer on its own line after "Answer:"'
CODE_BLOCK = (
    "Solve the following code problem step by step. The last part of your response should be the solution to the "
    "problem in form ```\npython\nCODE\n``` where CODE is the solution for the problem.\n\n"
)
CODE_BLOCK_REMINDER = "\nRemember to put your solution inside the ```\npython\nCODE\n``` tags"


@dataclass(frozen=True)
class Template:
    """``wrap`` maps a role to (prefix, suffix); roles that are not listed render to nothing unless
    ``any_role`` gives the wrap of every message. ``{Role}`` in a prefix is the capitalised role."""

    wrap: dict[str, tuple[str, str]] = field(default_factory=dict)
    any_role: tuple[str, str] | None = None
    preamble: str = ""
    separator: str = ""
    eos_roles: tuple[str, ...] = ()  # eos follows these roles' content
    eos_after_last: bool = False  # eos follows the last message unless a generation prompt is asked for
    after_eos: str = ""  # between messages, after eos
    after_last_eos: str = ""
    generation: str = ""
    thinking: str = "keep"  # keep | last_only: drop all thinking | intermediate: drop it from earlier turns
    default_system: str | None = None
    functions: bool = False


_TAGS = {"system": ("<|system|>\n", "\n"), "user": ("<|user|>\n", "\n"), "assistant": ("<|assistant|>\n", "")}
_TAGS_EOS = {r: (f"<|{r}|>\n", "") for r in ("user", "system", "assistant")}
_IM = {r: (f"<|im_start|>{r}\n", END) for r in ("system", "user", "environment")} | {"assistant": ("<|im_start|>assistant\n", "")}
_LABEL = ("{Role}: ", "\n")
_IM_BASE = dict(wrap=_IM, eos_roles=("assistant",), after_eos=END, functions=True)
DEFAULT_SYSTEM = "You are a helpful AI assistant."

TEMPLATES: dict[str, Template] = {
    "concat_space": Template(any_role=("", ""), separator=" ", eos_after_last=True),
    "concat_newline": Template(any_role=("", ""), separator="\n", eos_after_last=True),
    "role_labels": Template(any_role=("{Role}: ", ""), separator="\n\n", eos_after_last=True),
    "assistant_only": Template(wrap={"assistant": ("", "")}),
    "tags_eos": Template(wrap=_TAGS_EOS, eos_roles=("user", "system", "assistant"), after_eos="\n", after_last_eos="\n", generation="<|assistant|>\n"),
    "tags": Template(wrap=_TAGS, eos_roles=("assistant",), after_eos="\n", generation="<|assistant|>\n"),
    "tags_think": Template(wrap=_TAGS, eos_roles=("assistant",), after_eos="\n", generation="<|assistant|>\n<think>"),
    "tags_reasoning": Template(
        wrap=_TAGS, eos_roles=("assistant",), after_eos="\n", generation="<|assistant|>\n<think>", preamble=REASONING_PREAMBLE, thinking="last_only"
    ),
    "im": Template(**_IM_BASE, default_system=DEFAULT_SYSTEM + NO_FUNCTIONS, generation="<|im_start|>assistant\n"),
    "im_plain_system": Template(**_IM_BASE, default_system=DEFAULT_SYSTEM, generation="<|im_start|>assistant\n"),
    "im_think": Template(**_IM_BASE, default_system=DEFAULT_SYSTEM, generation="<|im_start|>assistant\n<think>"),
    "im_think_functions": Template(**_IM_BASE, default_system=DEFAULT_SYSTEM + NO_FUNCTIONS, generation="<|im_start|>assistant\n<think>"),
    "im_drop_earlier_thinking": Template(
        **_IM_BASE, default_system=DEFAULT_SYSTEM, thinking="intermediate", generation="<|im_start|>assistant\n<think>"
    ),
    "answer_line": Template(any_role=("", "\n"), separator="\n\n", preamble=ANSWER_LINE, generation=ANSWER_LINE_REMINDER),
    "code_block": Template(any_role=("", "\n"), separator="\n\n", preamble=CODE_BLOCK, generation=CODE_BLOCK_REMINDER),
    "reasoning": Template(any_role=_LABEL, separator="\n\n", preamble=REASONING_PREAMBLE, generation="Assistant:"),
    "reasoning_think": Template(any_role=_LABEL, separator="\n\n", preamble=REASONING_PREAMBLE, generation="Assistant: <think>"),
    "reasoning_boxed": Template(
        any_role=("{Role}: " + BOXED_REQUEST, "\n"), separator="\n\n", preamble=REASONING_PREAMBLE, generation="Assistant: <think>"
    ),
}


def _capitalised(role: Column) -> Column:
    return F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substring(role, 2, 1 << 30)))


def message_content(t: Template, m: Column, last: Column) -> Column:
    c = F.coalesce(m["content"], F.lit(""))
    if t.thinking == "last_only":
        return F.when(m["role"] == "assistant", X.after_last(c, "</think>")).otherwise(c)
    if t.thinking == "intermediate":
        both = c.contains("</think>") & c.contains("<think>")
        stripped = F.regexp_replace(X.after_last(c, "</think>"), r"\A\n+", "")
        return F.when((m["role"] == "assistant") & ~last & both, stripped).otherwise(c)
    return c


def render_message(t: Template, m: Column, i: Column, n: Column, eos: str, generation: bool, fields: set[str]) -> Column:
    """Text of message ``i`` of ``n``, separators and eos included."""
    last, content = i == n - 1, message_content(t, m, i == n - 1)
    eos_text = F.lit(eos)

    def one(role_prefix: str, suffix: str, role: str | None) -> Column:
        if "{Role}" in role_prefix:
            before, after = role_prefix.split("{Role}")
            parts = [F.lit(before), _capitalised(m["role"]), F.lit(after), content]
        else:
            parts = [F.lit(role_prefix), content]
        if t.functions and role == "system":
            none = F.lit(NO_FUNCTIONS)
            parts.append(F.coalesce(F.concat(F.lit(" <functions>"), m["functions"], F.lit("</functions>")), none) if "functions" in fields else none)
        if t.functions and role == "user" and "functions" in fields:
            parts.append(F.coalesce(F.concat(F.lit("\n<functions>"), m["functions"], F.lit("</functions>")), F.lit("")))
        if t.functions and role == "assistant" and "function_calls" in fields:
            parts.append(F.coalesce(F.concat(F.lit("<function_calls>"), m["function_calls"], F.lit("</function_calls>")), F.lit("")))
        if role in t.eos_roles:
            if t.functions:  # closed by the end marker between turns, by eos at the end
                parts.append(F.when(last, eos_text).otherwise(F.lit(t.after_eos)))
            else:
                parts += [eos_text, F.when(last, F.lit(t.after_last_eos)).otherwise(F.lit(t.after_eos))]
        parts.append(F.lit(suffix))
        return F.concat(*parts)

    if t.any_role is not None:
        body = one(t.any_role[0], t.any_role[1], None)
    else:
        body = F.lit("")
        for role, (prefix, suffix) in t.wrap.items():
            body = F.when(m["role"] == role, one(prefix, suffix, role)).otherwise(body)
    if t.separator:
        body = F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(t.separator)), body)
    if t.eos_after_last and not generation:
        body = F.concat(body, F.when(last, eos_text).otherwise(F.lit("")))
    return body


def head_text(messages: Column, t: Template, default_system: str | None = None) -> Column:
    """Preamble, and the default system turn of conversations that have none."""
    system = default_system if default_system is not None else t.default_system
    if system is None:
        return F.lit(t.preamble)
    own = F.exists(messages, lambda m: m["role"] == "system")
    return F.concat(F.lit(t.preamble), F.when(own, F.lit("")).otherwise(F.lit("<|im_start|>system\n" + system + END)))


def render_chat(
    messages: Column,
    template: str | Template,
    eos: str = "<|endoftext|>",
    add_generation_prompt: bool = False,
    fields: tuple[str, ...] = ("role", "content"),
    default_system: str | None = None,
) -> Column:
    """Whole conversation as one string."""
    t = TEMPLATES[template] if isinstance(template, str) else template
    n = F.size(messages)
    body = F.array_join(F.transform(messages, lambda m, i: render_message(t, m, i, n, eos, add_generation_prompt, set(fields))), "")
    parts = [head_text(messages, t, default_system), body]
    if add_generation_prompt and t.generation:
        parts.append(F.when(n > 0, F.lit(t.generation)).otherwise(F.lit("")))
    return F.concat(*parts)
