"""Secret scan through a trigram inverted index.

Every rule's expression gives a Boolean trigram query (``trigrams``). Texts are indexed in blocks: a block posts, under each
trigram that some rule asks for, the rows that hold it; a rule's query intersects and unites those postings, and only the
rows left are searched with the expression itself. Rules without a mandatory trigram search every row. The index is split
by documents, so a block is built, asked and dropped where its texts are read: nothing is shuffled, and a trigram that
a third of all texts hold is a list of one block's rows.

A rule's matches are its expression's leftmost, non-overlapping ones in the whole text; those whose ``group`` is shorter than
``least`` are dropped after matching. Spans are code points, end exclusive, ordered by start, then by rule. Null and empty
texts have no spans; repeated rows and null ids are scanned like others; an empty table gives no rows; extra columns are
kept, and a column named as the new one makes that ``_secrets``. Expressions with an unbounded part after a frequent start take time by the square of a text; the rules here bound it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import LOWER, append_columns, blocks, fresh
from chatmill.llm.trigrams import Vocabulary, candidates, query_of

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that ``group`` must have
    group: int = 0


def any_case(word: str) -> str:
    """The word with every letter in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# fixed values: the contract's rules
NAMES = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), f"{any_case('api')}_?{any_case('key')}"])
BASE = [
    Rule("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # whole runs: shorter ones are dropped
]
# further kinds of credentials with public formats
MORE = [
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,500}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/@]{1,100}@"),
]
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII)) for r in rules]
        self.queries = [query_of(r.pattern) for r in rules]
        self.vocabulary = Vocabulary(self.queries)

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        """The spans of each text."""
        out: list[list[tuple[int, int, str, int]]] = [[] for _ in range(len(texts))]
        for lo, hi, data, offsets in blocks(texts):
            postings = self.vocabulary.postings(LOWER[data], offsets)
            text: dict[int, str] = {}
            for k, (query, (rule, expression)) in enumerate(zip(self.queries, self.rules)):
                for row in candidates(query, postings, hi - lo).tolist():
                    if row not in text:
                        text[row] = texts[lo + row].as_py() or ""
                    for m in expression.finditer(text[row]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            out[lo + row].append((m.start(), k, rule.kind, m.end()))
        return [[{"kind": kind, "start": a, "end": b} for a, _, kind, b in sorted(x)] for x in out]


def find(docs: DataFrame, rules: Sequence[Rule] = tuple(RULES), text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` plus, under ``name``, the spans of all rules: array of (kind, start, end)."""
    rules, kept, (name,) = list(rules), [], fresh(docs, name)

    def per_batch(texts: pa.Array) -> list[pa.Array]:
        if not kept:
            kept.append(Scanner(rules))
        return [pa.array(kept[0].scan(texts), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return append_columns(docs, text, [T.StructField(name, SPANS)], per_batch)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def mask(docs: DataFrame, rules: Sequence[Rule] = tuple(RULES), text: str = "text", sign: str = "*") -> DataFrame:
    """``docs`` with every character of a secret replaced by ``sign``."""
    (name,) = fresh(docs, "_secrets")
    found = find(docs, rules, text, name)
    t, at = F.col(f"`{text}`"), F.col(name)
    covered = F.aggregate(
        at,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            F.concat(a["done"], F.when(s["start"] > a["end"], F.substring(t, (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int"))).otherwise(""),
                     F.repeat(F.lit(sign), F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0)).cast("int"))).alias("done"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )
    masked = F.concat(covered["done"], F.substring(t, (covered["end"] + 1).cast("int"), F.char_length(t)))
    return found.select(*[F.when(F.size(name) > 0, masked).otherwise(t).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
