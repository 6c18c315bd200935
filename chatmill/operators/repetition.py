"""Repeated paragraphs, sentences and n-grams inside one text.

Everything is computed inside the row that holds the text: units are sorted with their positions, units
that occur once are dropped at once, and only the repeated ones reach the rules; a text without enough repeats is told by
one hash pass. N-grams are compared as numbers, a batch of texts at a time. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.functions import text as X
from chatmill.functions.arrays import computed_once, group_starts, indices, last, let

# Fixed values. Any of these characters marks math or code.
MATH_SYMBOLS = r"[=+\-*/^()\[\]{}<>|&~!@#$%\\]"
# Fixed values. Code fragments that are not counted as repetition; anchored, without regard to case.
CODE_LINE = (
    r"(?iU)^(?:import\s+|from\s+\w+\s+import|return\s+|\w+\s*\+\s*=\s*\d+|\w+\s*-\s*=\s*\d+|\w+\s*\*\s*=\s*\d+"
    r"|\w+\s*/\s*=\s*\d+|for\s+|while\s+|if\s+|def\s+|class\s+|\w+\.\w+\(|\w+\s*=\s*\w+\()"
)
OPEN_UNCLOSED, CLOSE_UNOPENED = r"[\(\[\{][^\)\]\}]*$", r"^[^\(\[\{]*[\)\]\}]"
MATCHED_BRACKETS = r"[\(\[\{][^\(\[\{\)\]\}]*[\)\]\}]"
# Fixed values. Expressions that are not counted as repetition.
COMPLEX_MATH = (
    r"(?U)math\.\w+\([^)]*\)|\w+\*\*[0-9]+|[0-9]+\s*[+\-*/]\s*[0-9]+|[a-zA-Z_]\w*\s*[+\-*/]\s*[a-zA-Z_]\w*"
    r"|def\s+\w+\([^)]*\):|lambda\s+[^:]+:|\[[^\]]*for[^\]]*\]|\{[^}]*for[^}]*\}|\([^)]*for[^)]*\)"
)
# Fixed values. Short phrases whose scattered repetition is harmless.
SHORT_PHRASES = [
    "not sure", "wait no", "i think", "maybe", "probably", "yes", "no", "ok", "okay", "right", "wrong", "correct",
    "incorrect", "true", "false", "good", "bad", "nice", "great", "awesome", "terrible", "wow", "oh", "hmm", "um", "uh",
    "well", "so", "now", "then", "here", "there", "this", "that", "these", "those", "it", "is", "are", "was", "were",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "can", "cannot", "cant", "dont",
    "doesnt", "isnt", "arent", "second < b", "we can use:", "we can use", "first < a", "third < c", "fourth < d",
    "a < b", "b < c", "c < d", "d < e", "e < f", "f < g", "g < h", "x < y", "y < z", "i < j", "j < k", "k < l", "l < m",
    "m < n", "n < o", "o < p", "p < q", "q < r", "r < s", "s < t", "t < u", "u < v", "v < w", "w < x",
    "return none", "return true", "return false", "return 0", "return 1", "return -1", "return null", "return undefined",
]
COMPARISON = r"(?U)^\w+\s*[<>]\s*\w+$"
CODE_WORDS = "import|from|return|def|class|if|for|while"
# Fixed values. Words that open paragraphs so often that their repetition says nothing.
TRANSITION_WORDS = ["alternatively,", "therefore,", "however,"]


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SLICE_WORDS = 200_000  # whose n-grams are compared at once


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_math_or_code(c: Column) -> Column:
    # every code pattern of the rule contains one of the symbols, so the symbol test decides
    return c.rlike(MATH_SYMBOLS)


def is_code_line(c: Column) -> Column:
    unmatched = (c.rlike(OPEN_UNCLOSED) | c.rlike(CLOSE_UNOPENED)) & ~c.rlike(MATCHED_BRACKETS)
    return unmatched | c.rlike(CODE_LINE)


def is_complex_math(c: Column) -> Column:
    return c.rlike(COMPLEX_MATH)


def is_transition_word(c: Column) -> Column:
    return F.lower(c).isin(TRANSITION_WORDS)


def is_short_phrase(c: Column, mode: str = "substring") -> Column:
    low = F.lower(c)
    listed = X.literal_any(c, SHORT_PHRASES) if mode == "substring" else low.isin(SHORT_PHRASES)
    return listed | (c.rlike(COMPARISON) & ~low.rlike(CODE_WORDS))


def is_structured_list(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n"), X.strip)
    return let(
        lines,
        lambda ls: (F.size(F.filter(ls, lambda s: s.rlike(r"(?U)^\d+\.\s"))) >= 2) | (F.size(F.filter(ls, lambda s: s.rlike(r"(?U)^[\-*•]\s"))) >= 2),
    )


def repeated_units(units: Column, min_length: int, min_count: int = 2) -> Column:
    """array<struct<unit, total, run, first, positions>> of units seen at least ``min_count`` times,
    ordered by first occurrence; null where there is none. ``run`` is the longest stretch of adjacent positions."""
    occurrences = F.filter(
        F.transform(units, lambda u, i: F.struct(u.alias("u"), i.alias("p"))), lambda o: F.length(o["u"]) >= min_length
    )

    def repeated(s):
        same = lambda i, j: F.get(s, i)["u"] == F.get(s, j)["u"]
        keep = F.filter(indices(F.size(s)), lambda i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.transform(keep, lambda i: F.get(s, i))

    def longest_run(positions):
        zero = F.struct(F.lit(-2).alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(a, p):
            run = F.when(p == a["prev"] + 1, a["run"] + 1).otherwise(F.lit(1))
            return F.struct(p.alias("prev"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

        return F.aggregate(positions, zero, step, lambda a: a["best"])

    def summarise(r):
        def group(g):
            def one(i, k):
                total = F.coalesce(F.get(g, k + 1), F.size(r)) - i
                members = F.slice(r, i + 1, total)
                positions = F.transform(members, lambda m: m["p"])
                return F.struct(
                    F.get(r, i)["p"].alias("first"),
                    F.get(r, i)["u"].alias("unit"),
                    total.alias("total"),
                    longest_run(positions).alias("run"),
                    positions.alias("positions"),
                )

            return F.transform(g, one)

        return let(group_starts(F.transform(r, lambda x: x["u"])), group)

    def found(o):
        # a unit seen min_count times leaves as many less one copies over: one hash pass spares most texts the rest
        spare = F.size(o) - F.size(F.array_distinct(F.transform(o, lambda x: x["u"])))
        units = let(let(F.sort_array(o), repeated), summarise)
        some = F.sort_array(F.filter(units, lambda f: f["total"] >= min_count))
        return F.when(spare >= min_count - 1, some)

    return let(occurrences, found)


def repetition_reason(
    text: Column,
    min_repetitions: int = 10,
    min_sentence_repetitions: int = 40,
    min_consecutive_sentence_repetitions: int = 4,
    short_phrase_mode: str = "substring",
) -> Column:
    """Reason string of the first repeated unit that breaks a rule, null when none does."""
    structured = is_structured_list(text)
    three = lambda flag: F.when(flag, 3).otherwise(1)

    def paragraph_reason(f, s):
        u, total, run = f["unit"], f["total"], f["run"]
        factor = F.greatest(three(s), F.when(u.contains("\n"), 4).otherwise(1), F.when(is_math_or_code(u), 2).otherwise(1))
        threshold = factor * min_repetitions
        threshold = F.when(run == 1, F.least(threshold * 2, F.lit(30))).otherwise(threshold)
        skipped = ((run == 1) & (F.length(u) < 20)) | is_transition_word(u)
        return F.when(~skipped & (total >= threshold) & ~is_code_line(u) & ~is_complex_math(u), F.concat(F.lit("paragraph_repeated_"), total.cast("string"), F.lit("x")))

    def sentence_reason(f, s):
        u, total, run = f["unit"], f["total"], f["run"]
        factor = F.greatest(three(s), F.when(is_math_or_code(u), 2).otherwise(1))
        head = F.concat(F.lit("line_repeated_"), total.cast("string"), F.lit("x"))
        ordinary = ~is_code_line(u) & ~is_complex_math(u) & ~is_transition_word(u)
        many_in_a_row = run >= factor * min_consecutive_sentence_repetitions
        many_in_all = (total >= factor * min_sentence_repetitions) & (F.length(u) >= 10)
        return F.when(
            X.word_count(u) > 1,
            F.when(
                is_short_phrase(u, short_phrase_mode),
                F.when(run >= 2 * min_consecutive_sentence_repetitions, F.concat(head, F.lit("_consecutive_short_phrase"))),
            )
            .when(many_in_a_row & ordinary, F.concat(head, F.lit("_consecutive")))
            .when(many_in_all & ordinary, head),
        )

    # no rule can fire below these counts, so rarer units never reach the regular expressions
    floor_p = max(2, min(min_repetitions, 30))
    floor_s = max(2, min(min_consecutive_sentence_repetitions, min_sentence_repetitions))
    found_p = repeated_units(X.paragraphs(text), 10, floor_p)
    found_s = repeated_units(X.sentences(text), 5, floor_s)

    def first(found, reason):
        return let(
            found,
            lambda fs: F.when(
                F.size(fs) > 0, let(structured, lambda s: F.get(F.filter(F.transform(fs, lambda f: reason(f, s)), lambda r: r.isNotNull()), F.lit(0)))
            ),
        )

    return F.coalesce(first(found_p, paragraph_reason), first(found_s, sentence_reason))


def last_assistant(messages: Column) -> Column:
    return F.coalesce(last(F.filter(messages, lambda m: m["role"] == "assistant"))["content"], F.lit(""))


def flag_repetition(df: DataFrame, text: Column, **thresholds) -> DataFrame:
    """Add ``repetition_reason``; a kept row has none."""
    return df.withColumn("repetition_reason", computed_once(repetition_reason(text, **thresholds)))


def repetition_filter(df: DataFrame, messages: str = "messages", **thresholds) -> DataFrame:
    return flag_repetition(df, last_assistant(F.col(messages)), **thresholds).filter("repetition_reason is null").drop("repetition_reason")


def _unlike(codes: np.ndarray, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Whether each run differs from the one listed before it."""
    out = rows[places[1:]] != rows[places[:-1]]
    for i in range(n):
        out |= codes[places[1:] + i] != codes[places[:-1] + i]
    return out


def equal_runs(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cuts): where runs of ``n`` codes inside a row begin, equal runs of one row side by side and in order; a
    group begins at each cut. Runs are hashed by doubling, from runs of 1, 2, 4 ... codes, sorted once by hash, and
    neighbours are compared code by code."""
    with np.errstate(over="ignore"):
        power, width = mix64(codes.astype(np.uint64) + np.uint64(1)), 1
        run, done = np.zeros(len(codes) + 1, dtype=np.uint64), 0
        while done < n:
            if n & width:  # the run so far, and the next ``width`` codes behind it
                ahead = power[done:]
                run = mix64(run[: len(ahead)] * MULTIPLIER + ahead)
                done += width
            power, width = mix64(power[: max(len(power) - width, 0)] * MULTIPLIER + power[width:]), 2 * width
        places = np.flatnonzero(rows[: len(run)] == rows[n - 1 :][: len(run)])
        key = mix64(run[places] + mix64(rows[places].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    apart = _unlike(codes, rows, places, n)
    if (apart & (key[1:] == key[:-1])).any():  # unlike runs of one hash: sorted by their codes instead
        places = np.sort(places)
        places = places[np.lexsort([codes[places + i] for i in reversed(range(n))] + [rows[places]])]
        apart = _unlike(codes, rows, places, n)
    return places, np.concatenate([[0], np.flatnonzero(apart) + 1, [len(places)]]) if len(places) else np.zeros(1, dtype=np.int64)


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive rows with at most ``most`` elements, or one row; row i's elements begin at offset i."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def repeated_ngrams(df: DataFrame, ids: str, text: Column, n: int = 3, min_occurrences: int = 2) -> DataFrame:
    """(id, ngram, occurrences, first, positions) of n-grams repeated inside a text. Words are numbered by a dictionary of
    their slice of a batch and n-grams compared as numbers; those seen once never leave their row, and no text is shuffled.
    A slice has ``SLICE_WORDS`` words or one text, so memory does not follow the words of a full batch."""
    kind = df.schema[ids].dataType
    schema = T.StructType(
        [T.StructField(ids, kind), T.StructField("ngram", T.StringType()), T.StructField("occurrences", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    )
    names = schema.fieldNames()

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(1)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten()
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        places, cuts = equal_runs(codes, rows, n)
        sizes = np.diff(cuts)
        some = np.flatnonzero(sizes >= min_occurrences)
        firsts = places[cuts[some]]
        grams = [" ".join(words.slice(p, n).to_pylist()) for p in firsts.tolist()]
        inside = (places - offsets[rows[places]]).astype(np.int32)
        positions = [inside[cuts[g] : cuts[g + 1]] for g in some.tolist()]
        columns = [b.column(0).take(pa.array(rows[firsts])), pa.array(grams, pa.string()), pa.array(sizes[some].astype(np.int32)), pa.array([int(x[0]) for x in positions], pa.int32()), pa.array(positions, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in row_slices(b.column(1).offsets.to_numpy(), SLICE_WORDS):
                yield of(b.slice(lo, hi - lo))

    return df.select(ids, computed_once(F.coalesce(X.words(F.lower(text)), F.array().cast("array<string>"))).alias("_words")).mapInArrow(run, schema)


def run_report(df: DataFrame, ids: str, text: Column, kind: str = "line") -> DataFrame:
    """(id, unit, total, run) of units with a run of at least two adjacent copies; minimum unit length
    10 for lines and 20 for paragraphs. ``label`` says whether all copies are in the run."""
    units = X.sentences(text) if kind == "line" else X.paragraphs(text)
    found = F.filter(repeated_units(units, 10 if kind == "line" else 20), lambda f: f["run"] > 1)
    rows = df.select(ids, F.explode(found).alias("f")).select(ids, "f.unit", "f.total", "f.run")
    label = F.when(F.col("run") >= F.col("total"), F.concat(F.lit(f"total_{kind}_repeated_"), F.col("total"), F.lit("x"))).otherwise(
        F.concat(F.lit(f"consecutive_{kind}_repeated_"), F.col("run"), F.lit("x"))
    )
    return rows.withColumn("label", label)


def longest_runs(long: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Longest run of adjacent positions per key, for tables that hold one row per occurrence."""
    w = Window.partitionBy(*keys).orderBy(position)
    islands = long.withColumn("_island", F.col(position) - F.row_number().over(w)).groupBy(*keys, "_island").agg(F.count("*").alias("_n"))
    return islands.groupBy(*keys).agg(F.sum("_n").alias("total"), F.max("_n").alias("run"))
