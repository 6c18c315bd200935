"""Times headline queries on the tables at $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

The text tables come as one file with one row group, which one task reads whatever the cores, and the engine does not
shuffle texts to spread them. So they are first written again as several files, as a cluster holds them. That is reported
as ``split_sec`` and counts in the total; BENCH_SPLIT=0 leaves the tables as they are.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatmill import catalog  # noqa: E402
from chatmill.session import local_session  # noqa: E402

HEADLINE = [
    "clean_chat_stats",
    "drop_provider_identity",
    "repetition_filter",
    "repeated_ngrams",
    "length_filter",
    "mix_by_amounts",
    "resample_by_source",
    "dense_index",
    "decontam_exact",
    "decontam_ngram_train",
    "decontam_vector_hits",
    "binarize_by_aspects",
    "majority_vote",
    "advantage_standard",
    "score_rule_verifiers",
    "score_ifeval",
    "score_string_f1",
    "encode_chat",
    "encode_plain",
    "pack_next_fit",
    "packed_rollouts",
    "stream_advantages",
]


TEXT_TABLES = ["documents", "conversations"]


def split_texts(spark, sf_dir: str, files: int) -> str:
    """A folder that has the text tables in ``files`` files each and links to the other tables."""
    out = tempfile.mkdtemp(prefix="chatmill-bench-")
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        if name in TEXT_TABLES:
            spark.read.parquet(f"{sf_dir}/{f}").repartition(files).write.parquet(f"{out}/{f}")
        else:
            os.symlink(os.path.abspath(f"{sf_dir}/{f}"), f"{out}/{f}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus), "chatmill-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executors before the clock does
    start = time.time()
    if os.environ.get("BENCH_SPLIT", "1") != "0":
        given, sf_dir = sf_dir, split_texts(spark, sf_dir, 2 * int(cpus))
    else:
        given = sf_dir
    split_sec = round(time.time() - start, 3)
    first, times = {}, {}
    for name in names:
        for run in (first, times):  # the first run compiles, the second one is the measure
            start = time.time()
            queries[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
            run[name] = round(time.time() - start, 3)
    rows = {"repetition_filter": "documents", "length_filter": "documents", "score_ifeval": "documents", "drop_provider_identity": "conversations", "encode_chat": "conversations", "encode_plain": "documents"}
    rates = {
        n: round(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() / times[n] / int(cpus)) for n, t in rows.items() if n in times
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()) + split_sec, 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "split_sec": split_sec, "first_run": first, "rows_per_sec_per_core": rates,
            }
        )
    )


if __name__ == "__main__":
    main()
