"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8). All queries
run once on the smallest tables beside them, where there are any, before they are timed.
"""

from __future__ import annotations

import json
import os
import time

from letterloom.operators.dictionary import Dictionary
from letterloom.plans.index import refresh_index, write_index
from letterloom.plans.queries import (
    QUERIES,
    document_listing,
    document_texts,
    documents_index,
    new_listing,
    old_listing,
    table,
)
from letterloom.session import build_session, new_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_UP_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "search_any search_all search_phrase search_prefix search_fuzzy search_results "
    "dupes_md5 dupes_members dupes_adler32 incremental_batch load_stream load_running page_text message_ingest"
).split()


def run_all(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of every headline query; each writes its whole result to the no-op sink."""
    # tables of one coarse file: the caller cuts them into as many parts as there are cores before anything is timed
    parts = new_folder(spark, "bench-tables")
    for name in ("documents", "benchmark", "labels", "events", "pages"):
        table(spark, sf_dir, name).repartition(int(CPUS)).write.parquet(f"{parts}/{name}.parquet")
    sf_dir = parts
    documents = table(spark, sf_dir, "documents")
    seconds: dict[str, float] = {}

    def timed(name: str, run):
        start = time.perf_counter()
        out = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    def texts_of(changed):
        return document_texts(documents).join(changed.select("doc_id"), "doc_id", "left_semi")

    timed(
        "index_build",
        lambda: write_index(document_listing(documents), document_texts(documents), new_folder(spark, "bench"), ()),
    )
    old_texts = document_texts(documents.where("source <> 'src7'"))
    index = write_index(old_listing(spark, sf_dir), old_texts, new_folder(spark, "bench"), ())
    timed("index_refresh", lambda: refresh_index(index, new_listing(spark, sf_dir), texts_of))
    index = documents_index(spark, sf_dir)  # the index that the searches open, with its dictionary's layouts
    for layout in (Dictionary(index).fences, Dictionary(index).spellings):
        layout()
    for name in HEADLINES:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    return seconds


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        "letterloom-bench",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM_UP_DIR):
        run_all(spark, WARM_UP_DIR)  # class loading and code generation are not what is measured
    seconds = run_all(spark, SF_DIR)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
