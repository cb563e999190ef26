"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

An index is built once and written as a snapshot, as a user's would be; the
search queries read it. Query times are medians of three runs.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

from lodestone.operators import dense, lexical, lookup  # noqa: E402
from lodestone.plans import catalog, library  # noqa: E402
from lodestone.plans import search as S  # noqa: E402
from lodestone.plans.syntax import parse  # noqa: E402
from lodestone.schema import Index  # noqa: E402
from lodestone.session import session  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = 3


def main() -> None:
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    at = tempfile.mkdtemp(prefix="lodestone-bench-")
    times: dict[str, float] = {}

    def timed(name: str, f, runs: int = RUNS) -> None:
        each = []
        for _ in range(runs):
            t = time.time()
            f()
            each.append(time.time() - t)
        times[name] = round(statistics.median(each), 4)

    try:
        names = ("documents", "chunks", "symbols", "postings", "vectors")

        def build() -> None:
            i = library.index(spark, SF)
            # One input file is one task; words are found on all cores.
            chunks = lexical.analysed(i.chunks.drop("token_count").repartition(spark.sparkContext.defaultParallelism))
            lexical.token_counts(chunks).write.mode("overwrite").parquet(f"{at}/analysed")
            chunks = spark.read.parquet(f"{at}/analysed")
            chunks.drop("tokens").write.mode("overwrite").parquet(f"{at}/chunks")
            lexical.postings(chunks).repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{at}/postings")
            for name in ("documents", "symbols", "vectors"):
                getattr(i, name).write.mode("overwrite").parquet(f"{at}/{name}")

        timed("index_build", build, 1)
        i = Index(*(spark.read.parquet(f"{at}/{n}") for n in names))
        vector, now, words = library.first_vector(spark, SF), catalog.NOW, catalog.WORDS
        timed("bm25_topk", lambda: lexical.bm25(i.postings, i.chunks, words, 10).collect())
        timed("tfidf_topk", lambda: lexical.tfidf(i.postings, i.chunks, words, 10).collect())
        timed("vector_topk", lambda: dense.vector_top(i.vectors, vector, 10).collect())
        timed("vector_topk_filtered", lambda: dense.vector_top(i.vectors, vector, 10, lookup.candidates(i, parse("ext:md"))).collect())
        timed("hybrid_search", lambda: S.search(i, words, now, query_vector=vector).collect())
        timed("hybrid_search_filtered", lambda: S.search(i, f"{words} ext:md,py", now, query_vector=vector).collect())
        timed("filter_only_search", lambda: S.search(i, "ext:md", now).collect())
        timed("symbol_search", lambda: S.search_symbol(i, "en").collect())
        timed("term_stats", lambda: lexical.term_stats(i.postings).write.format("noop").mode("overwrite").save())
        timed("index_stats", lambda: lexical.index_stats(i).collect())
        for name in ("html_chunks", "chunks", "event_sessions"):
            timed(name, lambda name=name: catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save(), 1)
        try:
            from lodestone.llm import catalog as llm
        except ModuleNotFoundError as e:
            if e.name != "lodestone.llm":
                raise
        else:
            for name, f in llm.QUERIES.items():
                timed(name, lambda f=f: f(spark, SF).write.format("noop").mode("overwrite").save(), 1)
    finally:
        shutil.rmtree(at, ignore_errors=True)
        spark.stop()
    print(json.dumps({"metric": "sum of query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
