import os
import subprocess
import sys

import corpus_pipeline
from conftest import SMALL

from millrace.llm import bestfit, decontaminate, near_dedup, quality, secrets


def test_stages_apply_their_operators_to_what_was_kept(spark, documents):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    left = documents
    kept = {r["doc_id"] for r in quality.quality_report(left).filter("kept").collect()}
    left = left.filter(left.doc_id.isin(kept))
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(left, near_dedup.GENERAL_THRESHOLD, bands=near_dedup.GENERAL_BANDS).filter("kept").collect()}
    left = left.filter(left.doc_id.isin(kept))
    hit = {r["doc_id"] for r in decontaminate.benchmark_hits(left, benchmark).filter("contaminated").collect()}
    left = left.filter(~left.doc_id.isin(hit)) if hit else left
    left = secrets.redacted(left)
    wanted = bestfit.best_fit(bestfit.token_counts(left)).collect()
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, wanted))


def test_stages_keep_the_columns_of_documents(spark, documents):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents.limit(20), SMALL).columns == documents.columns


def test_empty_and_odd_tables(spark, odd, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0
        stage(spark, odd, SMALL).count()


def test_nothing_else_imports_the_subpackage():
    code = (
        "import sys; sys.modules['millrace.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import pkgutil, importlib, millrace\n"
        "for m in pkgutil.walk_packages(millrace.__path__, 'millrace.'):\n"
        "    if not m.name.startswith('millrace.llm'): importlib.import_module(m.name)\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(corpus_pipeline.__file__), check=False).returncode == 0


def test_the_flow_drops_near_copies_from_four_fifths(spark, documents):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    left = quality.without_rejected(documents)
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(left, 80).filter("kept").collect()}
    left = decontaminate.without_contaminated(left.filter(left.doc_id.isin(kept)), benchmark)
    wanted = bestfit.best_fit(bestfit.token_counts(secrets.redacted(left))).collect()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, wanted))
