"""The pipeline's stages in order, and the entry point without the subpackage."""
import os
import shutil
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from conftest import SF001
from pyspark.sql import functions as F

import corpus_pipeline as P
from auditlens.llm import store

ROOT = Path(__file__).parents[2]


def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = store.documents(spark, SF001)
    columns, folder = docs.columns, store.scratch(spark, "test-pipeline")
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "mix"]
    for k, (name, stage) in enumerate(P.STAGES):
        out = store.staged(stage(spark, docs, SF001), folder, name)
        assert out.columns == columns + ["mix_weight"] * (k == 4)
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before and (k == 4 or len(after) >= 0.75 * len(before))
        docs = out


CLASHES = """_id _some _removed _mark _gone _quality _value _kept _tokens _source _lang _topic row runs mark some removed done gone quality
    quality_score score label toxic n a b bands sig component kept item word term tokens w item_id contaminated topic hash s""".split()


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_columns_of_any_name_pass_through_every_stage(spark, name, stage):
    docs = store.documents(spark, SF001)
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    out = stage(spark, wide, SF001)
    assert out.columns == wide.columns + ["mix_weight"] * (name == "mix")
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES)


def test_pipeline_of_an_empty_table(spark):
    docs = store.documents(spark, SF001).limit(0)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF001)
        assert docs.count() == 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    """A copy without the training-data folders and the pipeline still lists and runs the other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = textwrap.dedent("""
        import __spark_entry__ as e
        from auditlens.session import get_session
        assert 'audit_summary_ai' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())
        assert set(e.oracle_sql()) <= set(e.queries())
        assert e.queries()['dup_counts'](get_session('local[1]'), '/root/testdata/sf0.001').count() == 1
    """)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)})


def test_a_missing_dependency_costs_only_the_subpackage(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        sys.modules['xxhash'] = None
        import __spark_entry__ as e
        assert 'audit_summary_ai' in e.queries() and not any(k.startswith('op') for k in e.queries())
    """)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
