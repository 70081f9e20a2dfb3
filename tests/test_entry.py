from __future__ import annotations

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "capped_gap_sessions" in entry.queries()


def test_imports_without_the_optional_parts():
    code = "import sys; sys.modules['cadenza.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'segment_merge' in q and not any(n.startswith('op1') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "obs_id" in df.columns
