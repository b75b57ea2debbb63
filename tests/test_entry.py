"""The driver's entry points."""

from __future__ import annotations

import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "distance", "grounded"]


def test_rest_works_without_the_data_preparation_package(tmp_path):
    """The registry of the library's own queries imports nothing of it."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__spark_entry__.__file__).parent
    code = "import sys; sys.modules['lumenote.llm'] = None\nimport lumenote.plans.registry as r; print(len(r.QUERIES))"
    said = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=120, check=True)
    assert int(said.stdout) > 80
