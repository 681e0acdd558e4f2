"""The driver's contract: every SQL has a query, and the flagship runs."""

import __spark_entry__


def test_registry():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert all(callable(q) for q in known.values())


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[:3] == ["request_id", "data_class", "rank"] and out.count() > 0


def test_registry_needs_no_session():
    """The driver may list the queries before it starts Spark."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
