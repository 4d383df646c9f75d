"""The entry module imports and lists its queries in a process without a Spark session."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(s) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=HERE, timeout=120).returncode == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
