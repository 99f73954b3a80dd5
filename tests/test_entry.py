import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 150"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_gives_the_roll_matrix(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[:2] == ["current_bucket", "total_accounts"]
    assert [r.current_bucket for r in df.collect()] == ["0", "1-29", "30-59", "60-89", "90+"]
