"""The entry point without the optional operators."""
import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_stands_without_the_optional_operators():
    """Where a module that the operators need cannot be imported, all other queries are still there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'road_status' in q and not [x for x in q if x.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True, timeout=120)
