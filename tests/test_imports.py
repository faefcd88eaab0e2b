import os
import subprocess
import sys


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A driver elsewhere that only extends its own path: executors must get all they need with the functions."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from cloakwork.session import local_session
import __spark_entry__ as e
s = local_session(2)
q = e.queries()
for name in ("extended_pack", "blake2b_tokens", "accumulate_stream", *(n for n in q if n.startswith(("op1_", "op9_")))):
    q[name](s, "/root/testdata/sf0.001").count()
assert e.entry(s).count()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-3000:]


def test_queries_are_listed_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert set(e.oracle_sql()) <= set(e.queries()) and SparkContext._active_spark_context is None"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-3000:]
