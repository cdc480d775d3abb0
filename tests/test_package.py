"""The package reaches Python workers that do not share the driver's sys.path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from penprint.operators import vectors
from penprint.session import get_session
spark = get_session("local[2]", 2)
table = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [1.0, 1.0])], "author STRING, slot INT, embedding ARRAY<DOUBLE>")
print("ROWS", vectors.cosine_all_pairs(table).count())
"""


def test_grouped_functions_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]


def test_a_cluster_needs_a_shared_checkpoint_folder():
    import pytest

    from penprint import session

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
