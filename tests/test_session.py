"""The session keeps the settings of the application that was submitted."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_submitted_master_survives():
    code = "from revlens.session import get_session; s = get_session(); print('MASTER', s.sparkContext.master); s.stop()"
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell", "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert "MASTER local[2]" in out.stdout, out.stderr[-2000:]
