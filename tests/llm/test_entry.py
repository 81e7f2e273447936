"""The entry passes over absent training operators, not over faults in them."""

import os
import subprocess
import sys


def test_a_fault_in_the_training_operators_is_raised(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("bulletin", "__spark_entry__.py"):
        os.symlink(f"{root}/{name}", tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    source = open(f"{root}/__spark_entry__.py").read()
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(source)
    assert run().returncode == 0  # no pipeline: its absence is passed over
    (tmp_path / "corpus_pipeline.py").write_text("from bulletin.llm import pakcing\n")
    found = run()
    assert found.returncode != 0 and "pakcing" in found.stderr
