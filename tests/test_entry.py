"""The entry points work with and without the optional parts."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'churn_scoreboard_month' in q)"


def names_registered(folder) -> str:
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


def copied(folder, *left_out):
    here = {os.path.join(ROOT, p) for p in left_out}
    shutil.copytree(os.path.join(ROOT, "sublens"), folder / "sublens",
                    ignore=lambda at, found: [n for n in found if os.path.join(at, n) in here or n == "__pycache__"])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)) and name not in left_out:
            shutil.copy(os.path.join(ROOT, name), folder)
    return folder


def test_queries_register_without_the_optional_parts(tmp_path):
    from sublens.plans.registry import all_queries
    want = f"{len(all_queries())} True"
    assert names_registered(copied(tmp_path / "neither", "sublens/llm", "corpus_pipeline.py")) == want
    assert names_registered(copied(tmp_path / "pipeline_left", "sublens/llm")) == want


def test_a_fault_inside_an_optional_part_is_raised(tmp_path):
    folder = copied(tmp_path / "broken", "sublens/llm")
    os.makedirs(folder / "sublens/llm")
    (folder / "sublens/llm/__init__.py").write_text("")
    (folder / "sublens/llm/queries.py").write_text("import no_such_module_of_ours\n")
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode != 0 and "no_such_module_of_ours" in done.stderr
