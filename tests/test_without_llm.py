import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_corpus_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "alphaline"), copy / "alphaline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(ROOT, name), copy)
    code = "import __spark_entry__ as e; assert 'alpha_benchmark' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""})
    os.remove(copy / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_other_tests_pass_without_the_corpus_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "alphaline"), copy / "alphaline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(ROOT, "tests"), copy / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(ROOT, name), copy)
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_pixels.py", "tests/test_catalog.py", "-k", "pixels or entry or reach_the_scan"], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-3000:]


def test_nothing_else_imports_the_corpus_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "alphaline")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as source:
                        assert "alphaline.llm" not in source.read(), name
