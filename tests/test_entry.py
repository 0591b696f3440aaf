import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry_works_without_the_llm_folders(tmp_path):
    copy = shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    ask = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"

    def asked():
        run = subprocess.run([sys.executable, "-B", "-c", ask], cwd=copy, capture_output=True, text=True, check=True)
        n, *rest = run.stdout.split()
        assert int(n) >= 50
        return rest

    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "plumbline" / "llm", ignore_errors=True)
    assert asked() == ["True", "False", "False"]
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert asked() == ["True", "False", "False"]
