import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def test_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 30; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_core_stands_without_the_optional_part(tmp_path):
    code = "import sys; sys.modules['leafwright.llm'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('p2')]"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
