import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_match():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_extra_operators():
    """The entry module and the library import when the training-data operators cannot be."""
    code = "import sys; sys.modules['peakweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import peakweave, __spark_entry__ as e; assert 'region_parse_sort' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
