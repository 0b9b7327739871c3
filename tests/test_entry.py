"""The entry point without the training-data operators, in a copy of the repository."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PRINT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_imports_without_the_operators(tmp_path, with_pipeline):
    for file in [*ROOT.glob("*.py"), *ROOT.glob("simsift/**/*.py")]:
        part = file.relative_to(ROOT)
        if part.parts[:2] == ("simsift", "llm") or (part.name == "corpus_pipeline.py" and not with_pipeline):
            continue
        copy = tmp_path / part
        copy.parent.mkdir(parents=True, exist_ok=True)
        copy.write_bytes(file.read_bytes())
    run = subprocess.run([sys.executable, "-c", PRINT], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, n_sql, any_op = run.stdout.split()
    assert int(n) >= 88 and int(n_sql) >= 80 and any_op == "False"
