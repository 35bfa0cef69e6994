from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).take(1)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_a_library_of_the_llm_folder():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'wn01_sma' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True, env={"PATH": "/usr/bin:/bin"})


def test_works_without_the_llm_folder(tmp_path):
    root = Path(entry.__file__).parent
    subprocess.run(["cp", "-r", str(root / "barloom"), str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    (tmp_path / "barloom" / "llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'wn01_sma' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
