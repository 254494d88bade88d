"""Nothing outside the subpackage of training-data operators depends on it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_only_the_entry_imports_it():
    for p in (ROOT / "paneloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"paneloom\.llm|from \.+llm|import llm", p.read_text()), p


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
