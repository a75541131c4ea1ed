"""The driver's contract, and that nothing outside the training-data subpackage needs it."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "lodestar").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"lodestar\.llm|from \.+llm", p.read_text()), p
