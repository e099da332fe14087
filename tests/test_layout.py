"""The library stands without the subpackage of operators for training data, and names nothing outside itself."""

from __future__ import annotations

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "tessella").rglob("*.py"):
        inside = path.relative_to(ROOT / "tessella").parts[0]
        if inside == "llm":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_without_a_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_local_checkpoints():
    mine = Path(__file__).resolve()
    assert not [p for p in ROOT.rglob("*.py") if p.resolve() != mine and "localCheckpoint" in p.read_text()]
