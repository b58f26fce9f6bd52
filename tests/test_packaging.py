"""The engine doesn't depend on the llm subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_llm():
    for path in (ROOT / "lacewing").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path
