"""The core must work without the training-data subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "tessera"


def test_nothing_else_imports_llm():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"tessera[.]llm|from [.]+llm", path.read_text()), path
