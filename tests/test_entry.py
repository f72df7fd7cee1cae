"""The registry without the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

BLOCK = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), any(k.startswith("op1_") for k in entry.queries()))
"""


@pytest.mark.parametrize("name", ["stockloom.llm", "corpus_pipeline", "xxhash", "zstandard"])
def test_registry_without_optional_packages(name):
    found = subprocess.run(
        [sys.executable, "-c", BLOCK.format(name=name)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120, check=True
    )
    queries, oracles, llm = found.stdout.split()
    assert int(queries) > 95 and int(oracles) > 90 and llm == "False"
