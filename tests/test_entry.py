import subprocess
import sys

import __spark_entry__ as e


def test_contract(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4


def test_nothing_else_imports_the_optional_part():
    # Names come from the files: walking packages imports each of them, the optional one too.
    code = """
import importlib, pathlib, sys, tensorfold
top = pathlib.Path(tensorfold.__file__).parent
for f in sorted(top.rglob("*.py")):
    name = [x for x in f.relative_to(top.parent).with_suffix("").parts if x != "__init__"]
    if "llm" not in name:
        importlib.import_module(".".join(name))
assert "tensorfold.queries" in sys.modules and not [x for x in sys.modules if "llm" in x]
"""
    subprocess.run([sys.executable, "-c", code], check=True)
