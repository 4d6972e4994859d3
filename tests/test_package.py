"""The package as a whole: imports, configuration, and life without the llm subpackage."""

import ast
import dataclasses
import subprocess
import sys
from pathlib import Path

import pytest

from mereling.config import CLASS_NAMES, Settings

ROOT = Path(__file__).resolve().parent.parent
MODULES = sorted(p for p in (ROOT / "mereling").rglob("*.py") if "llm" not in p.parts)


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(ROOT)))
def test_nothing_else_imports_llm_or_changes_folder(path):
    tree = ast.parse(path.read_text())
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        assert not any("llm" in n for n in names)
        assert not (isinstance(node, ast.Attribute) and node.attr == "chdir")


def test_modules_import_without_a_session():
    names = [".".join(p.relative_to(ROOT).with_suffix("").parts).removesuffix(".__init__") for p in MODULES]
    code = "import importlib, pyspark.sql as s\nfor n in %r: importlib.import_module(n)\nassert s.SparkSession.getActiveSession() is None" % names
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_without_llm():
    code = "import sys\nsys.modules['mereling.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_settings():
    s = Settings()
    assert (s.n_chunks, s.epochs, s.batch, s.learning_rate, s.patch_side, s.seed, s.confidence_threshold) == (5000, 150, 256, 0.001, 31, 123, 40.0)
    assert CLASS_NAMES == ("land", "reservoirs", "sea", "water-bodies")
    with pytest.raises(dataclasses.FrozenInstanceError):
        s.epochs = 1


@pytest.mark.parametrize("wrong", [{"n_chunks": 0}, {"epochs": 1.5}, {"batch": True}, {"composite": "mode"}, {"dropout": 1.0}, {"max_label_rows": -1}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        Settings(**wrong)
