"""Every query of the engine on the smallest tables, against its SQL where it has one."""

import subprocess
import sys

import pytest
from conftest import REPO

import oracle
from textloom import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, db, name):
    assert not oracle.differences(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], db)


def test_the_entry_module_works_without_the_subpackage(tmp_path):
    """As when the folder of training-data operators and the pipeline are deleted."""
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("textloom.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names - {"or_terms"}) and set(e.oracle_sql()) <= names
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_an_error_inside_the_subpackage_is_an_error():
    """A broken import must not pass for an absent subpackage."""
    code = """
import sys
class Finder:
    def find_spec(self, name, path=None, target=None):
        if name == "textloom.llm.maxent":
            raise ImportError("broken inside")
sys.meta_path.insert(0, Finder())
import __spark_entry__
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert done.returncode and "broken inside" in done.stderr
