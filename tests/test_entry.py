"""The entry module without the parts that may be missing."""

import subprocess
import sys

import pytest

SAY = """
import sys, warnings
warnings.simplefilter("ignore")
for name in {missing!r}:
    sys.modules[name] = None  # importing it fails
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(sum(n[:2] == "op" and n[2].isdigit() for n in names), "pipeline" in names, "recorded_results" in names)
"""


@pytest.mark.parametrize(
    ("missing", "own", "pipeline"),
    [
        (["corpus_pipeline"], True, False),
        (["public_tokenizers"], False, False),
        (["qarun.llm"], False, False),
    ],
)
def test_only_what_needs_the_missing_part_goes(missing, own, pipeline):
    said = subprocess.run(
        [sys.executable, "-c", SAY.format(missing=missing)], capture_output=True, text=True, check=True
    )
    ops, has_pipeline, others = said.stdout.split()
    assert (others, has_pipeline) == ("True", str(pipeline))
    # With the package deleted there are none to begin with.
    assert own or ops == "0"
