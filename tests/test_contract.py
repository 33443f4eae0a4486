"""Rules every registered query keeps."""

import re
from pathlib import Path

from millrace.plans import catalog

PACKAGE = Path(__file__).parent.parent / "millrace"
FILES = [f for f in PACKAGE.rglob("*.py") if "llm" not in f.relative_to(PACKAGE).parts]


def test_names_match():
    queries, oracles = catalog.QUERIES, catalog.ORACLES
    assert set(oracles) <= set(queries)
    assert len(queries) > 150 and set(queries) - set(oracles) == {"file_inventory"}
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", name) for name in queries)


def test_lineage_is_cut_only_through_shared_tables():
    for file in FILES:
        source = file.read_text()
        assert "localCheckpoint" not in source, file
        assert "toPandas" not in source and "crossJoin" not in source, file
        assert "broadcast(" not in source, file


def test_nothing_is_collected_outside_bounded_places():
    uses = [f.name for f in FILES for _ in re.finditer(r"\.collect\(\)|collect_list|collect_set", f.read_text())]
    assert uses == ["gather.py"]
