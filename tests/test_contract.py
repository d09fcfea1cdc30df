import importlib.util

import __spark_entry__ as contract


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert "ranked_report" in contract.queries()


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert {"src_id", "cand_id", "combined_tenths", "rank"} <= set(df.columns) and df.count() >= 0


def test_core_does_not_import_the_llm_folder():
    import pathlib

    root = pathlib.Path(importlib.util.find_spec("lexiloom").origin).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lexiloom.llm" not in path.read_text(encoding="utf-8")


def test_core_stands_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as contract

    whole = set(contract.queries())
    for name in [m for m in sys.modules if m.startswith("lexiloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)  # a library of that folder is absent
    assert {q for q in whole if not q.startswith("p") or q in ("progress", "progress_text", "parse_dispatch", "paragraph_split", "payload_errors")} <= set(contract.queries())


def test_tables_are_cleared(spark, tmp_path):
    import os

    from lexiloom.core import storage

    assert storage.materialize(spark.range(3), "x").count() == 3
    folder = storage._own_dir(spark).removeprefix("file:")
    assert os.listdir(folder)
    storage.clear(spark)
    assert not os.path.exists(folder)
