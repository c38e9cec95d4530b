"""Every registered query of the library itself against its SQL, and the entry module."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from corroborate.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(frame):
    """The rows as text, numbers to nine digits."""

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "-"
        return str(bool(v)) if "bool" in type(v).__name__ else v if isinstance(v, str) else f"{float(v):.9g}"

    return sorted(str([cell(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLES:
        want = sql.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and text(got) == text(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_part():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    named = [p for p in (root / "corroborate").rglob("*.py") if "llm" not in p.parts and "corroborate.llm" in p.read_text()]
    assert named == []


def test_confidences_are_rounded_as_the_sql_does(spark, tmp_path):
    from corroborate.plans import control_queries as Q

    values = [100.5, 100.49, 100.51, 100.499999999999, 0.5, 1.5, 28.5, 99.5, 0.0, -0.4, -0.5, -0.6]
    con = duckdb.connect()
    rows = ", ".join(f"({28 * k + i}, {v}::DOUBLE, '{{\"k\": {c}}}')" for k, (v, c) in enumerate((v, c) for v in values for c in range(6)) for i in (1, 2, 4, 9))
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert text(Q.judgment_contracts(spark, str(tmp_path)).toPandas()) == text(con.execute(Q.ORACLES["judgment_contracts"]).df())
