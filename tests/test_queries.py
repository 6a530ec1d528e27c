"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from loomspark.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)[:26] if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    assert got
    if name in ORACLE:
        r = db.execute(ORACLE[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(row[k]) for k in at)) for row in r.fetchall())


def test_entry_without_the_corpus_modules(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    load = importlib.import_module

    def without(missing):
        def found(name, *a):
            if name == missing:
                raise ModuleNotFoundError(name, name=name)
            return load(name, *a)

        monkeypatch.setattr(importlib, "import_module", found)

    without("loomspark.llm.queries")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
    without("corpus_pipeline")
    assert "pipeline" not in entry.queries()
    # what they need is another matter
    monkeypatch.setattr(importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("zstandard", name="zstandard")))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_trained_router_uses_the_operator_s_defaults(spark, sf, monkeypatch):
    from loomspark.plans import queries as plans

    seen = []
    monkeypatch.setattr(plans.L, "fit", lambda features, labels, *a, **k: seen.append((features, a, k)) or (0.0, {0: 1.0}))
    plans.trained_router(spark, sf)
    ((features, a, k),) = seen
    assert not a and not k and features.agg({"idx": "max"}).first()[0] >= 256
