"""Every registered query against its SQL."""

import math

import duckdb
import pytest

from chronolith.workload import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    expected = duck.execute(sql)
    columns = sorted(d[0] for d in expected.description)
    assert sorted(got.columns) == columns
    frame = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    assert normal(got.select(*columns).collect()) == normal(frame)


def test_only_the_model_has_no_sql():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == {"model_candidates"}


def test_models_are_what_their_labels_name(spark):
    models = queries.model_estimators()
    assert models["lr_0.01_0.0"].getMaxIter() == 100
    assert (models["gbt_3_20"].getMaxDepth(), models["gbt_3_20"].getMaxIter()) == (3, 20)


def test_model_grid_is_whole(spark):
    rows = queries.queries()["model_candidates"](spark, SF).collect()
    assert len(rows) == 8 and {r.algorithm for r in rows} == {"LogisticRegression", "GBTClassifier"}
    best = max(rows, key=lambda r: (r.pr_auc, r.roc_auc))
    assert [r.candidate for r in rows if r.selected] == [best.candidate] and 0 < best.threshold < 1 and best.test_positives > 0
