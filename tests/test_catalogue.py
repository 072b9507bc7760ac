"""Every catalogue query against its SQL in DuckDB, on the small tables."""

import os

import duckdb
import numpy as np
import pytest

from colloquy.plans import more_queries  # noqa: F401
from colloquy.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((rounded(r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=str)
    rel = duck.execute(ORACLE[name])
    order = [d[0] for d in rel.description]
    assert sorted(order) == names
    want = sorted((rounded(r[order.index(c)] for c in names) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want


def test_der_by_brute_force(spark, sf):
    """Active speakers at the middle of every piece; the mapping of most shared time by trying flows of one pair at a time."""
    assert set(QUERIES) - set(ORACLE) == {"der"}
    from colloquy.functions.assignment import best_assignment
    from colloquy.model import event_turns

    rows = [tuple(r) for r in event_turns(spark, sf).select("rec", "speaker", "start_us", "end_us", "event_id").collect()]
    for got in QUERIES["der"](spark, sf).collect():
        ref = [r[1:4] for r in rows if r[0] == got["rec"]]
        hyp = [(r[1], r[2] + 500_000, r[3] + 500_000) for r in rows if r[0] == got["rec"] and r[4] % 5]
        names = sorted({r[0] for r in ref}), sorted({h[0] for h in hyp})
        shared = np.zeros((len(names[0]), max(1, len(names[1]))))
        for a, s, e in ref:
            for b, t, f in hyp:
                shared[names[0].index(a), names[1].index(b)] += max(0, min(e, f) - max(s, t))
        pairs = {(names[0][i], names[1][j]) for i, j in enumerate(best_assignment(shared)) if j >= 0 and names[1] and shared[i, j] > 0}
        cuts = sorted({x for r in ref + hyp for x in r[1:]})
        missed = false = wrong = total = 0
        for s, e in zip(cuts, cuts[1:], strict=False):
            r = {a for a, x, y in ref if x <= s < y}
            h = {a for a, x, y in hyp if x <= s < y}
            right = sum((a, b) in pairs for a in r for b in h)
            missed += max(0, len(r) - len(h)) * (e - s)
            false += max(0, len(h) - len(r)) * (e - s)
            wrong += (min(len(r), len(h)) - right) * (e - s)
            total += len(r) * (e - s)
        assert (got["missed_us"], got["false_alarm_us"], got["confusion_us"], got["ref_us"]) == (missed, false, wrong, total)


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)
