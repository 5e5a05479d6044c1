"""Every registered storage query against its SQL on the same tables."""

import hashlib
import math

import duckdb
import pytest

from haulage.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(float(f"{v:.10g}") if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf001, con, name):
    df = registry.queries()[name](spark, sf001)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = plain(rel.project(", ".join(f'"{c}"' for c in df.columns)).fetchall())
    got = plain(map(tuple, df.collect()))
    assert len(got) == len(want) > 0
    assert got == want, [(a, b) for a, b in zip(got, want) if a != b][:3]


def test_every_query_has_sql_but_those_of_a_store():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"s1_listing", "s1_walk", "s3_read_chunks", "c4_copy_files", "r3_resumable_copy", "t4_pack_to_tar", "d8_renamed_directories"}


def test_store_queries(spark, small):
    (listed,) = registry.queries()["s1_listing"](spark, small).collect()
    rows = sorted(registry.queries()["s3_read_chunks"](spark, small).collect(), key=lambda r: r.offset)
    with open(f"{small}/orders.parquet", "rb") as f:
        content = f.read()
    assert listed["size"] == len(content)
    want = [(at, min(65536, len(content) - at)) for at in range(0, len(content), 65536) if at != 65536]
    assert [(r.offset, r.length) for r in rows] == want
    assert all(r.digest == hashlib.sha256(content[r.offset : r.offset + r.length]).hexdigest() for r in rows)
