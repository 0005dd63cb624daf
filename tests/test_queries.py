"""Every registered query of the engine against its SQL."""

import pytest

import gridloom.parts  # noqa: F401, registers its queries
from gridloom.queries import ORACLES, QUERIES
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_box_predicate_reaches_the_scan(spark, tmp_path):
    """A box becomes a range of chunk numbers that Parquet prunes by."""
    from gridloom.functions.boxes import Box
    from gridloom.operators.frame import ArrayFrame
    from gridloom.queries import embeddings

    frame = embeddings(spark, DATA)
    frame.chunks.write.parquet(str(tmp_path / "chunks"))
    stored = ArrayFrame.of_table(frame.meta, spark.read.parquet(str(tmp_path / "chunks")))
    read = lambda f: sorted((r["i0"], r["i1"], r["v"]) for r in f.erase_chunk(1, 1).subset(Box.of((95, 105), (10, 40))).collect())
    assert read(stored) == read(frame)
    missing = ArrayFrame.of_table(frame.meta, spark.read.parquet(str(tmp_path / "chunks")).where("c0 <> 1 OR c1 <> 1"))
    assert sorted((r["i0"], r["i1"], r["v"]) for r in missing.subset(Box.of((95, 105), (10, 40))).collect()) == read(frame)
    plan = stored.subset(Box.of((95, 105), (10, 40)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(c0,1)" in plan and "LessThan(c0,3)" in plan


def test_conversations_with_a_ninth_turn(spark, tmp_path):
    rows = [(0, t, "user", f"a{t}") for t in range(10)] + [(1, 8, "user", "b8"), (1, None, "user", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {(0, t): f"a{t}" for t in range(10)} | {(1, t): "b8" if t == 8 else "" for t in range(10)}
    for name in ("ragged_read", "vlen_utf8_roundtrip", "vlen_roundtrip"):
        assert {(r["i0"], r["i1"]): r["v"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_rechunk_counts_only_cells_that_rows_gave(spark, tmp_path):
    """Chunks at the border, missing and null vectors, vectors of zeros, null and NaN components."""
    import duckdb

    line = lambda i, *first: [*first, *((i * 64 + k) % 97 / 8 for k in range(len(first), 64))]
    rows = [(i, line(i)) for i in range(56) if not 25 <= i < 50] + [(i, [0.0] * 64) for i in range(75, 100)]
    rows += [(60, None), (61, []), (62, [1.0] * 10), (130, line(1, None, 2.0)), (160, [None] * 64), (181, line(2, float("nan")))]
    table = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{table}/*.parquet'")
    got = QUERIES["rechunk"](spark, str(tmp_path)).select("c0", "c1", "n", "total").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, con.execute(ORACLES["rechunk"]).fetchall()))  # as text: NaN is NaN
