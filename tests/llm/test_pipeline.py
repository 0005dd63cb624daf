"""The pipeline's stages on a small table with odd rows, each held against a plain version."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridloom.llm import mixing, piece_sampling
from gridloom.llm import rows as decided
from gridloom.llm.rows import ROW, with_copies, with_row
from tests.conftest import DATA
from tests.llm.test_operators import brute_links

SECRET_TEXT = "Thering of the nation and that password=b7db7aa4a5fcc78305 for the other and with ering tionst"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(9001, None, "en", "src1", 0, 1), (9002, "", None, None, 0, 1), (9003, "123 456", "en", "src0", 7, 1), (9004, SECRET_TEXT, "en", "src0", len(SECRET_TEXT), 1)]
    docs = docs.selectExpr("*", "1 AS extra").unionByName(spark.createDataFrame(odd, COLUMNS)).unionByName(docs.where("doc_id = 3").selectExpr("*", "1 AS extra"))
    names = list(P.DOCUMENT)

    told = P.language(spark, docs, DATA).cache()
    assert told.columns == names
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in told.collect()} == {9001, 9002, 9003}

    kept = P.near_duplicates(spark, told, DATA).cache()
    assert kept.columns == names
    rows = {r["doc_id"]: r["text"] for r in told.collect()}
    classes = brute_links(list(rows.items()))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in classes.values()})

    clean = P.secrets(spark, kept, DATA).cache()
    assert clean.columns == names
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    changed = 0
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
        assert "AKIA" not in r["text"] and "password=" not in r["text"].replace("password=" + P.SECRET, "")
        changed += r["text"] != before[r["doc_id"]]
    assert 0 < changed < len(before) / 4

    mixed = P.mixture(spark, clean, DATA).cache()
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()})
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want and mixed.columns == names

    rows = P.pieces(spark, mixed, DATA)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    n = Counter(r["doc_id"] for r in mixed.collect())
    got = piece_sampling.decode(rows, ["doc_id", "rank"]).collect()
    assert all(r["decoded"] == texts[r["doc_id"]] for r in got)
    assert Counter(r["doc_id"] for r in got if r["rank"] == 1) == n


def test_run_and_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources", "SentencePiece encoding"]


def test_copies_of_repeated_rows(spark):
    """Rows are told apart by all their columns: one id may stand for several texts, or be null."""
    rows = [(1, "a"), (1, "a"), (1, "other"), (2, "b"), (3, "c"), (4, "d"), (4, "d"), (None, "e"), (None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, "a"): 1, (2, "b"): 3, (3, "c"): 0, (4, "d"): 3, (None, "e"): 2}
    named = with_row(docs).groupBy("doc_id", "text", *ROW).agg(F.count("*").alias("n")).collect()
    decisions = spark.createDataFrame([(r["_row_a"], r["_row_b"], want[r["doc_id"], r["text"]], r["n"]) for r in named if (r["doc_id"], r["text"]) in want], "_row_a long, _row_b long, copies int, n long")
    got = Counter((r["doc_id"], r["text"]) for r in with_copies(docs, decisions).collect())
    assert got == +Counter(want) + Counter({(1, "other"): 1, (None, "f"): 1})


@pytest.mark.parametrize("places", [0, 1000])
def test_many_decisions_stay_off_the_driver(spark, monkeypatch, places):
    """Beyond the limit for decisions their figures aren't broadcast, beyond the limit for one hash nothing is, whatever size Spark guesses."""
    monkeypatch.setattr(decided, "DECISION_ROWS", 0, raising=False)
    monkeypatch.setattr(decided, "BROADCAST_ROWS", places)
    rows = [(k, f"text {k}") for k in range(40)] + [(0, "text 0"), (1, "text 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: k % 3 for k in range(20)}
    named = with_row(docs).groupBy("doc_id", *ROW).agg(F.count("*").alias("n")).collect()
    decisions = spark.createDataFrame([(r["_row_a"], r["_row_b"], want[r["doc_id"]], r["n"]) for r in named if r["doc_id"] in want], "_row_a long, _row_b long, copies int, n long")
    out = with_copies(docs, decisions)
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == +Counter(want) + Counter(range(20, 40))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[_row_a#\d+L, _row_b", plan) and ("BroadcastExchange" in plan) == bool(places)


def test_one_row_of_each_class_stays(spark):
    same = " ".join(f"w{k}" for k in range(40))
    rows = [(1, same, "en", "a", 0), (1, same, "en", "a", 0), (1, same + " more", "en", "b", 0), (2, same, "de", "a", 0), (None, same, "en", "a", 0), (1, "quite another text of its own", "en", "a", 0), (None, "and one without an id", "en", "a", 0), (7, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_duplicates(spark, docs, DATA).collect()
    assert sorted((r["text"] or "")[:5] for r in kept) == ["", "and o", "quite", "w0 w1"]
    assert [r["doc_id"] for r in kept if (r["text"] or "").startswith("w0")] == [1]
    mixed = P.mixture(spark, docs, DATA).collect()
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r[0], r[1]) for r in rows}
