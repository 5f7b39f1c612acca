"""Long credentials and texts with many matches."""

from __future__ import annotations

from hazeline.llm import pii


def test_whole_credentials(spark):
    key = "".join("aZ9_x.Q7"[i % 8] for i in range(500))
    docs = spark.createDataFrame([(1, f"token={key} end"), (2, f"secret: {key[:30]}")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert got == {1: "other:0:506", 2: "other:0:38"}


def test_many_matches_in_one_text(spark):
    n = 20_000
    text = " ".join(f"u{i}@host{i % 7}.org" for i in range(n))
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_email"] == n and row["spans"].count(",") == n - 1
