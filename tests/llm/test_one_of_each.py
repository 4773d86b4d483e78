"""One row of each group of similar documents, counted by rows: repeated rows, shared ids and null ids."""

from contactloom.llm import jaccard

A = " ".join(f"alpha{k}" for k in range(60))
NEAR_A = A + " omega"
B = " ".join(f"beta{k}" for k in range(60))
C = " ".join(f"gamma{k}" for k in range(60))
D = " ".join(f"delta{k}" for k in range(60))


def test_one_row_of_each(spark):
    rows = [(1, A, "x"), (1, A, "x"), (2, NEAR_A, "x")]  # a repeated row and a near copy
    rows += [(3, B, "x"), (4, B, "x"), (3, C, "x"), (0, C, "x")]  # 3 is first of one group and a copy in another
    rows += [(None, D, "x"), (None, D, "x"), (None, D + " omega", "x")]  # no other id in the group
    rows += [(5, NEAR_A, "x"), (None, A, "x")]
    rows += [(6, "", "x"), (6, "", "x"), (7, "", "x"), (8, None, "x"), (None, None, "x"), (None, None, "x"), (1, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string").repartition(3)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), (r["text"] or "-").split(" ")[0]) for r in kept.collect())
    assert got == sorted([("1", "alpha0"), ("3", "beta0"), ("0", "gamma0"), ("None", "delta0"), ("6", "-"), ("7", "-"), ("8", "-"), ("None", "-"), ("1", "")])
    again = jaccard.one_of_each(kept)
    assert again.count() == kept.count()
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_other_names(spark):
    docs = spark.createDataFrame([("2", A), ("1", A), ("1", A)], "id string, body string")
    assert [r["id"] for r in jaccard.one_of_each(docs, doc_col="id", text_col="body").collect()] == ["1"]
