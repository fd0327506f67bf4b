"""Every question of the stated set is asked, with the answers that one question at a time gets."""

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.queries import every
from quern.queries.data import _chunks, _questions

DATA = "/root/testdata/sf0.001"


def test_tables_of_questions(spark):
    q = every()[0]
    asked = {r["question_id"]: r["question"] for r in _questions(spark, DATA, 12).collect()}
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert set(asked) == {r["item_id"] for r in items.where("item_id % 20 = 0").collect()} and len(asked) > 1
    assert {int(r["question"]) for r in q["ag21_hit_at_k"](spark, DATA).collect()} == set(asked)
    answers = {r["question_id"]: (r["grounded"], r["citations"]) for r in q["sl14_answer"](spark, DATA).collect()}
    got = {}
    for r in q["sl13_retrieve"](spark, DATA).collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["id"], r["score"]))
    one = X.Retrieval(_chunks(spark, DATA))
    assert set(got) == set(answers) == set(asked)
    for i in sorted(asked)[:2]:
        want = one.retrieve(asked[i]).select("rank", "id", F.round("score", 6).alias("score")).collect()
        assert [(a, b) for a, b, _ in sorted(got[i])] == [(r["rank"], r["id"]) for r in want] and all(abs(x[2] - r["score"]) < 1e-4 for x, r in zip(sorted(got[i]), want))
        a = one.answer(asked[i]).first()
        assert answers[i] == (a["grounded"], len(a["citations"]))
    unknown = spark.createDataFrame([(1, "zebra quagga xylophone")], "question_id long, question string")
    assert one.retrieve(unknown).count() == 0 and not one.answer(unknown).first()["grounded"]
