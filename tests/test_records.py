"""Answers from records against every question met with every record."""

from pyspark.sql import functions as F

from ragloom.functions import structured
from ragloom.operators import records
from ragloom.plans import fixtures


def test_answers_are_those_of_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    asked = fixtures.questions(spark, sf).unionByName(spark.createDataFrame([(-1, "của n"), (-2, None), (-3, "email của Lê"), (-4, "9" * 40), (-5, "hello"), (-6, "20000001 là của ai"), (-6, "20000001 là của ai"), (-7, "tên 0 của ai, của 1")], "query_id long, text string"))
    known = records.people(fixtures.records(spark, sf))
    found = {r.query_id: (r.record_id, r.answer) for r in records.answers(asked, known).collect()}
    met = asked.filter(structured.asks_for_record(F.col("text"))).crossJoin(known).select("query_id", "record_id", structured.answer_from(F.col("text"), F.col("who")).alias("answer"))
    best = met.groupBy("query_id").agg(F.min(F.when(F.col("answer").isNotNull(), F.struct("record_id", "answer"))).alias("b"))
    expected = {r.query_id: (r.b.record_id, r.b.answer) if r.b else (None, structured.NOT_FOUND) for r in best.collect()}
    assert found == expected and len({a for _, a in found.values()}) > 5 and (None, structured.NOT_FOUND) in found.values()
    plan = records.answers(asked, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "NestedLoop" not in plan


def test_no_rows(spark):
    none = spark.createDataFrame([], "record_id long, text string")
    assert records.answers(spark.createDataFrame([(1, "20000001 là của ai")], "query_id long, text string"), records.people(none)).collect()[0].answer == structured.NOT_FOUND
    assert records.answers(spark.createDataFrame([], "query_id long, text string"), records.people(none)).count() == 0
