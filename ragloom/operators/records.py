"""Answers from records: each question meets the records that it can be about, by an index of their ids and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import structured
from ragloom.functions.text import fold, identifier, is_blank, person_name, trim_space

from .versions import stable

#: Code points of the parts by which names are looked up; shorter names are looked up whole.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Distinct parts of ``size`` code points of the text in a column."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda k: F.substring(text, k, size)))


def people(records: DataFrame) -> DataFrame:
    """``record_id, who``: the fields of records ``record_id, text``. Write it to keep it."""
    return records.select("record_id", structured.person(F.col("text")).alias("who"))


def answers(questions: DataFrame, known: DataFrame) -> DataFrame:
    """``query_id, record_id, answer`` of questions ``query_id, text`` that ask for a record: from the first record of :func:`people` that answers it, else that nothing was found.

    An id joins records by equality. A name is contained in the folded names of its records, so it joins them on that part of :data:`GRAM` code points which the fewest
    names hold, and containment is checked then. Repeated questions are answered once; null texts ask for nothing.
    """
    # what is read from texts is written, as the expressions are long
    known = stable(known, "people")
    asked = questions.filter(structured.asks_for_record(F.col("text"))).select("query_id", "text").distinct()
    keyed = stable(asked.withColumns({"number": F.lower(identifier(F.col("text"))), "name": fold(person_name(F.col("text")))}), "questions")
    by_id = known.withColumn("number", F.lower(trim_space(F.col("who.student_id")))).join(keyed.filter("number is not null").drop("name"), "number").drop("number")
    named = known.select("record_id", "who", fold(F.col("who.full_name")).alias("full")).filter(~is_blank(F.col("full")))
    wanted = keyed.filter(F.col("number").isNull() & ~is_blank(F.col("name"))).select("query_id", "text", "name").withColumn("size", F.least(F.lit(GRAM), F.length("name")))
    parts = wanted.withColumn("gram", F.explode(_grams(F.col("name"), F.col("size"))))
    index = named.select("record_id", F.explode(F.flatten(F.transform(F.array(*map(F.lit, range(1, GRAM + 1))), lambda n: _grams(F.col("full"), n)))).alias("gram")).distinct()
    index = index.join(parts.select("gram").distinct(), "gram", "left_semi")
    held = parts.join(index.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left")
    # a part that no name holds says that no record answers
    rarest = held.groupBy("query_id", "text", "name").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r"))
    met = rarest.filter("r.df > 0").select("query_id", "text", "name", F.col("r.gram").alias("gram")).join(index, "gram").join(named, "record_id").filter(F.contains("full", "name"))
    both = by_id.select("query_id", "text", "record_id", "who").unionByName(met.select("query_id", "text", "record_id", "who"))
    said = both.select("query_id", "record_id", structured.answer_from(F.col("text"), F.col("who")).alias("answer")).filter("answer is not null")
    first = said.groupBy("query_id").agg(F.min(F.struct("record_id", "answer")).alias("best"))
    none = keyed.select("query_id").distinct().join(first, "query_id", "left")
    return none.select("query_id", "best.record_id", F.coalesce("best.answer", F.lit(structured.NOT_FOUND)).alias("answer"))
