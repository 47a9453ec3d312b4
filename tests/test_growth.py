"""How many rows a step makes: joins must not grow with the square of what is frequent."""

from pyspark.sql import functions as F

from evidra.operators import fulltext


def most_rows(spark, df):
    """The most rows that one operator of the plan of df made, run without adaptive planning."""

    def walk(plan):
        m = plan.metrics().get("numOutputRows")
        kids = plan.children()
        return max([m.get().value() if m.isDefined() else 0, *(walk(kids.apply(k)) for k in range(kids.size()))])

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        return walk(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_frequent_words_make_no_row_for_each_query(spark):
    texts = spark.range(300).select("id", F.concat(F.lit("the of and to in is on by at as "), F.concat(F.lit("rare"), F.col("id"))).alias("t"))
    said = F.concat(F.lit("the of and to in is on by at as "), F.concat(F.lit("rare"), F.col("id")))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.explode(F.split(said, " ")).alias("term"))
    found = fulltext.matches_by_rarest(queries, texts, "id", "t")
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(k, k) for k in range(300)]
    assert most_rows(spark, fulltext.matches_by_rarest(queries, texts, "id", "t")) < 10_000  # 300 x 300 x 10 by a join on every word


def test_rows_of_one_id_are_one_text(spark):
    texts = spark.createDataFrame([(1, "a b"), (1, "c a"), (2, "a c")], "id long, t string")
    queries = spark.createDataFrame([(9, "a"), (9, "b"), (9, "c"), (8, "c"), (7, "zz"), (7, "a")], "query_id long, term string")
    got, plain = ({(r.query_id, r.id): r.density for r in f(queries, texts, "id", "t").collect()} for f in (fulltext.matches_by_rarest, fulltext.matches))
    assert sorted(got) == [(8, 1), (8, 2), (9, 1)] and got == plain


def test_words_that_nobody_asks_for_are_not_shuffled(spark):
    """The asked terms go to the texts, whatever the planner knows of their sizes: no sort-merge join shuffles all words."""
    texts = spark.createDataFrame([(1, "a b c"), (2, "a c d")], "id long, t string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = fulltext.rarest_terms(texts, texts, "id", "t", 2)
        found = fulltext.matches(asked, texts, "id", "t")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.query_id, r.id) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, 1), (2, 2)} and "BroadcastHashJoin [term" in plan
