"""A whole search on a fixture: a second round finds what the first can't, order is the reranker's, access holds throughout."""

from pyspark.sql import functions as F

from lorespan.operators import answering


def test_second_round_reaches_the_bridge(spark):
    texts = {
        1: (1, "Film", "The film Silent Harbor was directed by Maria Keller Brandt in spring"),
        2: (2, "Maria Keller Brandt", "Maria Keller Brandt was born in Lisbon"),
        3: (3, "Other", "harbor ships and silent nights"),
        4: (4, "Noise", "nothing of the kind"),
        9: (9, "Hidden", "Silent Harbor director birthplace secret"),
    }
    rows = [(i, d, t, x, len(x), d * 10, 40) for i, (d, t, x) in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, document long, title string, text string, tokens int, parent_id long, parent_tokens int")
    queries = spark.createDataFrame([(1, "Where was the director of Silent Harbor born"), (2, "zzz")], "query_id long, text string")
    seen = docs.filter("doc_id <> 9")
    by_length = lambda asked: asked.select("query_id", "index", (1.0 / F.length("text")).alias("score"))
    got = answering.answer_search(queries, seen, by_length).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {1} and all(r.rounds == 2 for r in got)
    assert {r.doc_id for r in got} == {1, 2, 3}
    # the reranker prefers short texts
    assert [r.doc_id for r in got] == sorted((1, 2, 3), key=lambda i: len(texts[i][2]))
    # graph and reports bring documents in, but never one that the reader may not see
    paths = spark.createDataFrame([(1, 4, 1, 1, "r1", None, "Silent Harbor director"), (1, 9, 2, 1, "r2", None, "Silent Harbor")], "query_id long, doc_id long, place int, depth int, relation string, parent_relation string, shown string")
    reports = spark.createDataFrame([(1, 9, 1), (1, 4, 2)], "query_id long, doc_id long, rank int")
    got = answering.answer_search(queries, seen, by_length, paths=paths, reports=reports).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4}
    assert answering.answer_search(queries, seen.limit(0), by_length).count() == 0
