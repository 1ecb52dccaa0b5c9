"""A search moves blocks to the task of their range once; what is unfolded there is scored where it is."""

import tempfile

from corpusmill.operators import index


def test_no_posting_is_shuffled(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common common") for i in range(300)], "doc_id long, text string")
    built = index.build(docs, "doc_id", "file://" + tempfile.mkdtemp(), range_docs=20)
    terms = index.query_terms(spark.createDataFrame([(0, "w1 common"), (1, "w3 w5")], "q long, text string"), "q")
    rows = index.scored(built, terms, index.bounds(built, terms).select("query", "range"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(postings" in plan and "Exchange" not in plan.split("Generate explode(postings")[0]
    assert rows.count() > 300 and built.terms.where("term = 'common'").first().df == 300
