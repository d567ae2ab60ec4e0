"""BM25: scores against a plain count, and where rows are exchanged."""

import math
import re
from collections import Counter, defaultdict

from assayline.operators import retrieval


def test_bm25_scores_stay_where_texts_are(spark):
    rows = [(1, "red red fox"), (2, "blue fox, old dog"), (2, "red dog ran off"), (3, None), (4, ""), (None, "old red barn"), (5, "nothing of it")]
    asked = [(10, "Red fox red"), (11, "dog old"), (12, "absent")]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    tf = Counter((i, len(words(t)), w) for i, t in rows for w in words(t))
    mean, df = sum(len(words(t)) for _, t in rows) / len(rows), Counter(w for _, _, w in tf)
    want = defaultdict(float)
    for q, text in asked:
        for (i, dl, w), n in tf.items():
            if w in words(text):
                want[q, i] += math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / mean))
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    got = retrieval.bm25(docs, queries, 10)
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in got.collect()} == {k: round(v, 6) for k, v in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(query_id", plan) and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)
    none = retrieval.bm25(docs.limit(0), queries, 10)
    assert none.count() == 0


def test_tasks_by_pairs(spark):
    assert retrieval.task_count(spark, 0) == 4
    assert retrieval.task_count(spark, 500_000_001) == 1001
