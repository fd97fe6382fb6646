import datetime as dt

import numpy as np
from helpers import START, frame, skewed_rows
from pyspark.sql import functions as F

from spendlens import sinks, sources, views
from spendlens.functions import columns as C, text as X
from spendlens.operators import aggregates as A, alerts


def test_operators_from_sql(spark):
    views.register_transactions(frame(spark, skewed_rows(60)), "2024-01-31")
    total = spark.sql("SELECT sum(session_transaction_count) AS n FROM sessions WHERE user_id = 'hot'").first().n
    assert total == 20
    assert spark.sql("SELECT count(*) AS n FROM user_metrics JOIN sessions USING (user_id)").first().n > 0


def test_documents_are_added_once(spark, tmp_path):
    path = str(tmp_path / "corpus")
    docs = sources.seed_documents(spark, [("a", {"k": "1"}), ("b", {}), ("a", {"k": "1"})])
    sinks.add_documents(docs, path)
    sinks.add_documents(docs.unionByName(sources.seed_documents(spark, [("c", {})])), path)
    assert sorted(r.content for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_every_view_can_be_asked(spark):
    """All operators over tables by SQL; each view gives the rows of its frame."""
    at = START + dt.timedelta(days=3)
    names = views.register_transactions(frame(spark, skewed_rows(60)), at)
    names += views.register_aggregates(A.sliding_spend(frame(spark, skewed_rows(60)), "1 day", "1 day"), at)
    requests = [(START + dt.timedelta(seconds=20 * i), "ab"[i % 2], 500 if i % 3 == 0 else 200, i / 10) for i in range(90)]
    names += views.register_requests(spark.createDataFrame(requests, "ts timestamp, endpoint string, status_code int, duration_s double"))
    lag = [(START + dt.timedelta(minutes=i), "t", "g", 900 + 10 * i) for i in range(40)]
    names += views.register_lag(spark.createDataFrame(lag, "ts timestamp, topic string, consumer_group string, lag long"))
    names += views.register_accounts(spark.createDataFrame([("u", "CHECKING", 5.0)], "user_id string, account_type string, balance double"),
                                     spark.createDataFrame([("s", START)], "source string, ts timestamp"), at)
    names += views.register_corpus(sources.seed_documents(spark, [("word " * 400, {"k": "1"}), ("b", {})]))
    vectors = spark.createDataFrame([(i, [float(x) for x in np.eye(3)[i % 3]], "c") for i in range(6)],
                                    "vec_id long, embedding array<float>, category string")
    names += views.register_collection(vectors, vectors.selectExpr("vec_id AS query_id", "embedding"), 2)
    names += views.register_conversations(spark.createDataFrame([(1, "user", "x" * 40, "gpt-4")], "conv_id int, role string, text string, model string"),
                                          "conv_id")
    counts = spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in names))
    n = {r.name: r.n for r in counts.collect()}
    assert n.keys() == set(names) and len(names) > 60
    assert n["checked_transactions"] == n["valid_transactions"] + n["quarantined_transactions"] == 60
    assert n["high_lag_by_group"] == 1 and n["low_cash"] == 1 and n["silent_sources"] == 1 and n["token_costs"] == 1
    assert n["search_hits"] == 12 and n["similar_vectors"] == 12 and n["corpus_chunks"] == 4
    assert n["requests_by_status"] == 4 and n["recommendations"] == n["user_metrics"]


def test_functions_from_sql(spark):
    """SQL functions say what the column functions say."""
    views.register_functions(spark)
    texts = ["a@b.co", "+15551234567", "2024-01-31", "1.2.3.256", "1.2.3.4", "", None, "<a href='x'>\"/</a>", "Tax rule stock", "portfolio", "Aa1!aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = {"is_email": C.is_email, "is_phone": C.is_phone, "is_birth_date": C.is_birth_date, "is_ipv4": C.is_ipv4, "sanitize": C.sanitize,
            "document_category": C.document_category, "advice_route": C.advice_route, "snippet": C.snippet, "token_estimate": C.token_estimate,
            "password_strength": C.password_strength}
    for row in df.select(*[F.expr(f"{n}(t)").alias(f"{n}_sql") for n in same], *[f("t").alias(n) for n, f in same.items()]).collect():
        assert all(row[n] == row[f"{n}_sql"] for n in same), row
    numbers = spark.createDataFrame([(v, m, d) for v in (1.0, None, 6.0) for m in (0.0, 5.0) for d in (0.0, 2.0, None)], "a double, b double, c double")
    scored = numbers.selectExpr("a", "b", "c", "int(b = 0) AS unusual_category", "a AS spend_zscore", "c AS transaction_zscore")
    pairs = {"zscore(a, b, c)": C.zscore("a", "b", "c"), "ratio_or_zero(a, c)": C.ratio_or_zero("a", "c"),
             "alert_type(unusual_category, spend_zscore, transaction_zscore)": alerts.alert_type(),
             "alert_severity(unusual_category, spend_zscore, transaction_zscore)": alerts.severity()}
    for sql, column in pairs.items():
        assert scored.where(~F.expr(sql).eqNullSafe(column)).count() == 0, sql
    hours = spark.range(25).selectExpr("int(id) AS h", "int(id % 7 + 1) AS d", "timestamp_seconds(id * 1.5) AS ts")
    for sql, column in {"is_night(h)": C.is_night("h"), "is_weekend(d)": C.is_weekend("d"), "epoch_second(ts)": C.epoch_second("ts")}.items():
        assert hours.where(~F.expr(sql).eqNullSafe(column)).count() == 0, sql
    vectors = spark.createDataFrame([([1.0, 2.0], [2.0, 0.5]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert vectors.where(~F.expr("cosine_similarity(a, b)").eqNullSafe(X.cosine_similarity(F.col("a"), F.col("b")))).count() == 0


def test_chunks_of_a_table_argument(spark):
    views.register_functions(spark)
    views.register_corpus(sources.seed_documents(spark, [("word " * 400, {"k": "1"}), ("b", {}), ("", {})]))
    table = spark.sql("SELECT * FROM chunks(TABLE(SELECT doc_id, content FROM corpus))")
    wanted = spark.sql("SELECT doc_id, chunk_no, chunk FROM corpus_chunks")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, wanted.collect())) and table.count() == 4
