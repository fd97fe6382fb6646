"""The operators for use from SQL: temporary views, scalar functions, and table functions.

Views are lazy: nothing runs before one is queried. Scalar functions are SQL expressions, which Spark puts into the plan of the
query that calls them, so they run like built-in ones. ``chunks`` is a table function over Arrow batches of a table argument:

    SELECT * FROM chunks(TABLE(SELECT doc_id, content FROM corpus))
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spendlens import domain
from spendlens.functions import columns as C, text as X
from spendlens.operators import (
    aggregates as A, alerts, anomaly, fraud, metrics as Q, normalize as N, portfolio as P, retrieval as R, sketches as S,
    timeline as L, vector_index as V)


def register(frames: Mapping[str, DataFrame]) -> list[str]:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return list(frames)


def register_transactions(tx: DataFrame, as_of=None) -> list[str]:
    """``transactions`` and everything that is computed from it."""
    return register({
        "transactions": tx,
        "user_spending_aggregates": A.spending_velocity(A.sliding_spend(tx)),
        "minute_spend": A.tumbling_spend(tx),
        "hourly_spend": A.hourly_spend(tx),
        "hourly_devices": A.hourly_devices(tx),
        "sessions": L.sessions(tx),
        "session_transactions": L.session_transactions(tx),
        "trailing_spend": L.trailing_spend(tx),
        "user_metrics": A.user_metrics(tx, as_of=as_of),
        "anomaly_features": anomaly.transaction_features(tx),
        "fraud_features": fraud.fraud_features(tx),
        "transaction_rate": Q.transaction_rate(tx),
        "fraud_rate": Q.fraud_rate(tx),
        "category_shares": Q.category_shares(tx),
        "daily_change": Q.daily_change(tx),
        "checked_transactions": N.validate(tx),
        "valid_transactions": N.split_valid(tx)[0],
        "quarantined_transactions": N.split_valid(tx)[1],
        "masked_transactions": N.mask_sensitive(tx),
        "sliding_spend": A.sliding_spend(tx),
        "session_members": A.window_members(tx, ["transaction_id", "amount"], "1 hour"),
        "user_profiles": A.user_profile(tx),
        "category_distribution": A.category_distribution(tx),
        "velocity_metrics": L.velocity_metrics(tx),
        "behaviour_features": L.behaviour_features(tx),
        "recent_history": L.recent_history(tx),
        "daily_moving_average": L.daily_moving_average(tx),
        "newest_transactions": A.newest_per_user(tx, 20),
        "pattern_summary": A.pattern_summary(tx, "user_id"),
        "minute_sketches": S.minute_sketches(tx),
        "high_volume": Q.high_volume(tx),
        "high_fraud_rate": Q.high_fraud_rate(tx),
        "transactions_by_status": Q.counts_by(tx, "status", "currency"),
        "recommendations": alerts.recommendations(A.user_metrics(tx, as_of=as_of)),
    })


def register_aggregates(aggregates: DataFrame, as_of=None) -> list[str]:
    """``user_aggregates`` (windows with their sums), baselines, anomalies and alerts."""
    found = anomaly.behaviour_anomalies(aggregates, as_of)
    raised = alerts.anomaly_alerts(found, as_of, stable_ids=True)
    return register({
        "user_aggregates": aggregates,
        "user_baselines": A.user_baseline(aggregates),
        "scored_windows": anomaly.scored_windows(aggregates, as_of),
        "behaviour_anomalies": found,
        "anomaly_alerts": raised,
        "active_alerts": alerts.active_alerts(raised),
        "high_velocity_alerts": alerts.high_velocity_alerts(A.spending_velocity(aggregates), as_of=as_of),
    })


def register_requests(requests: DataFrame, keys: Sequence[str] = ("endpoint",)) -> list[str]:
    """``requests`` (ts, endpoint, status_code, duration_s), their series and the rules on them."""
    return register({
        "requests": requests,
        "error_share": Q.error_share(requests, keys=keys),
        "high_error_rate": Q.high_error_rate(requests, keys=keys),
        "latency_histogram_p95": Q.histogram_quantile(requests, keys=keys),
        "slow_responses": Q.slow_responses(requests, keys=keys),
        "latency_p95": Q.approximate_quantile(requests, keys=keys),
        "latency_sketches": S.minute_quantiles(requests, keys),
        "requests_by_status": Q.counts_by(requests, *keys, "status_code"),
    })


def register_lag(lag: DataFrame) -> list[str]:
    """``lag`` (ts, topic, consumer_group, lag) and the rules on it."""
    return register({
        "lag": lag, "lag_by_group": Q.lag_levels(lag, "consumer_group", "avg"), "lag_by_topic": Q.lag_levels(lag, "topic", "sum"),
        "high_lag_by_group": Q.high_lag(lag, "consumer_group", "avg"), "high_lag_by_topic": Q.high_lag(lag, "topic", "sum")})


def register_accounts(accounts: DataFrame, beats: DataFrame | None = None, as_of=None) -> list[str]:
    """``accounts``, the users who are low in cash, and with signs of life (source, ts) the sources without any."""
    frames = {"accounts": accounts, "low_cash": Q.low_cash(accounts)}
    return register(frames if beats is None else {**frames, "beats": beats, "silent_sources": Q.silent_sources(beats, as_of)})


def register_corpus(corpus: DataFrame) -> list[str]:
    """``corpus`` (doc_id, content, metadata) and its chunks."""
    return register({"corpus": corpus, "corpus_chunks": R.chunk_documents(corpus)})


def register_collection(collection: DataFrame, queries: DataFrame | None = None, k: int = 5, threshold: float = 0.7,
                        index: V.VectorIndex | None = None) -> list[str]:
    """``collection`` (vec_id, embedding, category), what it holds, and the hits of ``queries``, by an index if there is one."""
    frames = {"collection": collection, "collection_info": R.collection_info(collection)}
    if queries is not None:
        found = R.search(collection, queries, k, threshold) if index is None else V.search(index, queries, k, threshold)
        alike = R.similar(collection, queries, threshold) if index is None else V.similar(index, queries, threshold)
        frames |= {"queries": queries, "search_hits": found, "similar_vectors": alike}
    return register(frames)


def register_conversations(messages: DataFrame, *keys: str) -> list[str]:
    """``messages`` (role, text, model and the keys) with tokens and costs per key."""
    return register({"messages": messages, "token_costs": R.token_costs(messages, *keys)})


def register_portfolio(positions: DataFrame, profiles: DataFrame) -> list[str]:
    """``positions``, ``risk_profiles`` and the portfolio analyses."""
    return register({"positions": positions, "risk_profiles": profiles, **P.analyze(positions, profiles)})


# --- functions ------------------------------------------------------------------------------------------

def _text(value: str) -> str:
    return "r\"" + value + "\"" if '"' not in value else "r'" + value + "'"


def _keywords(text: str, rules, default: str) -> str:
    tests = [" OR ".join(f"contains(lower({text}), '{w}')" for w in words) for _, words in rules]
    return "CASE " + " ".join(f"WHEN {t} THEN '{label}'" for t, (label, _) in zip(tests, rules)) + f" ELSE '{default}' END"


#: Name: (parameters, result, body). They say what the functions of the same names in ``functions.columns`` and ``alerts`` say.
FUNCTIONS = {
    "epoch_second": ("ts TIMESTAMP", "BIGINT", "CAST(ts AS BIGINT)"),
    "is_weekend": ("day_of_week INT", "INT", "CASE WHEN day_of_week IN (1, 7) THEN 1 ELSE 0 END"),
    "is_night": ("hour INT", "INT", "CASE WHEN hour >= 22 OR hour <= 6 THEN 1 ELSE 0 END"),
    "zscore": ("value DOUBLE, mean DOUBLE, deviation DOUBLE", "DOUBLE", "try_divide(value - mean, deviation)"),
    "ratio_or_zero": ("numerator DOUBLE, denominator DOUBLE", "DOUBLE",
                      "CASE WHEN denominator > 0 THEN numerator / denominator ELSE 0.0D END"),
    "sanitize": ("content STRING", "STRING",
                 "replace(replace(replace(replace(replace(coalesce(content, ''), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
                 "\"'\", '&#x27;'), '/', '&#x2F;')"),
    "is_email": ("content STRING", "BOOLEAN", f"regexp_like(content, {_text(C.EMAIL)})"),
    "is_phone": ("content STRING", "BOOLEAN", f"regexp_like(content, {_text(C.PHONE)})"),
    "is_birth_date": ("content STRING", "BOOLEAN", f"regexp_like(content, {_text(C.BIRTH_DATE)})"),
    "is_ipv4": ("content STRING", "BOOLEAN", f"regexp_like(content, {_text(C.IPV4)})"),
    "password_strength": (
        "content STRING", "STRUCT<length BOOLEAN, uppercase BOOLEAN, lowercase BOOLEAN, digit BOOLEAN, special BOOLEAN>",
        "named_struct('length', length(content) >= 8, 'uppercase', regexp_like(content, '[A-Z]'), 'lowercase', regexp_like(content, '[a-z]'), "
        f"'digit', regexp_like(content, '[0-9]'), 'special', regexp_like(content, {_text(C.SPECIAL_CHARACTERS)}))"),
    "document_category": ("name STRING", "STRING", _keywords("name", domain.DOCUMENT_CATEGORIES, "general")),
    "advice_route": ("question STRING", "STRING", _keywords("question", domain.ADVICE_ROUTES, "general_financial_advisor")),
    "snippet": ("content STRING", "STRING", "concat(substring(content, 1, 500), '...')"),
    "token_estimate": ("content STRING", "BIGINT", "CAST(floor(length(content) / 4) AS BIGINT)"),
    "cosine_similarity": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (t, p) -> t + p), sqrt(aggregate(a, 0.0D, (t, x) -> t + x * x)) "
        "* sqrt(aggregate(b, 0.0D, (t, x) -> t + x * x)))"),
    "alert_type": ("unusual_category INT, spend_zscore DOUBLE, transaction_zscore DOUBLE", "STRING",
                   "CASE WHEN unusual_category = 1 THEN 'UNUSUAL_CATEGORY' WHEN spend_zscore > 5 THEN 'HIGH_SPENDING' "
                   "WHEN transaction_zscore > 5 THEN 'HIGH_FREQUENCY' ELSE 'SUSPICIOUS_PATTERN' END"),
    "alert_severity": ("unusual_category INT, spend_zscore DOUBLE, transaction_zscore DOUBLE", "STRING",
                       "CASE WHEN spend_zscore > 5 OR transaction_zscore > 5 THEN 'HIGH' WHEN unusual_category = 1 THEN 'MEDIUM' "
                       "ELSE 'LOW' END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """The scalar functions above, and the table function ``chunks``."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("chunks", F.arrow_udtf(Chunks, returnType="doc_id string, chunk_no int, chunk string"))
    return [*FUNCTIONS, "chunks"]


class Chunks:
    """The chunks of the documents (doc_id, content) of a table argument."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        found = [(str(d), i, c) for d, t in zip(rows["doc_id"].to_pylist(), rows["content"].to_pylist()) if t
                 for i, c in enumerate(X.split_text(t))]
        yield pa.table({"doc_id": pa.array([f[0] for f in found], pa.string()), "chunk_no": pa.array([f[1] for f in found], pa.int32()),
                        "chunk": pa.array([f[2] for f in found], pa.string())})
