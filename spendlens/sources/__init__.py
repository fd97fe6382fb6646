"""Readers: transaction streams and tables, documents, per-user feeds."""

from spendlens.sources.documents import load_documents, seed_documents
from spendlens.sources.transactions import (
    decode,
    decode_avro,
    decode_json,
    flatten,
    ingest_json,
    read_jdbc_transactions,
    read_kafka,
    read_stream,
    read_training_data,
    user_feed,
)

__all__ = [
    "decode", "decode_avro", "decode_json", "flatten", "ingest_json", "load_documents", "read_jdbc_transactions",
    "read_kafka", "read_stream", "read_training_data", "seed_documents", "user_feed",
]
