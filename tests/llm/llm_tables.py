"""Small tables of documents."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    """A table of documents; ``texts`` are texts, or (id, text) pairs."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, lang, "src0", None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, DOCUMENTS)
