"""Query op3: the language of every document."""

from __future__ import annotations

from .common import table
from .language_id import fit_on_documents, fold, identify


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_on_documents(docs)
    rows = docs.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict = {}
