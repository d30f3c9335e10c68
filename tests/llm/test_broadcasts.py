"""What executors get by broadcast must be readable without the package."""

import pickle

import pytest
from pyspark import SparkContext

from wattsift.llm.decontaminate import find_contamination
from wattsift.llm.pii import find_pii
from wattsift.llm.quality import classify
from wattsift.llm.registry import table
from wattsift.llm.token_counts import count_tokens
from wattsift.llm.toxicity import score
from tests.llm.conftest import SF_DIR
from tests.llm.test_token_counts import MODEL

RUNS = {
    "op1": lambda spark, docs, labels: find_contamination(docs, table(spark, SF_DIR, "benchmark")),
    "op3": lambda spark, docs, labels: find_pii(docs),
    "op7": lambda spark, docs, labels: score(docs, labels),
    "op10": lambda spark, docs, labels: classify(docs, labels),
    "op11": lambda spark, docs, labels: count_tokens(docs, MODEL),
}


@pytest.mark.parametrize("name", RUNS)
def test_values_name_no_class_of_the_package(spark, docs_001, labels_001, monkeypatch, name):
    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or send(self, value))
    few = docs_001.limit(20)
    assert RUNS[name](spark, few, labels_001).count() == 20
    assert sent and all(b"wattsift" not in pickle.dumps(value) for value in sent)
