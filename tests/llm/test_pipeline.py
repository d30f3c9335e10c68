"""The pipeline's stages, each against a plain version on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.conftest import SF_DIR
from tests.llm.test_text_search import brute_components, brute_contamination
from wattsift.llm.registry import table
from wattsift.session import written


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, stage in P.STAGES:
        after = written(stage(spark, docs, SF_DIR), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return [r[0] for r in df.select("doc_id").orderBy("doc_id").collect()]


def test_names_and_columns(steps):
    assert len(P.STAGES) == 5
    assert all(after.columns == docs.columns for docs, after in steps[:-1])
    assert all(after.count() > 0 for _, after in steps)


def test_quality(spark, steps):
    docs, after = steps[0]
    labels = table(spark, SF_DIR, "labels")
    assert after.join(labels.where("quality = 0"), "doc_id").count() == 0
    assert docs.join(labels.where("quality = 1"), "doc_id").count() == after.join(labels.where("quality = 1"), "doc_id").count()


def test_near_duplicates(steps):
    docs, after = steps[1]
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert ids(after) == sorted(k for k, (_, c) in want.items() if k == c)


def test_decontamination(spark, steps):
    docs, after = steps[2]
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    assert ids(after) == sorted(r.doc_id for r in docs.collect() if not brute_contamination(r.text, items, 10)[1])


def test_mix(steps):
    docs, after = steps[3]
    n = F.sum(F.regexp_count("text", F.lit(r"[^\s]+")))
    assert after.agg(n).first()[0] <= docs.agg(n).first()[0]
    assert set(ids(after)) <= set(ids(docs))
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= P.MIX_EPOCHS


def test_shards(steps):
    docs, after = steps[4]
    assert ids(after) == ids(docs)
    for shard in after.select("shard").distinct().collect():
        slots = sorted(r.slot for r in after.where(F.col("shard") == shard[0]).collect())
        assert slots == list(range(len(slots)))


def test_stages_take_edges(spark, edge, none):
    plain = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        assert stage(spark, plain, SF_DIR).count() <= 2 * plain.count()
        assert stage(spark, none.select(*plain.columns), SF_DIR).count() == 0
    kept = P.keep_one_of_each(spark, plain, SF_DIR)
    assert kept.where("doc_id IN (1, 2)").count() == 1 and kept.where("doc_id IS NULL").count() == 2


def words(seed: int, n: int = 60) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def near(text: list[str], at: int) -> str:
    return " ".join([*text[:at], "other", *text[at + 1 :]])


def test_texts_that_share_an_id_are_told_apart(spark):
    """A unique text under the id of a near copy stays, and so do unique texts without an id."""
    one, two, three = words(1), words(2), words(3)
    rows = [
        (1, " ".join(one)), (2, near(one, 58)), (2, " ".join(two)), (3, "a b c"), (3, "a b c"), (None, near(one, 1)),
        (None, " ".join(three)), (None, near(three, 59)), (4, None), (4, ""), (5, " ".join(two)), (5, " ".join(two)),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = sorted(((r.doc_id, r.text) for r in P.keep_one_of_each(spark, docs, SF_DIR).collect()), key=repr)
    left = [r for r in kept if r[0] is None]
    assert len(left) == 1 and left[0][1] in {" ".join(three), near(three, 59)}  # one of the two without an id
    assert sorted((r for r in kept if r[0] is not None), key=repr) == sorted(
        [(1, " ".join(one)), (2, " ".join(two)), (3, "a b c"), (4, None), (4, "")], key=repr
    )
