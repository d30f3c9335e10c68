"""Words, shingles, decontamination and the n-gram join against plain Python."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattsift.llm.connected import components
from wattsift.llm.decontaminate import compile_patterns, find_contamination
from wattsift.llm.ngram_join import near_duplicates
from wattsift.llm.words import ALNUM, NOT_BLANK, Words

LOWER = {i: i + 32 for i in range(65, 91)}
NON_BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


def random_texts(n, seed, alphabet="aB é\n.9ñ"):
    rng = random.Random(seed)
    return [None if rng.random() < 0.1 else "".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("table,pattern", [(NOT_BLANK, NON_BLANK), (ALNUM, LETTERS)])
def test_words_and_hashes(table, pattern):
    texts = random_texts(400, 1)
    found = Words(table).of(pa.array(texts, pa.string()))
    want = [low_words(t, pattern) for t in texts]
    assert found.counts.tolist() == [len(w) for w in want]
    named = {}
    for word, h in zip(itertools.chain(*want), found.hashes()):
        assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)


def test_windows_of_short_texts_are_whole():
    found = Words(NOT_BLANK).of(pa.array(["a b c", "a b c d e f", "", None, "A  B\tC"]))
    values, owner = found.windows(5)
    assert owner.tolist() == [0, 1, 1, 4]
    assert values[0] == values[3] and values[1] != values[2]


def brute_contamination(text, items, window):
    words = low_words(text, LETTERS)
    hit, names = set(), set()
    for name, body in items:
        item = low_words(body, LETTERS)
        k = min(window, len(item))
        for p in range(len(item) - k + 1) if k else ():
            for q in range(len(words) - k + 1):
                if words[q : q + k] == item[p : p + k]:
                    hit |= set(range(q, q + k))
                    names.add(name)
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, block_bytes):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choices(["ab", "Cd", "e.f", "gé", "h"], k=n))
    items = [(str(k), say(rng.randrange(0, 9))) for k in range(12)] + [("12", None), ("3", "ab cd zz yy xx ww")]
    texts = [say(rng.randrange(60)) for _ in range(60)] + [None, "", "ab " * 500]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items + [(None, "h h h")], "item_id string, text string")
    got = find_contamination(docs, bench, window=4, block_bytes=block_bytes).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        assert (row.n_words, row.n_hit, sorted(row["items"])) == brute_contamination(text, items, 4)
        assert row.contaminated == (row.n_hit > 0)


def test_no_patterns():
    assert compile_patterns(pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())}), 10) == []


def test_contamination_edges(edge, none, spark):
    bench = spark.createDataFrame([(1, "three four five"), (2, None)], "item_id bigint, text string")
    got = find_contamination(edge, bench)
    assert got.count() == edge.count() and got.columns.count("contaminated") == 1
    assert got.where("contaminated").count() == 3
    assert find_contamination(none, bench).count() == 0
    assert find_contamination(edge, bench.limit(0)).where("contaminated").count() == 0


def brute_components(texts):
    sets = {}
    for k, t in texts:
        w = low_words(t, NON_BLANK)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_copies(seed, families=12, size=9):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    out = []
    for f in range(families):
        base = [f"w{rng.randrange(60 if f % 3 else 4000)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            if rng.random() < 0.3:
                own = own + passage if len(own) < 40 else own[: len(own) // 2] + passage + own[len(own) // 2 :]
            out.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
    return out


@pytest.mark.parametrize("seed,options", [
    (1, {}),
    (2, {"range_tokens": 100, "block_sets": 3, "one_in": 1, "at_least": 2}),
    (3, {"range_tokens": 500, "block_sets": 1, "one_in": 1, "at_least": 4, "most": 50}),
])
def test_near_duplicates(spark, seed, options):
    texts = list(enumerate([*near_copies(seed), None, "", "one", "ONE", "a b c d e", "a b c d"], 100))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, **options).collect()}
    want = brute_components(texts)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20  # there is something to find


def test_near_duplicates_edges(edge, none):
    got = near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].component_id == 1 and by_id[3].n_shingles == 0 and by_id[3].component_id == 3
    assert by_id[6].n_shingles == 1 and by_id[7].component_id == 7
    assert near_duplicates(none).count() == 0


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(200)
    edges = [(int(order[k]), int(order[k + 1])) for k in range(120)] + [(int(order[k]), int(order[150])) for k in range(151, 200)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).distinct().collect())
    assert got == {int(order[k]): int(min(order[:121])) for k in range(121)} | {int(order[k]): int(min(order[150:])) for k in range(150, 200)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_frequent_lists_change_nothing(spark):
    texts = [(k, t) for k, t in enumerate(near_copies(9))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    plain = near_duplicates(docs).orderBy("doc_id").collect()
    listed = near_duplicates(docs, one_in=2, at_least=2).withColumn("n", F.lit(1)).drop("n").orderBy("doc_id").collect()
    assert plain == listed
