"""Budgets, the mix, flows and shards."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wattsift.llm.flow import cheapest_transfers
from wattsift.llm.mixing import leaf_budgets, mix, taken
from wattsift.llm.reshard import Layout, manifest, place_blocks, read_shards, reshard, rewrite_affected, room_of


def ones():
    return {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}


def filled(budget, children):
    """Water-filling by its definition: {name: (cap, weight)} -> {name: real share}."""
    out, open_ = {}, {k for k, (_, w) in children.items() if w > 0}
    while open_:
        level = budget / sum(children[k][1] for k in open_)
        full = {k for k in open_ if children[k][0] <= level * children[k][1]}
        if not full:
            return out | {k: level * children[k][1] for k in open_} | {k: 0 for k, (_, w) in children.items() if w <= 0}
        for k in full:
            out[k] = children[k][0]
            budget -= children[k][0]
        open_ -= full
    return out | {k: 0 for k, (_, w) in children.items() if w <= 0}


@pytest.mark.parametrize("budget", [0, 100, 1000, 5000, 10**6])
def test_budgets(spark, budget):
    rng = random.Random(budget)
    leaves = [(d, x, s, rng.randrange(300)) for d in "ab" for x in ("en", "de") for s in ("s1", "s2", "s3")]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    weights = {"domain": F.when(F.col("domain") == "a", 3).otherwise(1), "lang": F.when(F.col("lang") == "en", 2).otherwise(1),
               "source": F.when(F.col("source") == "s3", 0).otherwise(1)}
    got = {(r.domain, r.lang, r.source): r.given for r in leaf_budgets(df, weights, budget, 2).collect()}
    caps = {(d, x, s): 2 * t for d, x, s, t in leaves}
    tops = filled(budget, {d: (sum(v for k, v in caps.items() if k[0] == d), 3 if d == "a" else 1) for d in "ab"})
    for d in "ab":
        mids = filled(int(tops[d]), {x: (sum(v for k, v in caps.items() if k[:2] == (d, x)), 2 if x == "en" else 1) for x in ("en", "de")})
        for x in mids:
            lows = filled(int(mids[x]), {s: (caps[d, x, s], 0 if s == "s3" else 1) for s in ("s1", "s2", "s3")})
            for s, v in lows.items():
                assert abs(got[d, x, s] - v) <= 3 and got[d, x, s] <= caps[d, x, s]


def test_mix_edges(edge, none):
    got = mix(edge, F.lit("d"), ones(), (1, 2))
    assert got.count() == edge.count() and got.columns.count("copies") == 1
    assert mix(none, F.lit("d"), ones()).count() == 0
    whole = mix(edge, F.col("lang"), ones(), (1, 1), max_epochs=1)
    n = F.regexp_count("text", F.lit(r"[^\s]+"))
    assert whole.where((F.col("copies") == 0) & (n > 0)).count() == 0  # one epoch of everything is everything
    assert taken(whole).columns == [c for c in edge.columns if c != "copies"]
    twice = mix(edge, F.lit("d"), ones(), (2, 1), max_epochs=2)
    assert {r.copies for r in twice.where(n > 0).collect()} == {2}


def test_mix_fine_buckets(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randrange(5), "en", "s" + str(k % 3 % 2)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    fine = mix(docs, F.lit("d"), ones(), (1, 3), bucket_rows=2).select("doc_id", "copies").orderBy("doc_id").collect()
    assert fine == mix(docs, F.lit("d"), ones(), (1, 3)).select("doc_id", "copies").orderBy("doc_id").collect()


def test_flow_moves_least():
    rng = random.Random(7)
    for _ in range(40):
        n, m = rng.randrange(1, 4), rng.randrange(1, 4)
        old, new = [rng.randrange(6) for _ in range(n)], [rng.randrange(8) for _ in range(m)]
        if sum(new) < sum(old):
            with pytest.raises(ValueError):
                cheapest_transfers(old, new)
            continue
        flow = cheapest_transfers(old, new)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == old
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= new[k] for k in range(m))
        moved = sum(v for (i, j), v in flow.items() if i != j)
        assert moved == sum(old) - sum(min(a, b) for a, b in zip(old, new))


def test_blocks_level_and_stay():
    rng = random.Random(8)
    blocks = [(k, k % 3, rng.randrange(1, 20)) for k in range(3000)]
    to = place_blocks(blocks, 3, 4)
    sizes, moved = Counter(), 0
    for b, i, s in blocks:
        sizes[to[b]] += s
        moved += s * (to[b] != i)
    total = sum(s for _, _, s in blocks)
    assert max(sizes.values()) - min(sizes.values()) <= 20
    assert moved <= total / 4 + 100  # the fourth shard has to be filled


def shards_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    return by


def test_reshard(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["é", "bb", "ccc"], k=rng.randrange(1, 60))) for _ in range(1500)] + ["copy of a text"] * 150 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = reshard(docs, Layout(old=3, new=4, blocks=200, slot_rows=7)).collect()
    assert len(got) == len(texts)
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
    sizes = {}
    for shard, rows in shards_of(got).items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        sizes[shard] = sum(r.size for r in rows)
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) < 1.02 * min(sizes.values())
    where = defaultdict(set)
    for r in got:
        where[texts[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_beyond_a_shard_is_cut(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the same text' ELSE md5(cast(id AS string)) END AS text")
    sizes = [sum(r.size for r in rows) for rows in shards_of(reshard(docs, Layout(old=3, new=8, blocks=64)).collect()).values()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)


def test_reshard_edges(edge, none):
    got = reshard(edge).collect()
    assert len(got) == edge.count()
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards_of(got).values())
    assert reshard(none).count() == 0


def test_only_affected_shards_are_written(spark, tmp_path):
    docs = spark.range(800).selectExpr("id AS doc_id", "md5(cast(id AS string)) AS text", "id AS shard")
    layout, path = Layout(old=3, new=4, blocks=100), str(tmp_path / "out")
    schema = docs.drop("shard").schema
    placed = {r.doc_id: r for r in reshard(docs, layout).collect()}
    want = {(k, r.shard) for k, r in placed.items()}
    read = lambda: {(r.doc_id, r.shard) for r in read_shards(spark, path, schema).collect()}
    affected = rewrite_affected(spark, docs, path, layout)
    assert 3 in affected and read() == want  # the first version has all shards
    assert set(itertools.chain.from_iterable((r.shard, r.old_shard) for r in placed.values() if r.shard != r.old_shard)) == set(affected)
    had = manifest(spark, path)
    (tmp_path / "out" / "data" / "other").mkdir()
    (tmp_path / "out" / "data" / "other" / "keep").write_text("x")
    assert rewrite_affected(spark, docs, path, layout) == affected and read() == want
    version, now = manifest(spark, path)
    assert version == had[0] + 1 and {n for n in now if now[n] == had[1][n]} == set(now) - set(affected)
    assert (tmp_path / "out" / "data" / "other" / "keep").exists()  # nothing else is touched


def test_rewriting_edges(spark, edge, none, tmp_path):
    path, schema = str(tmp_path / "out"), edge.drop("shard").schema
    rewrite_affected(spark, edge, path)
    assert read_shards(spark, path, schema).count() == edge.count()
    held = sorted(manifest(spark, path)[1])
    assert rewrite_affected(spark, none, path) == held  # they are empty now
    assert read_shards(spark, path, schema).count() == 0 and manifest(spark, path) == (2, {})


def test_a_write_without_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    docs = spark.range(50).selectExpr("id AS doc_id", "md5(cast(id AS string)) AS text")
    path, layout = str(tmp_path / "out"), Layout(old=2, new=3, blocks=20)
    rewrite_affected(spark, docs, path, layout)
    before = manifest(spark, path)
    docs.selectExpr("doc_id", "text", "1 AS shard").write.partitionBy("shard").parquet(f"{path}/data/half-done")
    assert manifest(spark, path) == before and read_shards(spark, path, docs.schema).count() == 50


def test_room_follows_capacities():
    assert room_of(10, 3) == [4, 3, 3]
    for total, caps in [(10, [2, 9, 9]), (100, [50, 50, 0]), (7, [3, 3, 3]), (0, [0, 5]), (21, [1, 20]), (30, [10, 10, 10])]:
        room = room_of(total, len(caps), caps)
        assert sum(room) == total and all(r <= c for r, c in zip(room, caps, strict=True))
        free = [r for r, c in zip(room, caps, strict=True) if r < c]
        assert not free or (max(free) - min(free) <= 1 and all(r <= min(free) + 1 for r in room))
    for total, caps in [(10, [2, 7]), (10, [20])]:
        with pytest.raises(ValueError):
            room_of(total, 2, caps)


def test_reshard_from_given_shards_to_given_capacities(spark):
    """Shards as the caller has them, some rows without; a text in all shards; the fewest bytes move, up to a block."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abc ", k=rng.randint(5, 60))), rng.choice([0, 0, 1, 2])) for i in range(3000)]
    rows += [(5000 + i, "the same text", i % 3) for i in range(90)] + [(6000, None, 1), (6001, "late", None), (6002, "odd", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int")
    layout = Layout(old=3, new=4, blocks=64, heavy=8)
    size = {i: len(t or "") + 1 for i, t, _ in rows}
    total = sum(size.values())
    caps = [total // 10, total, total // 3, total // 2]
    got = reshard(docs, layout, old="place", capacities=caps).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    given = {i: p for i, _, p in rows}
    assert all(r.old_shard == given[r.doc_id] for r in got if given[r.doc_id] in (0, 1, 2))
    assert all(r.old_shard in (0, 1, 2) and r.size == size[r.doc_id] for r in got)
    held = [sum(r.size for r in got if r.shard == j) for j in range(4)]
    assert all(h <= c for h, c in zip(held, caps, strict=True))
    assert len({r.shard for r in got if 5000 <= r.doc_id < 6000}) == 1
    for j in range(4):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sum(r.shard == j for r in got)))
    had = [sum(r.size for r in got if r.old_shard == i) for i in range(3)]
    least = sum(max(0, had[i] - room) for i, room in enumerate(room_of(total, 4, caps)[:3]))
    moved = sum(r.size for r in got if r.shard != r.old_shard)
    assert moved <= least + 90 * size[5000] + 4 * total // 64
    with pytest.raises(ValueError):
        reshard(docs, layout, capacities=[1, 1, 1, 1])
    assert reshard(docs.limit(0), layout, old="place", capacities=caps).count() == 0
