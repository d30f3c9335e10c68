"""Match the prompts of two corpora, in any script: equal after folding, else within an edit distance.

Near matches meet on marks: hashes of places that a text's own characters choose. An edit changes few of them, so
texts within d edits share one of their first 3 d + 1 marks in a common order, if both have as many.

Texts with few marks (short or repetitive) use the pigeonhole rule: cut a text into d + 1 segments, and any text within
d edits holds one of them unchanged, shifted by at most d. Either becomes an equi-join key together with the text
length, so no pair within d is missed and texts are compared only where a key agrees.
"""

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.functions.distance import edit_distance
from wattsift.functions.text import SIGNATURE, comparable, folded_digest, marks_needed
from wattsift.session import written


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """1-based start and size of segment ``i`` (0-based); cuts depend on the length alone."""
    start = F.floor(length * i / F.lit(parts)).cast("int")
    end = F.floor(length * (i + 1) / F.lit(parts)).cast("int")
    return start + 1, end - start


WIDTH = 4  # bytes of a character in UTF-32


def _part(text: Column, start: Column, size: Column) -> Column:
    return text.substr((start - 1) * WIDTH + 1, size * WIDTH)


MEASURES = ["length", *SIGNATURE]  # one edit changes each by at most one


def _keyed(texts: DataFrame, keys: Column) -> DataFrame:
    """One row per key, with the measures; the text itself stays behind."""
    # The outer form keeps the optimiser from also evaluating the keys in a filter on the text's scan.
    return texts.select("id", *MEASURES, F.explode_outer(keys).alias("key"))


def _cut(texts: DataFrame, keys: Callable[[Column, Column], Column]) -> DataFrame:
    """Keys of the texts with few marks, from parts of the text.

    Texts are cut as UTF-32, where any part is found without walking the text.
    """
    wide = texts.where("norm IS NOT NULL").withColumn("wide", F.encode("norm", "UTF-32"))
    return _keyed(wide, keys(F.col("wide"), F.col("length")))


def _classes(value: Column, d: int, width: int) -> Column:
    """The classes of ``width`` values each that hold a value within ``d``."""
    return F.sequence(F.floor((value - d) / width), F.floor((value + d) / width))


def _marked(texts: DataFrame, d: int, around: int) -> DataFrame:
    """Keys of a text's marks, each with the classes of the lengths ``around`` its own."""
    lengths = _classes(F.col("length"), around, 10 * d + 4)
    keys = F.transform(lengths, lambda n: F.transform("marks", lambda mark: F.xxhash64(n, mark)))
    return _keyed(texts.where(F.size("marks") >= marks_needed(d)[0]), F.flatten(keys))


def _indexed(texts: DataFrame, d: int) -> DataFrame:
    """Keys of every text's own segments or marks."""

    def keys(text: Column, length: Column) -> Column:
        def key(i: Column) -> Column:
            return F.xxhash64(length, i, _part(text, *_segment(length, i, d + 1)))

        return F.transform(F.sequence(F.lit(0), F.lit(d)), key)

    return _cut(texts, keys).unionByName(_marked(texts, d, 0))


def _probed(texts: DataFrame, d: int) -> DataFrame:
    """Keys of the places where a text of each near length could have a segment unchanged, and of marks.

    Some segment ``i`` is shared with at most ``i`` edits before it and ``d - i`` after it, which
    bounds its shift from both ends.
    """

    def keys(text: Column, mine: Column) -> Column:
        def places(near: Column, i: Column) -> Column:
            start, size = _segment(near, i, d + 1)
            gap = mine - near
            low = F.greatest(start - i, start + gap - (F.lit(d) - i), F.lit(1))
            high = F.least(start + i, start + gap + (F.lit(d) - i), mine - size + 1)
            at_all = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(at_all, lambda at: F.xxhash64(near, i, _part(text, at, size)))

        def segments(near: Column) -> Column:
            return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: places(near, i)))

        return F.flatten(F.transform(F.sequence(F.greatest(mine - d, F.lit(0)), mine + d), segments))

    return _cut(texts, keys).unionByName(_marked(texts, d, d))


def _candidates(left: DataFrame, right: DataFrame, d: int, busy: int) -> DataFrame:
    """Distinct (id_a, id_b) that share a key and whose measures differ by at most d each.

    A key held by more than ``busy`` texts (a common opening, say) is dealt into cells by classes of the signature's
    counts: the probing side lists the classes within d. All pairs of a cell are met, whatever ``busy`` is.
    """
    crowded = right.groupBy("key").count().where(F.col("count") > busy).select("key", F.lit(True).alias("hot"))
    hot = written(crowded, "crowded")

    def dealt(rows: DataFrame, around: int) -> DataFrame:
        cells = F.array("key")
        for values in (_classes(F.col(count), around, 2 * d + 1) for count in SIGNATURE):
            cells = F.flatten(F.transform(cells, lambda c: F.transform(values, lambda n: F.xxhash64(c, n))))  # noqa: B023
        cell = F.explode_outer(F.when(F.col("hot"), cells).otherwise(F.array("key"))).alias("cell")
        return rows.join(hot, "key", "left").select("id", *MEASURES, cell)

    a, b = dealt(left, d).alias("a"), dealt(right, 0).alias("b")
    near = reduce(and_, (F.abs(F.col(f"a.{m}") - F.col(f"b.{m}")) <= d for m in MEASURES))
    # Sizes are estimated ahead of the explosion into keys; a merge join keeps them off a broadcast.
    pairs = a.join(b.hint("merge"), (F.col("a.cell") == F.col("b.cell")) & near)
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def _folded(prompts: DataFrame, d: int) -> DataFrame:
    """The prompts with anything left after folding: id, norm, digest, measures and marks."""
    rows = prompts.select(F.col("prompt_id").alias("id"), comparable(d)(F.col("prompt")).alias("f"))
    return rows.select("id", "f.*").filter("norm <> ''")


def prompt_classes(prompts: DataFrame) -> DataFrame:
    """(prompt_id, id) of every prompt: the lowest id among the prompts that fold to the same text, which ``reconcile``
    names it by. A prompt that is NULL or folds to nothing has a NULL id.

    Only ids and digests of the folded texts are shuffled; texts are read and folded once. The least ids are found with
    partial sums ahead of the shuffle, and come back by a join that Spark can split where most prompts are copies of one.
    """
    rows = written(prompts.select("prompt_id", folded_digest()(F.col("prompt")).alias("digest")), "digests")
    named = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("prompt_id").alias("id"))
    return rows.join(named, "digest", "left").select("prompt_id", "id")


def reconcile(a: DataFrame, b: DataFrame, max_distance: int = 2, busy: int = 1000) -> DataFrame:
    """One row per matched (text of a, text of b): id_a, id_b, distance.

    Inputs have ``prompt_id`` and ``prompt``. Copies of a folded text are one text, named by its lowest
    id, to which ``prompt_classes`` leads from every copy. Texts equal in both corpora match at distance 0; the
    others match at 1..max_distance, all of their partners kept. Distances count characters, not bytes. A text
    with nothing left after folding (signs only) matches nothing.
    """
    d = max_distance
    # Both corpora are folded once; the steps below read the written table, most of them without the texts.
    folded = written(
        _folded(a, d).withColumn("of_a", F.lit(True)).unionByName(_folded(b, d).withColumn("of_a", F.lit(False))), "folded"
    )
    classes = folded.groupBy("digest").agg(
        F.min(F.when(F.col("of_a"), F.col("id"))).alias("id_a"), F.min(F.when(~F.col("of_a"), F.col("id"))).alias("id_b")
    )
    classes = written(classes.select("id_a", "id_b"), "classes")
    exact = classes.filter("id_a IS NOT NULL AND id_b IS NOT NULL").select(
        "id_a", "id_b", F.lit(0).cast("bigint").alias("distance")
    )
    alone = classes.filter("id_a IS NULL OR id_b IS NULL").select(
        F.col("id_a").isNotNull().alias("of_a"), F.coalesce("id_a", "id_b").alias("id")
    )
    few = F.col("n_marks") < marks_needed(d)[1]
    texts = folded.select("id", "of_a", *MEASURES, "marks", F.when(few, F.col("norm")).alias("norm"))
    texts = written(texts.join(alone.hint("merge"), ["of_a", "id"]), "texts")

    # Only ids and hashed keys are shuffled to find candidates; whole texts are attached afterwards.
    found = _candidates(_probed(texts.where("of_a"), d), _indexed(texts.where("NOT of_a"), d), d, busy)
    candidates = written(found, "candidates")
    norm_a = folded.where("of_a").select(F.col("id").alias("id_a"), F.col("norm").alias("norm_a"))
    norm_b = folded.where("NOT of_a").select(F.col("id").alias("id_b"), F.col("norm").alias("norm_b"))
    pairs = candidates.join(norm_a, "id_a").join(norm_b.join(candidates, "id_b", "left_semi"), "id_b")
    distance = edit_distance(d)(F.col("norm_a"), F.col("norm_b"))
    near = pairs.select("id_a", "id_b", distance.alias("distance")).filter(F.col("distance") >= 0)
    return exact.unionByName(near)
