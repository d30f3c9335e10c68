"""Quality classifier by hierarchical empirical Bayes: a document's own evidence, and what its site shows.

The evidence is a logistic model on measures of the text's form. Its probabilities are summed by site path, host and
over all documents; each level's posterior shrinks towards the one above it, the more the fewer documents it has.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.llm.frames import plain, plus, revived, without
from wattsift.llm.words import NOT_BLANK, Found, Words, slices
from wattsift.session import written

SALTS = 16
MICRO = 1_000_000

_CLASS = {name: np.zeros(256, bool) for name in ("upper", "digit", "symbol", "shout", "stop", "bar", "line", "wide")}
for _name, _bytes in (
    ("upper", range(65, 91)), ("digit", range(48, 58)), ("symbol", b"#*$%&<>"), ("shout", b"!"), ("stop", b".,;:?"), ("bar", b"|"),
    ("line", b"\n"), ("wide", range(128, 256)),
):
    _CLASS[_name][list(_bytes)] = True
MEASURES = ["log_words", *_CLASS, "word_length", "same_as_before", "distinct_words", "distinct_triples"]


def measures(found: Found) -> np.ndarray:
    """One row for each text: shares of character classes by word, word length, and how much repeats."""
    n, words = len(found.counts), found.counts.astype(np.float64)
    by_word = 1.0 / np.maximum(words, 1)
    columns = [np.log1p(words)]
    for table in _CLASS.values():
        sums = np.concatenate(([0], np.cumsum(table[found.raw])))
        columns.append(np.diff(sums[found.offsets]) * by_word)
    lengths = np.concatenate(([0], np.cumsum(found.ends - found.starts)))
    columns.append(np.diff(lengths[found.bounds]) * by_word)
    hashes = found.hashes()
    text = np.repeat(np.arange(n), found.counts)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) + 1
    columns.append(np.bincount(text[same], minlength=n) * by_word)
    for size in (1, 3):
        values, owner = found.windows(size, hashes)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))[: len(values)]
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        # on a scale that a text's length moves little: repeats grow with it
        columns.append(np.bincount(owner[fresh], minlength=n) / total ** (0.9 if size == 1 else 1.0))
    return np.column_stack(columns)


@dataclass(frozen=True)
class Evidence:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Evidence:
    """Logistic regression by Newton steps with a ridge; with one class or no rows, the constant share of it."""
    y = np.asarray(y, np.float64)
    width = len(MEASURES)
    if len(y) == 0 or y.min() == y.max():
        prior = float((y.sum() + 1) / (len(y) + 2))
        return Evidence(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))), prior)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack((np.clip((x - mean) / spread, -8, 8), np.ones(len(x))))
    w = np.zeros(width + 1)
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(mean, spread, w[:-1], float(w[-1]), float(y.mean()))


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of at most ``most`` labelled documents, those whose ids hash lowest, in order of id."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id"))
    known = known.agg((F.avg(label) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    ids = known.toArrow().select(["id", "y"])
    chosen = docs.sparkSession.createDataFrame(ids)
    held = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(NOT_BLANK)
        for batch in batches:
            for part in slices(batch, "text"):
                x = measures(words.of(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"]
                )

    kind = docs.schema[id].dataType.simpleString()
    table = held.mapInArrow(run, f"id {kind}, y int, x array<double>").toPandas()
    if not len(table):
        return np.zeros((0, len(MEASURES))), np.zeros(0)
    x = np.array(table["x"].tolist())
    order = np.lexsort((*x.T, table["id"].to_numpy()))
    return x[order], table["y"].to_numpy()[order]


def with_evidence(docs: DataFrame, model: Evidence, text: str = "text") -> DataFrame:
    """Add ``evidence``, the text's own probability in millionths (whole, so that sums don't depend on their order).

    A text without words has 0.
    """
    base = without(docs, "evidence")
    sent = docs.sparkSession.sparkContext.broadcast(plain(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, evidence = Words(NOT_BLANK), revived(Evidence, sent.value)
        for batch in batches:
            for part in slices(batch, text):
                found = words.of(part.column(text))
                p = np.where(found.counts > 0, evidence.probability(measures(found)), 0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.rint(p * MICRO).astype(np.int64))], names=[*part.schema.names, "evidence"]
                )

    return base.mapInArrow(run, plus(base, "evidence bigint"))


def _strength(level: DataFrame, mean: float) -> float:
    """How many documents a level's prior weighs, by moments: the less its parts differ, the more."""
    row = level.agg(
        F.sum("n").cast("double"),
        F.count("*"),
        F.sum((F.col("n") * F.pow(F.col("good") / MICRO / F.col("n") - mean, 2)).cast("decimal(38,9)")).cast("double"),
    ).first()
    total, parts, squares = row[0] or 0.0, row[1], row[2] or 0.0
    if parts < 2 or not 0 < mean < 1:
        return 100.0
    sampling = mean * (1 - mean)
    between = max((squares - parts * sampling) / total, sampling / 1e4)
    return float(min(max(sampling / between - 1, 1.0), 1e4))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, host_posterior, path_posterior) from (host, path, evidence), one row for each path."""
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    mean = (float(good or 0) / MICRO + 1) / ((n or 0) + 2)
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    host = (F.lit(k_host * mean) + F.col("good") / MICRO) / (F.lit(k_host) + F.col("n"))
    path = (F.lit(k_path) * F.col("host_posterior") + F.col("good") / MICRO) / (F.lit(k_path) + F.col("n"))
    above = hosts.select("host", host.alias("host_posterior"))
    return written(paths.join(above, "host").select("host", "path", "host_posterior", path.alias("path_posterior")), "sites")


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def classify(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    host: Column | None = None, path: Column | None = None, max_labelled: int = 20_000, threshold: float = 0.5,
) -> DataFrame:
    """Add evidence, host_posterior, path_posterior, quality (all doubles but evidence in millionths) and kept.

    The model is fitted on at most ``max_labelled`` labelled documents; site sums cover all documents. quality is the
    evidence moved by the log odds of its path's posterior over the labelled share of good ones, and kept says that it
    reaches ``threshold``. Hosts default to the column source and paths to lang; NULL counts as the empty name.

    Texts without words have no evidence of quality and are not kept. Labels of an id that disagree go with the majority;
    labels without id or value count for nothing, and with no labels, or one class of them, the evidence is that share
    for every text. Repeated documents each count and each get a row. Columns of these names are replaced.
    """
    added = ["evidence", "host", "path", "host_posterior", "path_posterior", "quality", "kept", "site_salt"]
    base = without(docs, *[c for c in added if c not in ("host", "path")])
    model = fit(*labelled_sample(docs, labels, id, text, label, max_labelled))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    host, path = name(F.col("source") if host is None else host), name(F.col("lang") if path is None else path)
    scored = with_evidence(docs.select(F.col(text).alias("text"), host.alias("host"), path.alias("path")), model)
    sites = site_posteriors(scored.drop("text")).withColumnsRenamed({"host": "site_host", "path": "site_path"})
    salted = sites.withColumn("site_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = with_evidence(base.withColumns({"site_host": host, "site_path": path}), model, text)
    own = own.withColumn("site_salt", F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int"))
    joined = own.join(salted, ["site_host", "site_path", "site_salt"], "left")
    moved = _logit(F.col("evidence") / MICRO) - _logit(F.lit(model.prior)) + _logit(F.col("path_posterior"))
    quality = F.when(F.col("evidence") > 0, 1 / (1 + F.exp(-moved))).otherwise(F.lit(0.0))
    out = joined.withColumn("quality", F.round(quality, 6)).withColumn("kept", F.col("quality") >= threshold)
    return out.select(*base.columns, "evidence", "host_posterior", "path_posterior", "quality", "kept")
