"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

Sentences are bags of pieces: words, runs of spelled-out letters joined, and overlapping parts of long words. A piece's
features are its kernels with the landmark strings; the machine is linear in them. Training weighs how often toxic texts
use a piece against how often clean ones do. A text is judged by all its pieces: by the largest margin, the sum of the
positive ones and their share of the text, so that a mild piece counts where it repeats.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.llm.frames import fitted, plain, plus, revived, without
from wattsift.llm.strings import MOST, SYMBOL, TABLE, Landmarks, dots, norms
from wattsift.llm.words import NOT_BLANK, RADIX, U64, Found, Words, _powers, mixed, slices

CACHE = 1 << 20
FOLDS = 5
#: Margins above which pieces count: mild ones by their number, sure ones alone.
LIMITS = (1.0, 2.0, 3.0)
POOLED = 1 + 2 * len(LIMITS)


class Pieces:
    """Pieces of the texts of a slice as ranges of one symbol array, each with its text and a hash."""

    def __init__(self, found: Found):
        raw = found.raw
        inside = np.zeros(len(raw) + 1, np.int64)
        inside[found.starts] += 1
        inside[found.ends] -= 1
        # lead bytes of two-byte letters say nothing by themselves
        kept = (np.cumsum(inside[:-1]) > 0) & ((raw < 192) | (raw > 223))
        at = np.concatenate(([0], np.cumsum(kept)))
        self.symbols = SYMBOL[raw[kept]]
        start, end = at[found.starts], at[found.ends]
        text = np.repeat(np.arange(len(found.counts)), found.counts)
        letters = np.concatenate(([0], np.cumsum(self.symbols > 0)))
        single = (letters[end] - letters[start]) <= 1
        glued = np.zeros(len(start), bool)
        glued[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
        first = np.flatnonzero(~glued)
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        start, end, text = start[first], end[last] if len(first) else end[:0], text[first]
        long = end - start > MOST
        if long.any():
            parts = [(a, min(a + MOST, e), t) for s, e, t in zip(start[long], end[long], text[long]) for a in range(s, e - MOST // 2, MOST // 2)]
            more = np.array(parts, np.int64).reshape(-1, 3).T
            start, end, text = (np.concatenate((x[~long], y)) for x, y in zip((start, end, text), more))
        some = letters[end] - letters[start] >= 3
        self.start, self.end, self.text = start[some], end[some], text[some]

    def hashes(self) -> np.ndarray:
        n = len(self.symbols)
        up, down = _powers(n + 1, RADIX), _powers(n + 1, pow(RADIX, -1, 1 << 64))
        sums = np.zeros(n + 1, U64)
        np.cumsum(mixed(self.symbols.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def strings(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups of the given pieces by length: (positions in ``which``, rows of symbols)."""
        size = self.end[which] - self.start[which]
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            yield own, self.symbols[self.start[which][own][:, None] + np.arange(n)]


@dataclass(frozen=True)
class Machine:
    """``table`` holds the machine's weight of every triple; ``pool`` the weights of what a text's margins are pooled to;
    slope and shift turn the evidence of a text into a probability."""

    table: np.ndarray
    bias: float
    pool: np.ndarray
    slope: float
    shift: float

    def margins(self, pieces: Pieces, which: np.ndarray) -> np.ndarray:
        out = np.full(len(which), self.bias)
        for own, strings in pieces.strings(which):
            out[own] += dots(strings, self.table) / norms(strings)
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


def pooled(margins: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts: the largest margin of its pieces; and for each of a few limits the sum of what margins have
    above it, whole and for a hundred pieces, on a logarithmic scale. Texts without pieces have zeros."""
    size = np.bincount(text, minlength=n)
    top = np.full(n, -1.0)
    np.maximum.at(top, text, np.clip(margins, -1, 6))
    out = [top]
    for limit in LIMITS:
        held = np.bincount(text, np.clip(margins - limit, 0, 3), minlength=n)
        out += [np.log1p(held), np.log1p(100 * held / np.maximum(size, 30))]
    return np.column_stack(out)


class Scorer:
    """Scores texts with a machine; remembers margins of pieces seen, up to a fixed number of them."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.known, self.margin = np.empty(0, U64), np.empty(0)

    def worst(self, found: Found) -> np.ndarray:
        """The evidence of each text, from the margins of all its pieces."""
        return self.pooled(found) @ self.machine.pool

    def pooled(self, found: Found) -> np.ndarray:
        pieces = Pieces(found)
        hashes, first, inverse = np.unique(pieces.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        margins = self.margin[at] if len(self.known) else np.zeros(len(hashes))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        margins[new] = self.machine.margins(pieces, first[new])
        if len(self.known) > CACHE:
            self.known, self.margin = np.empty(0, U64), np.empty(0)
        merged = np.concatenate((self.known, hashes[new]))
        order = np.argsort(merged, kind="stable")
        self.known, self.margin = merged[order], np.concatenate((self.margin, margins[new]))[order]
        return pooled(margins[inverse], pieces.text, len(found.counts))


def _suspicion(pieces: Pieces, which: np.ndarray, doc: np.ndarray, piece: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each distinct piece, how surely some letter run of it (of 3 to 5) tells toxic texts from clean ones.

    It is the log-likelihood gain of the run's own share of toxic texts over the common share, above what the luckiest
    of so many runs would reach by chance; runs that toxic texts don't hold more often than others don't count.
    """
    owner, codes = [], []
    size = pieces.end[which] - pieces.start[which]
    for k in (3, 4, 5):
        room = np.maximum(size - k + 1, 0)
        own = np.repeat(np.arange(len(which)), room)
        at = np.repeat(pieces.start[which] - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(room.sum())
        code = np.zeros(len(at), U64)
        whole = np.ones(len(at), bool)
        for i in range(k):
            symbol = pieces.symbols[at + i]
            code = code * U64(91) + symbol
            whole &= symbol > 0
        owner.append(own[whole])
        codes.append(code[whole] * U64(8) + U64(k))
    owner, codes = np.concatenate(owner), np.concatenate(codes)
    runs, run = np.unique(codes, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    owner, run = owner[order], run[order]
    low, high = np.searchsorted(owner, piece), np.searchsorted(owner, piece, "right")
    times = high - low
    at = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
    held, often = np.unique(np.repeat(doc, times) * np.int64(len(runs)) + run[at], return_counts=True)
    in_toxic = toxic[held // len(runs)] == 1
    often = np.log2(1 + often)
    t = np.bincount(held[in_toxic] % len(runs), often[in_toxic], minlength=len(runs))
    c = np.bincount(held[~in_toxic] % len(runs), often[~in_toxic], minlength=len(runs))
    m, q = t + c, t.sum() / (t.sum() + c.sum())
    gain = t * np.log(np.maximum(t, 1e-9) / (m * q)) + c * np.log(np.maximum(c, 1e-9) / (m * (1 - q))) - 2 * np.log(len(runs))
    gain[t <= m * q] = -99.0
    out = np.full(len(which), -99.0)
    np.maximum.at(out, owner, gain[run])
    return out


def _newton_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Linear machine with squared hinge loss; the last weight is the bias. Toxic pieces are few and known ones should stand
    far out, clean ones are endless: the margins asked for are 4 and 1."""
    goal = np.where(y > 0, 4.0, 1.0)
    z = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    loss = lambda v: ridge * (v @ v) + (weight * np.maximum(goal - y * (z @ v), 0) ** 2).sum()
    now = loss(w)
    for _ in range(rounds):
        active = y * (z @ w) < goal
        za, wa = z[active], weight[active]
        way = np.linalg.solve((za * wa[:, None]).T @ za + ridge * np.eye(len(w)), za.T @ (wa * y[active] * goal[active])) - w
        step = 1.0
        while step > 1e-6 and loss(w + step * way) >= now:
            step /= 2
        if step <= 1e-6 or now - loss(w + step * way) < 1e-9 * now:
            break
        w = w + step * way
        now = loss(w)
    return w


def train(texts: list[str | None], toxic: np.ndarray, share: float, parts: int = 3) -> Machine:
    """Fit on labelled texts; ``share`` is the share of toxic ones outside the sample. Deterministic.

    The weights of pooled margins are fitted to texts that the machine giving the margins has not seen: each part of the
    texts is scored by a machine of the others. The machine returned is one of all texts.
    """
    none = Machine(np.zeros(TABLE), 0.0, np.zeros(POOLED), 0.0, float(np.log((share + 1e-4) / (1 - share + 1e-4))))
    machine = _machine(texts, toxic)
    if machine is None:
        return none
    part = np.zeros(len(texts), np.int64)
    for y in (0, 1):
        part[toxic == y] = np.arange((toxic == y).sum()) % parts
    seen, scored = np.zeros((len(texts), POOLED)), np.zeros(len(texts), bool)
    for k in range(parts):
        other = _machine([t for t, p in zip(texts, part) if p != k], toxic[part != k])
        if other is not None:
            own = Words(NOT_BLANK).of(pa.array([t for t, p in zip(texts, part) if p == k], pa.string()))
            seen[part == k], scored[part == k] = Scorer(Machine(*other, np.zeros(POOLED), 0.0, 0.0)).pooled(own), True
    if not scored.any():
        return none
    pool, shift = _calibrated(seen[scored], toxic[scored], share)
    return Machine(*machine, pool, 1.0, shift)


def _machine(texts: list[str | None], toxic: np.ndarray, landmarks: int = 160, rounds: int = 4) -> tuple[np.ndarray, float] | None:
    """The weight of every triple and the bias of a machine for pieces; nothing if none tells toxic texts."""
    found = Words(NOT_BLANK).of(pa.array(texts, pa.string()))
    pieces = Pieces(found)
    hashes, first, inverse = np.unique(pieces.hashes(), return_index=True, return_inverse=True)
    if not len(hashes) or toxic.min() == toxic.max():
        return None
    pairs = np.unique(pieces.text.astype(np.int64) * len(hashes) + inverse)
    doc, piece = pairs // len(hashes), pairs % len(hashes)
    margins = _suspicion(pieces, first, doc, piece, toxic)
    length = np.ones(len(first))
    for own, strings in pieces.strings(first):
        length[own] = norms(strings)
    uses = [np.bincount(inverse[toxic[pieces.text] == y], minlength=len(first)) for y in (0, 1)]
    # how often toxic texts use a piece for each time that as many clean words do
    scale = uses[0].sum() / max(uses[1].sum(), 1)
    clean = np.flatnonzero(uses[0])
    # witnesses: pieces that toxic texts use more often than clean ones and of which some run tells them apart
    positive = np.flatnonzero((uses[1] * scale > uses[0]) & (margins > 0))
    if not len(positive):
        return None
    telling = margins[positive].copy()
    both = positive[uses[0][positive] > 0]
    negative = clean[np.argsort(hashes[clean], kind="stable")[:3000]]
    for _ in range(rounds):  # each against more of the clean pieces that score highest so far
        times = uses[1][positive]
        hard = clean[np.argsort(-margins[clean], kind="stable")[:3000]]
        negative = np.setdiff1d(np.union1d(negative, hard), positive)
        marks = np.concatenate((
            _spread(positive, times, telling)[: landmarks * 3 // 4],
            hard[~np.isin(hard, positive)][: landmarks - landmarks * 3 // 4],
        ))
        which = np.concatenate((positive, negative, both))
        label = np.concatenate((np.ones(len(positive)), -np.ones(len(negative) + len(both))))
        weight = times * np.sqrt(uses[0][negative]).sum() / times.sum()
        # a witness that clean texts use too stands on both sides, by how often
        own = np.isin(positive, both)
        weight = np.concatenate((weight, np.sqrt(uses[0][negative]), weight[own] * uses[0][both] / (uses[1][both] * scale)))
        landmark = Landmarks([pieces.symbols[pieces.start[m] : pieces.end[m]] for m in first[marks]])
        features, among = (np.zeros((len(x), len(marks))) for x in (which, marks))
        for out, of in ((features, which), (among, marks)):
            for own, strings in pieces.strings(first[of]):
                out[own] = landmark.products(strings) / length[of[own]][:, None]
        values_, vectors = np.linalg.eigh(among + 1e-3 * np.eye(len(marks)))
        root = vectors / np.sqrt(np.maximum(values_, 1e-6)) @ vectors.T
        w = _newton_svm(features @ root, label, weight)
        table = landmark.combined(root @ w[:-1])
        for own, strings in pieces.strings(first):
            margins[own] = w[-1] + dots(strings, table) / length[own]
    return table, float(w[-1])


def _spread(positive: np.ndarray, times: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Witnesses in the order of landmarks: the most used for each telling run in turn, so that every language and every
    word has its own, however many texts of another there are. Pieces with the same run have the same gain of it."""
    order = positive[np.lexsort((positive, -times, -telling))]
    gain = telling[np.lexsort((positive, -times, -telling))]
    heads = np.flatnonzero(np.concatenate(([True], gain[1:] != gain[:-1])))
    turn = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[np.argsort(turn, kind="stable")]


def _calibrated(seen: np.ndarray, toxic: np.ndarray, share: float, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic weights and shift of toxic against the pooled margins, with texts weighted to the share outside the
    sample. More of any of them never makes a text less toxic: weights below zero are left out, the least first."""
    y = toxic.astype(float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    used = np.ones(seen.shape[1], bool)
    ridge = np.append(np.full(seen.shape[1], 1e-1), 1e-6)
    while True:
        on = np.append(used, True)
        x, v = np.column_stack((seen, np.ones(len(y))))[:, on], np.zeros(on.sum())
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            h = weight * p * (1 - p) + 1e-9
            step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(ridge[on]), x.T @ (weight * (y - p)) - ridge[on] * v)
            v = v + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        out = np.zeros(len(on))
        out[on] = v
        if not used.any() or out[:-1].min() >= 0:
            return out[:-1], float(out[-1])
        used[out[:-1].argmin()] = False


def held_out(id):
    """Whether a row's id belongs to the fold that is never learned from; a NULL id does."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def train_on(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: int) -> Machine:
    """Fit on at most ``most`` toxic and twice as many clean labelled documents outside the held-out fold.

    Of each class, those whose ids hash lowest are taken.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
    known = known.groupBy(F.col(id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    lowest = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = docs.sparkSession.createDataFrame(lowest(1, most).union(lowest(0, 2 * most)).toArrow())
    held = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    share = counts.get(1, 0) / max(sum(counts.values()), 1)

    def fit(rows: list[dict]) -> tuple:
        rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), str(r["id"]), r["text"] or ""))
        toxic = np.array([r["y"] for r in rows] or [0], np.int64)
        machine = train([r["text"] for r in rows], toxic, share)
        return machine.table, machine.bias, machine.pool, machine.slope, machine.shift

    return Machine(*fitted(held, fit))


def score(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = 300
) -> DataFrame:
    """Add held_out, score (0 to 1) and predicted (1 from 0.5) to every document.

    Only labelled rows outside the held-out fold are learned from, at most 3 x ``max_labelled``; the texts are the only
    input of scores. Whole texts are read. A NULL or empty text, or one without letters, gets the score of no evidence.
    Without labels of both classes every text gets the labelled share. Ids whose labels disagree go with the majority.
    Repeated rows are scored each. Columns of these names are replaced.
    """
    base = without(docs, "held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(plain(train_on(docs, labels, id, text, label, max_labelled)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = revived(Machine, sent.value)
        words, scorer = Words(NOT_BLANK), Scorer(machine)
        for batch in batches:
            for part in slices(batch, text):
                p = machine.probability(scorer.worst(words.of(part.column(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "score"])

    out = base.mapInArrow(run, plus(base, "score double"))
    return out.withColumn("held_out", held_out(F.col(id))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
