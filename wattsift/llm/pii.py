"""Personal data: exact patterns, and spans that a character tagger adds.

The tagger reads windows around every digit, every @ and every address that spells it as a word. Where windows overlap, their tag probabilities are
averaged, those near a window's middle counting more, and one path through each stretch of text settles its spans.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.llm.frames import fitted, plain, plus, revived, without
from wattsift.llm.tagger import KINDS, LENGTH, PAD, TAGS, Tagger, encode

Span = tuple[int, str, int]  # start, kind, end
STRIDE = LENGTH // 2
#: Weight of the tag outside when a path is settled: spans that only look like one fail on their wording afterwards.
OUTSIDE = 0.25

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
TRIGGER = re.compile(r"[0-9@]+")
#: What every span holds: a digit, an @, or the word at before a name and a dot, which may be a word too.
HELD = re.compile(r"[0-9@]+|\bat\b(?=(\s{0,9}(?:[)\]]\s{0,9})?[a-zA-Z0-9-]{1,63}(?![a-zA-Z0-9-])\s{0,9}(?:[(\[]\s{0,9})?(?:\.|\bdot\b)\s{0,9}(?:[)\]]\s{0,9})?[a-zA-Z]))", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @ so that the time is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four groups of digits at a time from every chain of groups joined by single dots, parts at most 255."""
    for chain in DOTTED.finditer(text):
        groups = list(GROUPS.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            if all(len(g[0].lstrip("0")) <= 3 and int(g[0].lstrip("0") or 0) <= 255 for g in four):
                yield four[0].start(), four[3].end()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones)))


def base_spans(text: str) -> list[Span]:
    """Exact matches, in order of start, then kind."""
    found = [(start, KINDS.index(kind), end) for kind, find in FINDERS.items() for start, end in find(text)]
    return [(start, KINDS[k], end) for start, k, end in sorted(found)]


# training: labelled spans, written into windows of real text


def _card_number(rng) -> str:
    digits = "".join(map(str, rng.integers(0, 10, 15)))
    check = next(str(d) for d in range(10) if luhn(digits + str(d)))
    return "4" + digits[1:] + check if luhn("4" + digits[1:] + check) else digits + check


def _example(kind: str, rng, words: list[str]) -> str:
    """A made-up instance, plain or written a little otherwise than the exact pattern expects."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    word = lambda: re.sub(r"[^a-z]", "", pick(*words).lower()) or "name"
    if kind == "email":
        at = pick("@", "@", "@", " @ ", "@ ", " (at) ", "[@]")
        dot = pick(".", ".", ".", " . ", " dot ")
        name = pick(word(), word() + digits(2), word() + "." + word(), word() + digits(2))
        return name + at + word() + pick("", digits(1)) + dot + pick("com", "org", "net", "example.com")
    if kind == "ip":
        sep = pick(".", ".", ".", " . ", ". ", ",")
        return sep.join(str(int(x)) for x in rng.integers(1, 256, 4))
    if kind == "card":
        number = _card_number(rng)
        sep = pick("", "", " ", "-", ".", "  ", "/")
        return sep.join(number[k : k + 4] for k in range(0, 16, 4))
    code, area, a, b = digits(1), digits(3), digits(3), digits(4)
    return pick(
        f"+{code} ({area}) {a}-{b}", f"+{code} {area} {a} {b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{code}-{area}-{a}-{b}",
        f"00{code} {area} {a}{b}", f"tel {area}.{a}.{b}", f"+{code}/{area}/{a}{b}",
    )


def _decoy(rng) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    return [
        lambda: digits(int(rng.integers(1, 7))), lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}",
        lambda: f'token = "{hexes(40)}"', lambda: hexes(int(rng.integers(16, 33))), lambda: f"password={hexes(18)}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{digits(3)},{digits(3)}", lambda: f"${digits(2)}.{digits(2)}", lambda: "@" + hexes(4), lambda: f"AKIA{hexes(16).upper()}",
        lambda: f"v{digits(1)}.{digits(1)}", lambda: digits(int(rng.integers(8, 13))), lambda: f"{digits(1)}/{digits(2)}",
    ][int(rng.integers(0, 14))]()


def labelled_windows(carriers: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of carrier text with spans written in, as classes and tags. Deterministic."""
    rng = np.random.default_rng(seed)
    # carriers keep their words and signs, but no personal data of their own that would go unlabelled
    plain = [TRIGGER.sub("", c) for c in carriers if c and len(c) > 20] or ["no text to carry the spans at all. " * 4]
    words = [w for c in plain[:50] for w in c.split()[:40] if len(w) > 2] or ["name"]
    x, y = np.full((n, LENGTH), PAD, np.int64), np.zeros((n, LENGTH), np.int64)
    for row in range(n):
        carrier = plain[int(rng.integers(0, len(plain)))]
        at = int(rng.integers(0, max(1, len(carrier) - LENGTH)))
        base = carrier[at : at + LENGTH]
        cut = int(rng.integers(0, len(base) + 1))
        text, tags = base[:cut], [0] * cut
        for _ in range(int(rng.integers(1, 3))):
            gap = [" ", " ", " ", "\n", ", ", ""][int(rng.integers(0, 6))]
            text, tags = text + gap, tags + [0] * len(gap)
            if rng.random() < 0.62:
                k = int(rng.integers(0, len(KINDS)))
                item = _example(KINDS[k], rng, words)
                tags += [1 + 2 * k] + [2 + 2 * k] * (len(item) - 1)
            else:
                item = _decoy(rng)
                tags += [0] * len(item)
            text += item
        text, tags = text + [" ", ". ", '"', "***", "\n"][int(rng.integers(0, 5))] + base[cut:], tags + [0] * (LENGTH + 8)
        start = int(rng.integers(0, max(1, len(text) - LENGTH + 1))) if len(text) > LENGTH else 0
        own = text[start : start + LENGTH]
        x[row, : len(own)] = encode(own)
        y[row, : len(own)] = tags[start : start + len(own)]
        if y[row, 0] and y[row, 0] % 2 == 0:
            y[row, 0] -= 1
    return x, y


def train(carriers: list[str], windows: int = 3500, epochs: int = 7, seed: int = 5) -> Tagger:
    x, y = labelled_windows(carriers, windows, seed)
    return Tagger(seed).fit(x, y, epochs)


# reading texts


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within half a window of a digit, an @ or an address in words, merged; no plausible span lies outside."""
    out: list[list[int]] = []
    for m in HELD.finditer(text):
        a, b = max(0, m.start() - STRIDE), min(len(text), max(m.end(), m.end(1)) + STRIDE)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tag_stretches(tagger: Tagger, parts: list[str], step: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tags, probability of each kind at each character) of every part, settled over its overlapping windows."""
    codes = [encode(p) for p in parts]
    starts = [(k, a) for k, c in enumerate(codes) for a in range(0, max(1, len(c) - STRIDE), STRIDE)]
    sums = [np.zeros((len(c), TAGS)) for c in codes]
    weights = [np.zeros(len(c)) for c in codes]
    centred = np.minimum(np.arange(1, LENGTH + 1), np.arange(LENGTH, 0, -1)).astype(np.float64)
    for a in range(0, len(starts), step):
        own = starts[a : a + step]
        windows = np.full((len(own), LENGTH), PAD, np.int64)
        for row, (k, s) in enumerate(own):
            piece = codes[k][s : s + LENGTH]
            windows[row, : len(piece)] = piece
        p = tagger.marginals(tagger.emissions(windows)[0])[0]
        for row, (k, s) in enumerate(own):
            n = min(LENGTH, len(codes[k]) - s)
            sums[k][s : s + n] += p[:n, row] * centred[:n, None]
            weights[k][s : s + n] += centred[:n]
    mean = [s / np.maximum(w, 1e-9)[:, None] for s, w in zip(sums, weights)]
    lean = np.array([OUTSIDE] + [1.0] * (TAGS - 1))
    paths = tagger.best_paths([np.log(m * lean + 1e-6) for m in mean])
    return [(t, (m[:, 1::2] + m[:, 2::2]).clip(0, 1)) for t, m in zip(paths, mean)]


def _plausible(kind: str, body: str) -> bool:
    """What a tagged span must at least look like."""
    digits = sum(c in "0123456789" for c in body)
    if kind == "ip":
        groups = GROUPS.findall(body)
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and bool(re.fullmatch(r"[0-9 .,]+", body))
    if kind == "card":
        number = "".join(GROUPS.findall(body))
        return 14 <= digits <= 19 and luhn(number) and bool(re.fullmatch(r"[0-9 ./-]+", body))
    return 10 <= digits <= 15 and len(GROUPS.findall(body)) >= 2 and bool(re.fullmatch(r"(?:tel )?[0-9+() ./-]+", body))


#: An address as people spell it: signs for @ and for dots may stand apart, in brackets or as words.
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|[(\[]\s?(?:@|at)\s?[)\]]|\bat\b)\s?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\.|\s\.\s|\s?[(\[]?\s?\bdot\b\s?[)\]]?\s?)[A-Za-z0-9-]{1,63})+",
    re.IGNORECASE,
)
#: Characters around a tagged span among whose runs its ends are looked for.
REACH = 10
#: Least mean probability of the kind that a span is given.
LEAST = 0.1


def settled(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The plausible span of whole runs (groups of digits, or a spelled address) whose ends lie nearest to the tagged ones.

    The tagger is sure of a kind sooner than of its first and last characters. Of spans as near, the longer.
    """
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    if kind == "email":
        while low > max(0, start - 64) and text[low - 1] in LOCAL_CHARS:
            low -= 1
        while high < min(len(text), end + 64) and text[high] in LOCAL_CHARS:
            high += 1
        near = [m.span() for m in SPELLED.finditer(text, low, high) if m.start() < end and m.end() > start]
        return min(near, key=lambda x: (abs(x[0] - start) + abs(x[1] - end), x[0] - x[1]), default=None)
    while low > 0 and start - low < 30 and text[low].isdigit() and text[low - 1].isdigit():
        low -= 1
    while high < len(text) and high - end < 30 and text[high - 1].isdigit() and text[high].isdigit():
        high += 1
    found = [m.span() for m in GROUPS.finditer(text, low, high)]
    begins = [s for s, e in found if s <= start + REACH and e > start - REACH]
    ends = [e for s, e in found if e >= end - REACH and s < end + REACH]
    best = None
    for s in begins:
        s = _opened(kind, text, s)
        for e in ends:
            if s < e:
                order = (abs(s - start) + abs(e - end), s - e)
                if (best is None or order < best[0]) and _plausible(kind, text[s:e]) and _whole(text, s, e):
                    best = (order, s, e)
    return best and best[1:]


def _opened(kind: str, text: str, start: int) -> int:
    """The start moved back over a plus, a bracket or the word that opens a phone number."""
    if kind == "phone":
        for sign in ("(", "+", "tel "):
            if text.startswith(sign, start - len(sign)) and start >= len(sign):
                start -= len(sign)
    return start


def _whole(text: str, start: int, end: int) -> bool:
    """No more digits of the same chain stand before or behind: part of a longer chain is not a span."""
    return not re.search(r"[0-9][.-]?\Z", text[max(0, start - 2) : start]) and not re.match(r"[.-]?[0-9]", text[end : end + 2])


def _merged(base: list[Span]) -> list[tuple[int, int]]:
    """Ranges that the spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for s, _, e in sorted(base):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[Span]], sure: float) -> list[list[Span]]:
    """Spans of the tagger that touch no exact match, with ends settled on whole runs and a mean probability of ``sure`` to be of
    any kind."""
    places = [(k, a, b) for k, text in enumerate(texts) for a, b in stretches(text)]
    out: list[list[Span]] = [[] for _ in texts]
    if not places:
        return out
    tagged = tag_stretches(tagger, [texts[k][a:b] for k, a, b in places])
    taken = [_merged(base) for base in bases]
    for (k, a, _), (tags, p) in zip(places, tagged):
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], (tags + 1) // 2, [0]))) | np.concatenate((tags % 2 == 1, [False])))
        for i, j in zip(cuts[:-1], cuts[1:]):
            held = p[i:j].mean(axis=0)
            if tags[i] == 0 or held.sum() < sure:
                continue
            # digits in groups look alike to the tagger: of the kinds it holds likely, the first that the span can be
            ways = ((KINDS[x], settled(KINDS[x], texts[k], a + i, a + j)) for x in np.argsort(-held, kind="stable") if held[x] >= LEAST)
            kind, span = next(((x, found) for x, found in ways if found), (None, None))
            if span is None:
                continue
            start, end = span
            at = bisect_left(taken[k], (start, start))
            if all(e <= start or s >= end for s, e in taken[k][max(0, at - 1) : at + 1]):
                taken[k].insert(at, span)
                out[k].append((start, "likely_" + kind, end))
    return out


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", max_carriers: int = 500, sure: float = 0.3, seed: int = 5) -> DataFrame:
    """Add ``pii``, an array of (start, kind, end) in order of start, to every document.

    Kinds email, ip, card and phone are exact matches; likely_email and so on are the tagger's. Positions count code
    points, ends are exclusive. The tagger learns from spans written into windows of at most ``max_carriers`` texts,
    those that hash lowest with their ids; of a long text, 2000 characters from a place anywhere in it. All of every text is
    searched: exact matches and the tagger need a digit, an @ or an address in words, and every window that holds one is read.

    Decoding leans towards spans (``OUTSIDE``, ``sure``: the least mean probability of being of any kind); each is then
    settled on whole groups of digits or a spelled address, and dropped if it cannot be of a kind the tagger holds likely.

    A NULL or empty text has no spans. Repeated rows get the same spans each. A column of this name is replaced.
    """
    base = without(docs, "pii")
    key = F.xxhash64(id, text)
    place = F.pmod(F.xxhash64(key), F.greatest(F.length(text) - 1999, F.lit(1))).cast("int") + 1
    keyed = docs.where(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).substr(place, F.lit(2000)).alias("text"))
    lowest = keyed.select("key").orderBy("key").limit(max_carriers).distinct()
    carriers = keyed.join(F.broadcast(lowest), "key").groupBy("key").agg(F.max("text").alias("text")).select("text")
    tagger = Tagger(seed, fitted(carriers, lambda rows: train(sorted(r["text"] for r in rows), seed=seed).p))
    sent = docs.sparkSession.sparkContext.broadcast(plain(tagger))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = revived(Tagger, sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [t or "" for t in part.column(text).to_pylist()]
                bases = [base_spans(t) for t in texts]
                more = added_spans(tagger, texts, bases, sure)
                rows = [[{"start": s, "kind": x, "end": e} for s, x, e in sorted(b + m)] if b or m else [] for b, m in zip(bases, more)]
                for r in rows:
                    r.sort(key=lambda s: (s["start"], s["kind"] not in KINDS, KINDS.index(s["kind"].removeprefix("likely_"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names=[*part.schema.names, "pii"])

    return base.mapInArrow(run, plus(base, "pii array<struct<start:bigint,kind:string,end:bigint>>"))
