"""License scans by conditional compression.

A block of text that may hold a license is compressed alone and with each notice as a raw zstandard dictionary. The notices
that make it smaller by more than a margin are ranked by how much, and the first whose wording is confirmed by exact
differences takes its places. These are taken out of the block, which is ranked again, until no notice saves more than the
margin or none that does is confirmed.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from wattsift.llm.frames import plus, without
from wattsift.llm.templates import NOTICES

#: Every notice holds one of these in some case.
CUES = ("licen", "permission", "redistribut", "public domain", "copyright", "released under")
CUE = re.compile("|".join(CUES), re.IGNORECASE | re.ASCII)
WORD = re.compile(r"\w+")
FOUND = "array<struct<start:bigint,end:bigint,license:string,reduction:double,missing:int,added:int>>"
BLOCK = 1200
#: Words in a row that say where a notice may start in a text, or all of a shorter notice.
RUN = 4
LEVEL = 6
#: Bytes that a notice must save. The given texts' shortest license line saves 13 of its block; prose without one saves none.
MARGIN = 1
#: Rivals within this many bytes of the first that is confirmed are compared by their wording: an exact one goes first.
NEAR = 8


def words_at(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text, start, end)]


def runs(words: list[str], n: int) -> Iterator[tuple[str, ...]]:
    return zip(*(words[k:] for k in range(n))) if n else iter(())


def blocks(text: str) -> list[tuple[int, int]]:
    """Ranges of text around cue words, half a block to either side; those that touch are one."""
    out: list[list[int]] = []
    half = BLOCK // 2
    for m in CUE.finditer(text):
        a, b = max(0, m.start() - half), min(len(text), m.end() + half)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Scanner:
    """Notices as dictionaries and words, and where each run of words stands in them."""

    def __init__(self, notices=NOTICES, level: int = LEVEL):
        self.notices = [(name, [w for w, _, _ in words_at(body, 0, len(body))]) for name, body in notices]
        self.plain = zstandard.ZstdCompressor(level=level)
        self.given = []
        for _, body in notices:
            given = zstandard.ZstdCompressionDict(body.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=level)
            self.given.append(zstandard.ZstdCompressor(level=level, dict_data=given))
        self.holders: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for k, (_, want) in enumerate(self.notices):
            for at, run in enumerate(runs(want, min(RUN, len(want)))):
                self.holders.setdefault(run, []).append((k, at))
        self.sizes = sorted({len(run) for run in self.holders})

    def places(self, words: list[str | None], low: int, high: int) -> dict[int, set[int]]:
        """Where each notice would start, by the runs it shares with the words from ``low`` to ``high``."""
        out: dict[int, set[int]] = {}
        for n in self.sizes:
            for here, run in enumerate(runs(words[low:high], n), low):
                for k, at in self.holders.get(run, ()):
                    out.setdefault(k, set()).add(here - at)
        return out

    def ranked(self, piece: str, notices: list[int]) -> list[tuple[int, int, float]]:
        """(bytes saved, notice, share of the compressed size saved) of those of the notices that save more than the margin,
        best first."""
        data = piece.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        saved = ((alone - len(self.given[k].compress(data)), k) for k in notices)
        return sorted(((s, k, s / alone) for s, k in saved if s > MARGIN), key=lambda x: (-x[0], x[1]))

    def differences(self, notice: int, words: list[str | None], start: int) -> tuple[int, int, int, int] | None:
        """(first word, last word, notice words missing, words between that are not the notice's) of a copy that starts at
        ``start`` or, as words were added or left out, a little before or behind. Words taken out before end the search."""
        want = self.notices[notice][1]
        slack = max(4, len(want) // 10 + 1)
        low, high = max(0, start - slack), min(len(words), start + len(want) + slack)
        middle = min(max(start + len(want) // 2, low), high)
        if None in words[low:high]:
            low = max((k + 1 for k in range(low, middle) if words[k] is None), default=low)
            high = min((k for k in range(middle, high) if words[k] is None), default=high)
        same = [b for b in SequenceMatcher(None, words[low:high], want, autojunk=False).get_matching_blocks() if b.size]
        if not same:
            return None
        held = sum(b.size for b in same)
        first, last = low + same[0].a, low + same[-1].a + same[-1].size - 1
        return first, last, len(want) - held, last - first + 1 - held

    def confirmed(self, notice: int, words: list[str | None], starts: set[int]) -> list[tuple[int, int, int, int]]:
        """The notice's copies with the fewest differences, none over another: at most a tenth of its words may be missing,
        and as many added."""
        size = len(self.notices[notice][1])
        found = {d for start in starts if (d := self.differences(notice, words, start)) and 10 * max(d[2], d[3]) <= size}
        fewest = min((d[2] + d[3] for d in found), default=0)
        out: list[tuple[int, int, int, int]] = []
        for d in sorted(found):
            if d[2] + d[3] == fewest and (not out or d[0] > out[-1][1]):
                out.append(d)
        return out

    def winner(self, ranked, words: list[str | None], places: dict[int, set[int]]):
        """(notice, share saved, copies) of the first ranked notice that is confirmed, or of a rival that saves nearly as
        much with fewer differences, or as few in a longer wording."""
        best, first = None, 0
        for saved, k, share in ranked:
            if best and saved < first - NEAR:
                break
            copies = self.confirmed(k, words, places[k]) if k in places else []
            if copies:
                order = (copies[0][2] + copies[0][3], -len(self.notices[k][1]))
                if best is None:
                    best, first = (order, k, share, copies), saved
                elif order < best[0]:
                    best = (order, k, share, copies)
        return best and best[1:]

    def scan(self, text: str) -> list[dict]:
        """Confirmed notices at every place, in order; no two overlap."""
        found: list[dict] = []
        for a, b in blocks(text):
            words = words_at(text, a, b)
            spoken: list[str | None] = [w for w, _, _ in words]
            starts = [s for _, s, _ in words]
            taken: list[tuple[int, int]] = []
            for start in range(a, max(a + 1, b - BLOCK // 2), BLOCK // 2):
                end = min(b, start + BLOCK)
                low, high = bisect_left(starts, start), bisect_left(starts, end)
                left = list(range(len(self.notices)))
                while left:
                    rest = _without(text, start, end, taken)
                    if not CUE.search(rest):
                        break
                    ranked = self.ranked(rest, left)
                    won = self.winner(ranked, spoken, self.places(spoken, low, high))
                    if won is None:
                        break
                    k, share, copies = won
                    for first, last, missing, added in copies:
                        spoken[first : last + 1] = [None] * (last + 1 - first)
                        taken.append((words[first][1], words[last][2]))
                        found.append({
                            "start": words[first][1], "end": words[last][2], "license": self.notices[k][0],
                            "reduction": round(share, 6), "missing": missing, "added": added,
                        })
                    # what saves too little of the piece saves no more of what is left of it
                    left = [k for _, k, _ in ranked]
        return sorted(found, key=lambda f: f["start"])


def _without(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> str:
    """The text from start to end with a line break in place of each range taken out."""
    out, at = [], start
    for s, e in sorted(taken):
        if e > at and s < end:
            out.append(text[at : max(at, s)])
            at = e
    return "\n".join([*out, text[at:end]])


def find_licenses(docs: DataFrame, text: str = "text", notices=NOTICES) -> DataFrame:
    """Add ``licenses`` to every document: where a notice stands, in code points, which license it is, how much of its
    block's compressed size the notice saves, and how many words it lacks or has in between.

    Whole texts are read; blocks are looked at only around words of which every notice holds one. A NULL or empty text has
    none; the same notice counts at each place; repeated rows are answered each. A column of this name is replaced.
    """
    base = without(docs, "licenses")
    kind = pa.list_(
        pa.struct([
            ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()),
            ("missing", pa.int32()), ("added", pa.int32()),
        ])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for t in part.column(text).to_pylist():
                    low = (t or "").lower()
                    rows.append(scanner.scan(t) if any(c in low for c in CUES) else [])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names=[*part.schema.names, "licenses"])

    return base.mapInArrow(run, plus(base, f"licenses {FOUND}"))
