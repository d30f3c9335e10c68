"""Prompt, response and label text."""

import re
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wattsift.schemas import CATEGORY_LABELS, PRECISION_LABELS

def strip_ws(text: Column) -> Column:
    """Strip all leading and trailing whitespace (``trim`` only strips spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def chat_prompt(text: Column) -> Column:
    """Fixed value: the chat markers around a prompt."""
    return F.concat(F.lit("<|user|>\n"), text, F.lit("<|end|>\n<|assistant|>\n"))


def judge_request(prompt: Column, response: Column) -> Column:
    """Fixed value: the delimiters of a request to a judge."""
    return F.concat(F.lit("PROMPT: "), prompt, F.lit("\n\nAI RESPONSE: "), response)


def tokens(text: Column) -> Column:
    """Whitespace tokens; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != F.lit(""))


def drop_prefix(sequence: Column, prefix_length: Column) -> Column:
    return F.slice(sequence, prefix_length + 1, F.greatest(F.size(sequence), F.lit(1)))


class _Words(dict):
    """Character table for ``str.translate``: letters, digits and their marks stay, all else is a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if unicodedata.category(chr(code))[0] in "LNM" else 32
        return self[code]


_WORDS = _Words()
# Fixed value: the accents that stand above or below letters of many scripts.
_ACCENTS = re.compile("[\u0300-\u036f]+")


def fold(text: str) -> str:
    """Case, accents, forms of a character, punctuation and spacing folded away, in any script.

    Signs that carry vowels (in Indic scripts, say) are no accents and stay.
    """
    if text.isascii():
        text = text.lower()
    else:
        apart = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
        text = unicodedata.normalize("NFC", _ACCENTS.sub("", apart))
    return " ".join(text.translate(_WORDS).split())


# A text's signature: how many of its characters have bit 0, 1, 2, 3 of the code point set, in any script.
# One edit changes each count by at most one.
SIGNATURE = ["bit0", "bit1", "bit2", "bit3"]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _counts(codes: np.ndarray) -> list[int]:
    return [np.count_nonzero(codes & (1 << bit)) for bit in range(len(SIGNATURE))]


def signature(text: str) -> list[int]:
    return _counts(_codes(text))


# A gram is 8 characters; it is chosen if its hash is below those of the 5 grams on either side.
GRAM, REACH = 8, 5
WINDOW = 2 * REACH + GRAM  # characters that decide on a gram
# Chosen grams are more than REACH apart, so at most this many windows hold the place of one edit.
LOST = -(-WINDOW // (REACH + 1))
_BLOCK = 1 << 16
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
_WIDE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows around the chosen grams of a block."""
    grams = codes * _ODD[0]
    grams ^= grams >> np.uint32(15)
    for step, odd in zip((1, 2, 4), _ODD[1:], strict=False):
        longer = grams[:-step] * odd
        longer += grams[step:]
        grams = longer
    grams *= _ODD[4]
    n = len(grams) - 2 * REACH
    least = grams[: n + REACH + 1].copy()  # of each gram and those up to the next REACH
    for i in range(1, REACH):
        np.minimum(least, grams[i : i + n + REACH + 1], out=least)
    others = np.minimum(least[:n], least[REACH + 1 :])
    at = np.flatnonzero(grams[REACH : REACH + n] < others)
    # The grams at both ends and in the middle cover the window.
    hashes = grams[at] * _WIDE[0] + grams[at + REACH] * _WIDE[1] + grams[at + 2 * REACH]
    hashes ^= hashes >> np.uint64(32)
    hashes *= _WIDE[2]
    return at, (hashes ^ (hashes >> np.uint64(29))).view(np.int64)


def marks(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct hashes of each text's windows, ascending; texts are given as code points.

    Whether a window counts depends on its own characters alone: one edit takes away at most ``LOST`` marks and adds
    at most as many.
    """
    joined, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    starts = range(0, max(len(joined) - WINDOW + 1, 0), _BLOCK)
    found = [(at + i, hashes) for i in starts for at, hashes in [_windows(joined[i : i + _BLOCK + WINDOW - 1])]]
    if not found:
        return [np.empty(0, dtype=np.int64)] * len(texts)
    at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    of = np.searchsorted(ends, at, side="right")
    inside = at + WINDOW <= ends[of]
    of, hashes = of[inside], hashes[inside]
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return np.split(hashes[new], np.searchsorted(of[new], np.arange(1, len(texts))))


def _groups(norms: list[str]) -> Iterator[list[str]]:
    """Texts in order, so many together as fill a block."""
    start, size = 0, 0
    for end, norm in enumerate(norms, 1):
        size += len(norm)
        if size >= _BLOCK or end == len(norms):
            yield norms[start:end]
            start, size = end, 0


def marks_needed(edits: int) -> tuple[int, int]:
    """Texts within that many edits share one of their first so many marks, if both have them; and how many marks
    leave their partners enough."""
    return LOST * edits + 1, 2 * LOST * edits + 1


def comparable(edits: int) -> Callable[[Column], Column]:
    """Struct of a text folded (``norm``, empty for NULL), its digest, length and signature, the first marks that texts
    within ``edits`` share, and the number of its marks, as far as it matters."""
    first, enough = marks_needed(edits)
    numbers = ["length", *SIGNATURE, "n_marks"]

    @F.pandas_udf(", ".join(["norm string", "digest binary", "marks array<bigint>", *(f"{name} int" for name in numbers)]))
    def folded(texts: pd.Series) -> pd.DataFrame:
        norms = ["" if t is None else fold(t) for t in texts]
        measures, digests, kept = [], [], []
        for group in _groups(norms):
            codes = [_codes(n) for n in group]
            found = marks(codes)
            measures += [(len(c), *_counts(c), min(len(m), enough)) for c, m in zip(codes, found, strict=True)]
            digests += [sha256(n.encode("utf-8", "surrogatepass")).digest() for n in group]
            kept += [m[:first].copy() for m in found]
        rows = pd.DataFrame(measures, columns=numbers, dtype="int32")
        for i, (name, values) in enumerate([("norm", norms), ("digest", digests), ("marks", kept)]):
            rows.insert(i, name, pd.Series(values, dtype="object"))
        return rows

    return folded


def folded_digest() -> Callable[[Column], Column]:
    """SHA-256 of a text folded, which tells texts apart in 32 bytes; NULL for NULL and where nothing is left."""

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        norms = (None if t is None else fold(t) for t in texts)
        return pd.Series([sha256(n.encode("utf-8", "surrogatepass")).digest() if n else None for n in norms], dtype="object")

    return digest


def _folded(label: Column) -> Column:
    return F.regexp_replace(F.lower(strip_ws(label)), r"[_\s-]+", "-")


def _lookup(label: Column, known: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.create_map(*pairs)[_folded(label)]


def category_label(label: Column, known: dict[str, str] | None = None) -> Column:
    """Known spellings map to one label; others are kept, stripped."""
    return F.coalesce(_lookup(label, known or CATEGORY_LABELS), strip_ws(label))


def precision_label(label: Column) -> Column:
    return F.coalesce(_lookup(label, PRECISION_LABELS), strip_ws(label))


# Fixed value: a fused "Model Precision" label.
MODEL_LABEL = r"^(.*\S)\s+(FP16|NF4|F16|Q4_K_M)$"


def model_name(label: Column) -> Column:
    return F.when(label.rlike(MODEL_LABEL), F.regexp_extract(label, MODEL_LABEL, 1)).otherwise(label)


def model_precision(label: Column) -> Column:
    return F.when(label.rlike(MODEL_LABEL), F.regexp_extract(label, MODEL_LABEL, 2))


def number_or_null(text: Column) -> Column:
    """Blank or malformed numeric text is NULL, also under ANSI."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")
