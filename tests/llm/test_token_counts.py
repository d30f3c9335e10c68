"""Token counts against the tokenizer's own library."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from wattsift.llm import token_machine  # noqa: E402
from wattsift.llm.token_counts import count_tokens, vocabulary  # noqa: E402
from wattsift.llm.token_machine import TokenMachine, token_counts  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(model.encode(text)) if text else 0


@pytest.fixture(scope="module")
def machine():
    known = vocabulary(MODEL)
    return TokenMachine(known["pieces"], known["scores"])


def invented(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    letters = "abcdefeeetnis   \n\t.,0123=-_*日本語éñ▁🙂ß\x00"
    runs = ["x", "=", "-", " ", "e", "ab"]
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300))) for _ in range(n)]
    out += ["".join(rnd.choice("ai ") for _ in range(rnd.randint(0, 2000))) for _ in range(n // 10)]
    return out + ["".join(rnd.choice(runs) * rnd.randint(1, 900) for _ in range(rnd.randint(1, 6))) for _ in range(n // 10)]


def test_tokens_are_those_of_the_library(machine, library):
    texts = ["", None, " ", "  a  b ", "<s></s>", "<0x41>", "▁▁ a", "x" * 5000, " " * 5000, "日本語" * 900, *invented(1, 600)]
    assert token_counts(machine, texts) == [library(t) for t in texts]


def test_pieces_side_by_side(machine, library):
    rnd, pieces = random.Random(2), list(machine.scores)
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 50))) for _ in range(500)]
    assert token_counts(machine, texts) == [library(t) for t in texts]


def test_windows_and_dropped_states(machine, library, monkeypatch):
    """A long text is read in windows, and states may be forgotten between them."""
    monkeypatch.setattr(token_machine, "WINDOW", 700)
    monkeypatch.setattr(token_machine, "MOST_STATES", 300)
    monkeypatch.setattr(token_machine, "MOST_PAIRS", 300)
    texts = ["x" * 5001, "ab" * 3000, " " * 2000, "".join(invented(3, 60)), "", *invented(4, 60)]
    assert token_counts(machine, texts) == [library(t) for t in texts]


def test_states_that_a_map_lacks_are_added(machine, library, monkeypatch):
    """Without looking back at all but one character, composing the maps must still find each entry."""
    monkeypatch.setattr(token_machine, "LOOKBACK", 1)
    texts = ["x" * 3001, "aeinost" * 400, "ab" * 900, " " * 1999]
    assert token_counts(machine, texts) == [library(t) for t in texts]


def test_edges(edge, none, library):
    got = count_tokens(edge, MODEL, limit=3).select("text", "n_bytes", "n_tokens", "over_limit", "N_Words").collect()
    assert len(got) == edge.count()
    for r in got:
        assert r.n_tokens == library(r.text) and r.n_bytes == len((r.text or "").encode())
        assert r.over_limit == (r.n_tokens > 3)
    assert count_tokens(none, MODEL).count() == 0
    clash = edge.withColumn("N_Tokens", edge["clash"])
    assert [c.lower() for c in count_tokens(clash, MODEL).columns].count("n_tokens") == 1


def test_all_documents(docs_001, library):
    for r in count_tokens(docs_001, MODEL).select("text", "n_tokens").collect():
        assert r.n_tokens == library(r.text)


def test_other_kinds_of_model_are_refused(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        vocabulary(str(tmp_path / "missing.model"))
