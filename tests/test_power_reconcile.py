import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import collected
from wattsift.functions.distance import edits_within
from wattsift.functions.text import LOST, fold, marks, signature
from wattsift.operators import ordered as O
from wattsift.operators import power as P
from wattsift.operators import reconcile as reconcile_module
from wattsift.operators.reconcile import prompt_classes, reconcile

START = dt.datetime(2024, 1, 1)
POWER = "device long, sample_id long, ts timestamp_ntz, watts double, counter_kwh double"
EXEC = "run_id long, device long, t0 timestamp_ntz, t1 timestamp_ntz"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    power, total = [], {}
    for i in range(600):
        device = 1 if rng.random() < 0.6 else rng.randint(2, 5)
        watts = float(rng.randint(1, 50))
        total[device] = total.get(device, 0) + int(watts)
        power.append((device, i, at(i * 600), watts, float(total[device])))
    runs = [(r, rng.randint(1, 6), at(t), at(t + rng.choice([0, 60, 5000, 90_000]))) for r, t in
            enumerate(rng.choices(range(0, 360_000, 300), k=80))]
    return power, runs


@pytest.fixture
def power(rows, data):
    return rows(POWER, *data[0])


@pytest.fixture
def runs(rows, data):
    return rows(EXEC, *data[1])


def test_counter_delta_and_integration(power, data):
    steps, energy, last = [], {}, {}
    for device, i, ts, watts, kwh in data[0]:
        before = last.get(device)
        steps.append((device, i, kwh - before[2] if before else None))
        area = (watts + before[1]) / 2 * (ts - before[0]).total_seconds() if before else 0.0
        energy[device] = energy.get(device, 0.0) + area
        last[device] = (ts, watts, kwh)
    got = P.counter_delta(power, O.time_chunk("ts"))
    assert collected(got, "device", "sample_id", "delta_kwh") == sorted(steps, key=repr)
    assert all(d is None or d >= 0 for _, _, d in steps)
    assert dict(collected(P.integrate(power), "device", "energy_j")) == pytest.approx(energy)


def trapezoids(samples, t0, t1):
    """Energy between two times by cutting every piece of the line at both ends."""
    total = 0.0
    for (a, wa), (b, wb) in zip(samples, samples[1:]):
        low, high = max(a, t0), min(b, t1)
        if low < high:
            watts = [wa + (wb - wa) * (t - a) / (b - a) for t in (low, high)]
            total += sum(watts) / 2 * (high - low).total_seconds()
    return total


@pytest.mark.parametrize("span", [600, 3600, 10**8])
def test_energy_between_cuts_the_line_at_both_ends(power, runs, data, rows, span):
    samples = {}
    for device, _, ts, watts, _ in data[0]:
        samples.setdefault(device, []).append((ts, watts))
    want = []
    for run, device, t0, t1 in data[1]:
        own = samples.get(device, [])
        covered = bool(own) and own[0][0] <= t0 and t1 <= own[-1][0]
        want.append((run, device, trapezoids(own, t0, t1), covered))
    got = collected(P.energy_between(runs, P.energy_index(power, O.time_chunk("ts", span)), O.time_chunk("ts", span)), "run_id", "device", "energy_j", "covered")
    assert [(r[0], r[1], r[3]) for r in got] == [(w[0], w[1], w[3]) for w in sorted(want, key=repr)]
    assert [r[2] for r in got] == pytest.approx([w[2] for w in sorted(want, key=repr)])


def test_energy_between_edges(rows):
    samples = rows(
        POWER, (1, 1, at(0), 10.0, None), (1, 2, at(10), 20.0, None), (1, 3, at(10), 40.0, None), (1, 4, at(20), 40.0, None),
        (1, 5, None, 99.0, None), (1, 6, at(15), None, None), (2, 7, at(5), 7.0, None),
    )
    runs = rows(
        EXEC, (1, 1, at(0), at(20)), (2, 1, at(-5), at(5)), (3, 1, at(20), at(30)), (4, 1, at(5), at(5)), (5, 1, None, at(5)),
        (6, 1, at(9), at(3)), (7, 2, at(0), at(9)), (8, 3, at(0), at(9)), (9, 1, at(10), at(15)),
    )
    index = lambda some: P.energy_index(some, O.time_chunk("ts"))
    got = {r.run_id: (r.energy_j, r.covered) for r in P.energy_between(runs, index(samples)).collect()}
    assert got == {
        1: (150.0 + 400.0, True), 2: (62.5, False), 3: (0.0, False), 4: (0.0, True), 5: (None, False), 6: (None, False),
        7: (0.0, False), 8: (0.0, False), 9: (200.0, True),
    }
    assert P.energy_between(runs.limit(0), index(samples)).count() == 0
    assert {r.energy_j for r in P.energy_between(runs.filter("run_id < 3"), index(samples.limit(0))).collect()} == {0.0}


def test_a_long_history_does_not_blur_a_short_execution(rows):
    """The whole parts are subtracted as integers: a second's energy is exact behind years of samples."""
    year = 365 * 86_400
    samples = rows(POWER, *[(1, k, at(k * year), 5e5, None) for k in range(11)], (1, 99, at(10 * year + 60), 5e5, None))
    runs = rows(EXEC, (1, 1, at(10 * year + 1), at(10 * year + 2)))
    years = O.time_chunk("ts", year)
    assert P.energy_between(runs, P.energy_index(samples, years), years).first().energy_j == 5e5


@pytest.mark.parametrize("bucket", [300, 7200, 10**7])
def test_range_join_is_complete(power, runs, data, bucket):
    want = [(r, i) for r, d, t0, t1 in data[1] for device, i, ts, _, _ in data[0] if d == device and t0 <= ts <= t1]
    got = P.range_join(runs, power, bucket, salts=3)
    assert collected(got, "run_id", "sample_id") == sorted(want, key=repr)


def test_asof_takes_a_reading_at_the_same_time(power, runs, data):
    def seen(device, t):
        found = [kwh for d, _, ts, _, kwh in data[0] if d == device and ts <= t]
        return found[-1] if found else None

    want = [(r, seen(d, t0), seen(d, t1)) for r, d, t0, t1 in data[1]]
    for chunk in (O.time_chunk("ts", O.DAY), O.time_chunk("ts")):
        got = P.asof_join(runs, power, chunk)
        assert collected(got, "run_id", "kwh_before", "kwh_after") == sorted(want, key=repr)


def test_idle_baseline_is_zero_without_readings(rows):
    power = rows(POWER, (1, 1, at(0), 1.0, 0.0), (1, 2, at(10), 1.0, 0.001), (1, 3, at(99), 1.0, 5.0))
    windows = rows("device long, t0 timestamp_ntz, t1 timestamp_ntz", (1, at(0), at(10)), (2, at(0), at(10)))
    assert collected(P.idle_baseline(power, windows), "device", "idle_w") == [(1, pytest.approx(360.0)), (2, 0.0)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bounded_distance_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 12))) for _ in range(2))
        full = plain_distance(a, b)
        for limit in (0, 1, 3):
            assert edits_within(a, b, limit) == (full if full <= limit else -1)


LETTERS = {"latin": "abcd ", "cyrillic": "абвг ", "han": "水火木金土", "beyond": "𐍈𐍉𐍊 "}
OPENING = {"latin": "explain what is meant by ", "cyrillic": "объясни своими словами что такое ", "han": "请用自己的话解释", "beyond": "𐍈𐍉𐍈𐍉 "}


@pytest.mark.parametrize("script", sorted(LETTERS))
@pytest.mark.parametrize("limit,busy", [(1, 1000), (3, 1000), (3, 0), (3, 5)])
def test_reconcile_equals_brute_force(rows, limit, busy, script):
    """Near copies under a common opening, short texts, copies, and a split of every crowded key, in several scripts."""
    rng = random.Random(limit)
    letters, opening = LETTERS[script], OPENING[script]

    def mutate(text):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(text) + 1)
            text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice(letters.strip()) + text[i:]])
        return text

    base = [opening + "".join(rng.choices(letters, k=12)).strip() for _ in range(25)] + [letters[:n] for n in (1, 2, 3)]
    a = [(i, t) for i, t in enumerate(base)] + [(100, base[0].upper() + "!")]
    b = [(200 + i, mutate(t)) for i, t in enumerate(base)] + [(300, base[3]), (301, base[3] + " ?")]

    def fold(pairs):
        texts = {}
        for i, t in pairs:
            norm = " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
            texts[norm] = min(i, texts.get(norm, i))
        return texts

    fa, fb = fold(a), fold(b)
    want = [(fa[t], fb[t], 0) for t in fa if t in fb]
    for x in fa.keys() - fb.keys():
        for y in fb.keys() - fa.keys():
            d = plain_distance(x, y)
            if d <= limit:
                want.append((fa[x], fb[y], d))
    schema = "prompt_id long, prompt string"
    got = reconcile(rows(schema, *a), rows(schema, *b), limit, busy=busy)
    assert collected(got, "id_a", "id_b", "distance") == sorted(want, key=repr)
    both = rows(schema, *a, *b)
    classes = {t: min(i for s in (fa, fb) for x, i in s.items() if x == t) for t in fa | fb}
    named = {r.prompt_id: r.id for r in prompt_classes(both).collect()}
    assert named == {i: classes.get(" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())) for i, t in a + b}


def test_folding():
    same = [
        ("Straße, ÉTÉ!", "strasse ete"), ("ΟΔΟΣ", "οδος"), ("Ёлка", "елка"), ("Ａ１　Ｂ", "a1 b"), ("한국어", "\u1112\u1161\u11ab국어"),
        ("e\u0301", "é"), ("ﬁne™", "finetm"), ("a_b-c", "a b c"), ("", "?!"),
    ]
    assert [fold(x) == fold(y) for x, y in same] == [True] * len(same)
    assert fold("कि") != fold("का") and fold("水") != fold("火") and fold("한국어") == "한국어"
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices("ab水火 ж𐍈", k=rng.randint(0, 9)))
        i = rng.randrange(len(text) + 1)
        edits = [text[:i] + text[i + 1:], text[:i] + "金" + text[i:], text[:i] + "q" + text[i + 1:]]
        assert all(abs(x - y) <= 1 for e in edits for x, y in zip(signature(text), signature(e), strict=True))


def test_texts_that_fold_to_nothing_match_nothing(rows):
    a = rows("prompt_id long, prompt string", (1, "Привет"), (2, "same text"), (3, "?!"), (4, None), (5, None))
    b = rows("prompt_id long, prompt string", (7, "你好"), (8, "Same, text"), (9, ""), (10, "привет!"), (11, None))
    assert collected(reconcile(a, b), "id_a", "id_b", "distance") == [(1, 10, 0), (2, 8, 0)]
    assert collected(prompt_classes(a)) == [(1, 1), (2, 2), (3, None), (4, None), (5, None)]
    assert reconcile(a.limit(0), b).count() == 0 and prompt_classes(a.limit(0)).count() == 0


def edited(rng, text, letters):
    i, new = rng.randrange(len(text) + 1), rng.choice(letters)
    return rng.choice([text[:i] + text[i + 1 :], text[:i] + new + text[i:], text[:i] + new + text[i + 1 :]])


def marks_of(*texts):
    return [set(m.tolist()) for m in marks([np.array([ord(c) for c in t], dtype="u4") for t in texts])]


def test_an_edit_changes_few_marks():
    rng = random.Random(4)
    for _ in range(2000):
        letters = rng.choice(["ab", "abcdefgh ", "水火木金土"])
        text = "".join(rng.choices(letters, k=rng.randint(0, 200)))
        before, after, alone = *marks_of(text, edited(rng, text, letters)), marks_of(text)[0]
        assert max(len(before - after), len(after - before)) <= LOST and before == alone
    long = "".join(rng.choices("abcdefgh ", k=150_000))
    assert marks_of("ab", long, "")[1] >= marks_of(long[:90_000])[0] | marks_of(long[60_000:])[0]


def long_texts(rng):
    """Families of near copies with many marks, with about as many as are needed, and with few for their length."""
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(200)]
    passage = " ".join(rng.choices(words, k=60))
    base = [passage + " " + " ".join(rng.choices(words, k=n)) for n in (20, 40, 90, 150)]
    base += [" ".join(rng.choices(words, k=n)) for n in range(18, 48, 3)] + ["ab " * 150, "a" * 400, "abcdefg h" * 40]
    a = b = ()
    for text in base:
        for k in (1, 3, 4, 7):
            x = y = text
            for _ in range(k):
                x = edited(rng, x, "abcdefgh")
                y = edited(rng, y, "abcdefgh") if rng.random() < 0.6 else y
            a, b = (*a, x), (*b, y)
    return list(enumerate(a)), list(enumerate(b, 500))


@pytest.mark.parametrize("limit,busy", [(2, 1000), (6, 1000), (6, 0), (6, 3)])
def test_reconcile_of_long_texts_equals_brute_force(rows, limit, busy):
    a, b = long_texts(random.Random(limit + busy))
    fa, fb = ({t: i for i, t in reversed([(i, fold(t)) for i, t in side])} for side in (a, b))
    want = [(fa[t], fb[t], 0) for t in fa if t in fb]
    for x in fa.keys() - fb.keys():
        for y in fb.keys() - fa.keys():
            d = edits_within(x, y, limit)
            want += [(fa[x], fb[y], d)] if d >= 0 else []
    schema = "prompt_id long, prompt string"
    got = reconcile(rows(schema, *a), rows(schema, *b), limit, busy=busy)
    assert len(want) > 20 and collected(got, "id_a", "id_b", "distance") == sorted(want, key=repr)


def test_long_texts_bring_few_keys(rows, monkeypatch):
    """The keys of a text, probing for partners within 6 edits, do not grow with the places that edits can shift."""
    counted = {}

    def probed(texts, d, plain=reconcile_module._probed):
        keys = plain(texts, d)
        counted.update(keys=keys.count(), texts=texts.count())
        return keys

    monkeypatch.setattr(reconcile_module, "_probed", probed)
    rng = random.Random(6)
    texts = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200))) for i in range(20)]
    schema = "prompt_id long, prompt string"
    got = reconcile(rows(schema, *texts), rows(schema, *((i, t[3:] + "x") for i, t in texts)), 6)
    assert collected(got, "id_a", "id_b") == [(i, i) for i in sorted(range(20), key=lambda i: repr((i, i)))]
    assert counted["texts"] == 20 and counted["keys"] <= 2 * 20 * (6 * LOST + 1)
