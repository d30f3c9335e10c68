"""A byte-pair vocabulary compiled to a deterministic transducer that counts tokens.

Two tokens may stand side by side exactly if encoding the two of them gives them back, and a text has just one sequence
of such neighbours: its tokens. So the last token of each prefix of a text follows from the last tokens of the shorter
prefixes, and a machine that keeps those which a token may still begin at reads the text once, from left to right. A
state is the last token, and for every open beginning its place in the tree of pieces, the token before it and how many
tokens fewer it stands for. A transition carries the change of the count. States and transitions are made when a text
first asks for them.

Where no piece holds two neighbouring characters, a token must end between them: there the machine starts afresh.
"""

from collections.abc import Iterator

import numpy as np

SPACE = "▁"  # pieces write a blank so
START, MOST_STATES, MOST_PAIRS, FEW = 0, 250_000, 500_000, 6
CHUNK, REACH, LOOKBACK, WINDOW = 256, 64, 32, 1 << 19


def merged(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """The symbols after merging neighbours, the pair of the best score first, then the leftmost."""
    symbols = list(symbols)
    while True:
        best = None
        for k in range(len(symbols) - 1):
            score = scores.get(symbols[k] + symbols[k + 1])
            if score is not None and (best is None or score > best[0]):
                best = score, k
        if best is None:
            return symbols
        k = best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


class TokenMachine:
    """``pieces`` and their ``scores``: the ordinary pieces of a vocabulary with byte fallback."""

    def __init__(self, pieces: list[str], scores: list[float]):
        self.scores = dict(zip(pieces, scores))
        letters = sorted(set("".join(pieces)))
        n = len(letters)
        #: classes of characters: 1 to n the letters of pieces, then others of 1 to 4 bytes.
        self.letters, self.width = letters, n + 5
        code = np.full(0x110000, n + 4, np.uint16)
        code[:0x10000], code[:0x800], code[:0x80] = n + 3, n + 2, n + 1
        for k, c in enumerate(letters, 1):
            code[ord(c)] = k
        self.code = code
        self.code[ord(" ")] = self.code[ord(SPACE)]
        self.weight = [0, *(1 if c in self.scores else len(c.encode()) for c in letters), 1, 2, 3, 4]
        self._tree(pieces)
        joint = np.zeros(self.width * self.width, bool)
        rank = {c: k for k, c in enumerate(letters, 1)}
        for p in pieces:
            for a, b in zip(p, p[1:]):
                joint[rank[a] * self.width + rank[b]] = True
        self.joint = np.packbits(joint, bitorder="little")
        self.fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _tree(self, pieces: list[str]) -> None:
        """Node 0 is the root; (node, class) -> node. A node's token is its own number, if it stands for one."""
        self.child: dict[tuple[int, int], int] = {}
        self.text, self.token, self.inner = [""], [False], [True]
        for p in [*self.letters, *pieces]:
            node = 0
            for c in p:
                k = int(self.code[ord(c)])
                if (node, k) not in self.child:
                    self.child[node, k] = len(self.text)
                    self.text.append(self.text[node] + c)
                    self.token.append(False)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.child[node, k]
            self.token[node] = True
        for node, text in enumerate(self.text):  # a piece that its own characters do not merge to never appears
            self.token[node] = self.token[node] and merged(list(text), self.scores) == [text]
        #: the tokens beyond a node, while they are few
        self.beyond: list[list[int] | None] = [[] for _ in self.text]
        for (parent, _), node in reversed(self.child.items()):  # children stand behind their parents
            own = self.beyond[node]
            all_ = None if own is None or self.beyond[parent] is None else self.beyond[parent] + own + [node] * self.token[node]
            self.beyond[parent] = all_ if all_ is not None and len(all_) <= FEW else None

    def _forget(self, keep: tuple = (0, ())) -> int:
        """Drop all states but the first and ``keep``; the number of ``keep``. The memory of a task stays bounded."""
        if len(self.fits) > MOST_PAIRS:
            self.fits = {}
        self.states: list[tuple] = [(0, ())]
        if keep != self.states[0]:
            self.states.append(keep)
        self.number: dict[tuple, int] = {state: k for k, state in enumerate(self.states)}
        self._table(1 << 14)
        return len(self.states) - 1

    def _table(self, size: int) -> None:
        self.bits = size.bit_length() - 1
        self.keys = np.full(size, -1, np.int64)
        self.next, self.gain, self.used = np.zeros(size, np.int32), np.zeros(size, np.int16), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The table slot of each key, or a free one where it belongs."""
        slot = self._slot(keys)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return slot

    def _add(self, keys: list[int], to: list[int], gains: list[int]) -> None:
        if 2 * (self.used + len(keys)) >= len(self.keys):
            had = np.flatnonzero(self.keys >= 0)
            keys, to, gains = self.keys[had].tolist() + keys, self.next[had].tolist() + to, self.gain[had].tolist() + gains
            self._table(1 << (4 * len(keys)).bit_length())
        keys_, rest = np.array(keys, np.int64), np.arange(len(keys))
        while len(rest):
            slot = self._find(keys_[rest])
            _, one = np.unique(slot, return_index=True)  # of keys that want the same free place the first gets it
            won = rest[one]
            self.keys[slot[one]], self.next[slot[one]] = keys_[won], np.array(to, np.int64)[won]
            self.gain[slot[one]] = np.array(gains, np.int64)[won]
            rest = np.delete(rest, one)
        self.used += len(keys)

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; before the first token (0) nothing stands."""
        if not a:
            return True
        if (a, b) not in self.fits:
            left, right = self.text[a], self.text[b]
            self.fits[a, b] = merged([*left, *right], self.scores) == [left, right]
        return self.fits[a, b]

    def _class(self, a: int, node: int) -> int:
        """Token a as far as tokens beyond the node tell it from others: 0 if all fit behind it, -1 if none does."""
        few = self.beyond[node]
        if not a or few is None:
            return a
        fit = [self._fit(a, b) for b in few]
        return 0 if all(fit) else a if any(fit) else -1

    def _compile(self, state: int, letter: int) -> tuple[int, int]:
        """The state after ``letter`` and the change of the count."""
        last, open_ = self.states[state]
        if letter > len(self.letters):
            return START, self.weight[letter]
        gain, ends, kept = None, 0, []
        for node, before, fewer in (*open_, (0, last, 0)):
            node = self.child.get((node, letter))
            if node is None:
                continue
            if gain is None and self.token[node] and self._fit(before, node):
                ends, gain = node, fewer + (self.weight[letter] if len(self.text[node]) == 1 else 1)
            if self.inner[node]:
                before = self._class(before, node)
                if before >= 0:
                    kept.append((node, before, fewer))
        if gain is None:
            raise AssertionError("no token ends here")
        new = (ends, tuple((node, before, fewer - gain) for node, before, fewer in kept))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new], gain

    def step(self, states: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states * np.int64(self.width) + letters
        slot = self._find(keys)
        if (self.keys[slot] != keys).any():
            new = np.unique(keys[self.keys[slot] != keys]).tolist()
            made = [self._compile(*divmod(key, self.width)) for key in new]
            self._add(new, [to for to, _ in made], [gain for _, gain in made])
            slot = self._find(keys)
        return self.next[slot], self.gain[slot]

    def run(self, letters: np.ndarray, cut: np.ndarray, first: np.ndarray, stop: np.ndarray, states: np.ndarray):
        """Every lane reads letters first[i]:stop[i] from states[i], all side by side: end states and counts."""
        order = np.argsort(first - stop, kind="stable")
        at, steps = first[order], (stop - first)[order]
        now, count = states[order].astype(np.int64), np.zeros(len(order), np.int64)
        live = len(order) - np.searchsorted(steps[::-1], np.arange(1, steps[0] + 1 if len(steps) else 1), "left")
        for k, m in enumerate(live):
            place = at[:m] + k
            now[:m], gain = self.step(np.where(cut[place], START, now[:m]), letters[place])
            count[:m] += gain
        ends, counts = np.empty_like(now), np.empty_like(count)
        ends[order], counts[order] = now, count
        return ends, counts

    def window(self, letters: np.ndarray, cut: np.ndarray, texts: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Tokens of each text of a stretch, texts beginning at ``texts``, and the state at its end.

        The stretch is dealt in chunks, cut where the machine starts afresh if such a place is near. Elsewhere the state
        at the cut is not known: the chunk is read from every state that some of the characters before lead to, which
        gives a map of states. Maps compose in a prefix scan; a state outside of a map is added to it.
        """
        n = len(letters)
        fresh = np.where(cut, np.arange(n), n)
        fresh = np.minimum.accumulate(fresh[::-1])[::-1]
        wished = np.arange(0, n, CHUNK)
        near = fresh[wished]
        first = np.unique(np.concatenate((np.where(near - wished <= REACH, near, wished), texts, [0])))
        first = first[first < n]
        stop = np.append(first[1:], n)
        maps = _Maps(self, letters, cut, first, stop, entry)
        inside, end = maps.composed()
        sums = np.concatenate(([0], np.cumsum(inside)))
        return np.diff(sums[np.searchsorted(first, np.append(texts, n))]), end


class _Maps:
    """What each chunk makes of the states it may be entered in: slot d of chunk k leads to ``to[k, d]`` of chunk k + 1."""

    def __init__(self, machine: TokenMachine, letters, cut, first, stop, entry: int):
        self.machine, self.letters, self.cut, self.first, self.stop = machine, letters, cut, first, stop
        known = cut[first]
        known[0] = True
        self.known = known
        chunk, states = np.flatnonzero(known), np.where(cut[first[known]], START, entry)
        unsure = np.flatnonzero(~known)
        if len(unsure):
            back = np.arange(1, LOOKBACK + 1)
            begin = np.maximum(first[unsure][:, None] - back, 0).ravel()
            ends, _ = machine.run(letters, cut, begin, np.repeat(first[unsure], LOOKBACK), np.full(len(begin), START))
            pairs = np.unique(np.stack((np.repeat(unsure, LOOKBACK), ends)), axis=1)
            chunk, states = np.concatenate((chunk, pairs[0])), np.concatenate((states, pairs[1]))
        self.chunk, self.state = chunk, states
        self.exit, self.count = machine.run(letters, cut, first[chunk], stop[chunk], states)

    def composed(self) -> tuple[np.ndarray, int]:
        """Tokens in each chunk as it is really entered, and the last state."""
        while True:
            order = np.lexsort((self.state, self.chunk))
            for name in ("chunk", "state", "exit", "count"):
                setattr(self, name, getattr(self, name)[order])
            at, missing = self._entries()
            if missing is None:
                return self.count[at], int(self.exit[at[-1]])
            k, state = missing
            one = np.array([k])
            ends, counts = self.machine.run(self.letters, self.cut, self.first[one], self.stop[one], np.array([state]))
            self.chunk, self.state = np.append(self.chunk, k), np.append(self.state, state)
            self.exit, self.count = np.append(self.exit, ends), np.append(self.count, counts)

    def _entries(self):
        """The row of each chunk's map that holds its entry, by a prefix scan; or the first entry that a map lacks."""
        n, rows = len(self.first), len(self.chunk)
        base = np.searchsorted(self.chunk, np.arange(n + 1))
        if rows == n:  # every chunk has the one state
            lacking = np.flatnonzero(~self.known[1:] & (self.exit[:-1] != self.state[1:]))
            return np.arange(n), (int(lacking[0]) + 1, int(self.exit[lacking[0]])) if len(lacking) else None
        # step[r]: the row of the next chunk that row r leads to; the void row is its own successor
        wide = self.chunk * np.int64(1 << 32) + self.state
        after = np.minimum(self.chunk + 1, n - 1)
        wanted = after * np.int64(1 << 32) + self.exit
        found = np.minimum(np.searchsorted(wide, wanted), rows - 1)
        step = np.where(wide[found] == wanted, found, rows)
        step = np.where(self.known[after], base[after], step)
        step = np.append(np.where(self.chunk == n - 1, rows, step), rows)
        at = np.zeros(n, np.int64)  # at[k] for k < done is right; doubling composes the maps of spans of chunks
        done = 1
        while done < n:
            more = min(done, n - done)
            at[done : done + more] = step[at[:more]]
            step = step[step]
            done += more
        void = np.flatnonzero(at == rows)
        if not len(void):
            return at, None
        k = int(void[0])
        return at, (k, int(self.exit[at[k - 1]]))

    @staticmethod
    def cuts(machine: TokenMachine, letters: np.ndarray, before: int) -> np.ndarray:
        """Whether a token must end before each letter; ``before``: the class of the letter in front, 0 for none."""
        prev = np.empty(len(letters), np.int64)
        prev[:1], prev[1:] = before, letters[:-1]
        key = prev * machine.width + letters
        return ((machine.joint[key >> 3] >> (key & 7).astype(np.uint8)) & 1) == 0


def token_counts(machine: TokenMachine, texts: list[str | None]) -> list[int]:
    """Tokens of whole texts; none in NULL and empty ones. Long texts are read in windows, the state carried over."""
    counts = [0] * len(texts)
    for part in _windows(texts):
        if len(machine.states) > MOST_STATES:
            machine._forget()
        which, stretch = part
        if len(which) == 1 and len(stretch) > WINDOW:
            state, before = START, 0
            for k in range(0, len(stretch), WINDOW):
                if len(machine.states) > MOST_STATES:
                    state = machine._forget(machine.states[state])
                letters = _letters(machine, stretch[k : k + WINDOW])
                cut = _Maps.cuts(machine, letters, before)
                found, state = machine.window(letters, cut, np.zeros(1, np.int64), state)
                counts[which[0]] += int(found[0])
                before = int(letters[-1])
        else:
            letters = _letters(machine, stretch)
            starts = np.cumsum([0] + [len(texts[t]) + 1 for t in which])[:-1]
            cut = _Maps.cuts(machine, letters, 0)
            cut[starts] = True
            for t, found in zip(which, machine.window(letters, cut, starts, START)[0].tolist()):
                counts[t] = found
    return counts


def _letters(machine: TokenMachine, stretch: str) -> np.ndarray:
    return machine.code[np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)


def _windows(texts: list[str | None]) -> Iterator[tuple[list[int], str]]:
    """Numbers of texts, and the texts one behind the other with the blank that each begins with."""
    which, size = [], 0
    for t, text in enumerate(texts):
        if not text:
            continue
        if which and size + len(text) + 1 > WINDOW:
            yield which, "".join(SPACE + texts[k] for k in which)
            which, size = [], 0
        which.append(t)
        size += len(text) + 1
    if which:
        yield which, "".join(SPACE + texts[k] for k in which)
