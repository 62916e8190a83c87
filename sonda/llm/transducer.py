"""Token counts of byte-level BPE by a deterministic finite-state transducer.

State. Within a pre-token, BPE of a prefix ends in one certain token. A state holds, for every place where a token
may still be open, the token that ends there, the trie node of the open bytes, and how many tokens there are up to
there relative to the prefix read so far. Reading a byte extends all open tokens; the one that is complete and
stands stably after its predecessor is the last token of the longer prefix. A transition is annotated with the
change of the token count, so a text's count is the sum of its annotations. States and transitions are made when
first needed and kept, in a table of states x bytes that is begun anew when it is full.

Chunks. A batch of texts is cut into chunks of equal length that are read side by side. A chunk's state map is
constant from its first pre-token start on; what lies before that start depends on the state it is entered with.
The map of a head, or of a chunk without a start, is held for the states that it may be entered with: first for the
one in which a chunk ends that is entered as if a pre-token began there. A scan composes the maps from each known
state on; entries that the scan meets and a map lacks are read, side by side again, until none is missing.

Pre-token starts are a local property of the character classes, so they are found for all bytes at once.
"""

from __future__ import annotations

import json

import numpy as np
import regex

#: The printable stand-ins of bytes in byte-level vocabularies.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER, NUMBER, SPACE, BLANK, MARK, OTHER = range(6)
DEAD, START, CHUNK, MOST_STATES = 0, 1, 256, 200_000
#: So few heads are read faster one after another than side by side.
FEW = 64


def byte_of_stand_in() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        for m in regex.finditer(pattern + "+", text):
            a, b = (i + (0x800 if i >= 0xD800 else 0) for i in m.span())
            out[a:b] = kind
    out[32], out[39] = SPACE, MARK
    return out


class Transducer:
    """``most_states`` bounds the table; ``path`` is a tokenizer JSON with a byte-level BPE model."""

    def __init__(self, path: str, most_states: int = MOST_STATES):
        spec = json.load(open(path, encoding="utf-8"))
        as_byte = byte_of_stand_in()
        self.tokens = {bytes(as_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in as_byte for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pair = lambda m: tuple(bytes(as_byte[c] for c in t) for t in m)
        self.ranks = {p: r for r, p in enumerate(map(pair, merges))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[bytes | None] = [None]
        for t in self.tokens:
            if len(self.encode(t)) == 1:
                node = 0
                for b in t:
                    if b not in self.children[node]:
                        self.children[node][b] = len(self.children)
                        self.children.append({})
                        self.token_at.append(None)
                    node = self.children[node][b]
                self.token_at[node] = t
        self.classes = _classes()
        self._stable: dict[tuple[bytes, bytes], bool] = {}
        self.most_states = most_states
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [(), ((None, 0, 0),)]
        self.number = {s: i for i, s in enumerate(self.states)}
        #: Transitions read one by one.
        self.flat: dict[int, int] = {}
        #: Columns are given to bytes as they first occur.
        self.column, self.used = np.full(256, -1, np.int16), []
        self.table = np.full((1024, 64), -1, np.int32)
        self.table[DEAD] = 64 * DEAD + 32

    def encode(self, word: bytes) -> list[bytes]:
        """BPE of one pre-token by its merges, the reference for what the states compute."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, a: bytes | None, b: bytes) -> bool:
        if a is None:
            return True
        if (got := self._stable.get((a, b))) is None:
            if len(self._stable) > 2_000_000:
                self._stable.clear()
            got = self._stable[a, b] = self.encode(a + b) == [a, b]
        return got

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The next state and the change of the count."""
        open_, last, change = [], None, 0
        for before, node, count in state:
            if (n := self.children[node].get(byte)) is None:
                continue
            token = self.token_at[n]
            if last is None and token is not None and self.stable(before, token):
                last, change = token, count + 1
            if self.children[n]:
                open_.append((before, n, count))
        return (*((b, n, c - change) for b, n, c in open_), (last, 0, 0)), change

    def _compile(self, state: int, column: int) -> None:
        new, change = self.step(self.states[state], self.used[column])
        if (i := self.number.get(new)) is None:
            i = self.number[new] = len(self.states)
            self.states.append(new)
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table[: len(self.table) // 2], -1)])
        self.table[state, column] = 64 * i + change + 32

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The table columns of ``data``."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = len(self.used)
                self.used.append(b)
                if len(self.used) > self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                    self.table[DEAD] = 64 * DEAD + 32
        return self.column[data].astype(np.uint8)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: a mask over the bytes of texts that begin at ``offsets``."""
        n = len(data)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[data[lead]]
        wide = np.flatnonzero(data[lead] >= 0x80)
        if len(wide):
            at = lead[wide]
            x = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
            b, c = x[at], [x[at + i] & 0x3F for i in (1, 2, 3)]
            cp = np.where(b < 0xE0, (b & 0x1F) << 6 | c[0], np.where(b < 0xF0, (b & 0x0F) << 12 | c[0] << 6 | c[1], (b & 0x07) << 18 | c[0] << 12 | c[1] << 6 | c[2]))
            kind[wide] = self.classes[np.minimum(cp, 0x10FFFF)]
        m = len(lead)
        new = np.zeros(m + 3, bool)  # a text begins here
        new[np.searchsorted(lead, offsets[:-1][offsets[:-1] < n])] = True
        new[m:] = True
        edge = np.full(m + 3, 255, np.uint8)
        edge[:m] = kind
        prev = np.full(m, 255, np.uint8)
        prev[1:] = kind[:-1]
        prev[new[:m]] = 255
        nxt = edge[1 : m + 1].copy()
        nxt[new[1 : m + 1]] = 255
        blank, before, after = (np.isin(k, (SPACE, BLANK)) for k in (kind, prev, nxt))
        run = np.where(kind == MARK, OTHER, kind)
        run_before = np.where(prev == MARK, OTHER, prev)
        out = np.where(blank, ~before | (~after & (nxt != 255)), (run != run_before) & (prev != SPACE))
        marks = np.flatnonzero((kind == MARK) & out)
        if len(marks):  # 's 't 'm 'd 're 've 'll hold together and end there
            ch = np.zeros(m + 3, np.uint8)
            ch[:m] = data[lead]
            one, two = ch[marks + 1], ch[marks + 2]
            first, second = ~new[marks + 1], ~new[marks + 2]
            short = first & np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = first & second & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            out[marks[short] + 1] = False
            out[marks[long] + 1] = out[marks[long] + 2] = False
            for at, hit in ((marks + 2, short), (marks + 3, long)):
                ends = at[hit]
                ends = ends[ends < m]
                # what follows starts anew, but for blanks, which go by their own rule
                out[ends] |= ~blank[ends]
        mask = np.zeros(n, bool)
        mask[lead[out | new[:m]]] = True
        return mask

    def _read(self, symbols: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Read the rows of ``symbols`` one after another in all lanes; ``state`` is advanced; the changes of the count."""
        out = np.empty(symbols.shape, np.int8)
        for k in range(len(symbols)):
            state[fresh[k]] = START
            b = symbols[k]
            got = self.table[state, b]
            while got.min(initial=0) < 0:
                todo = np.flatnonzero(got < 0)
                for key in np.unique(state[todo].astype(np.int64) * 256 + b[todo]).tolist():
                    self._compile(key >> 8, key & 255)
                got = self.table[state, b]
            out[k] = (got & 63) - 32
            state[:] = got >> 6
        return out

    def changes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of every byte the change of the count; their sum over a text is its number of tokens."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int8)
        if len(self.states) > self.most_states:
            self._reset()
        fresh = self.starts(data, offsets)
        lanes = -(-n // CHUNK)
        pad = lanes * CHUNK - n
        data = self._columns(data)
        symbols = np.concatenate([data, np.full(pad, data[0])]).reshape(lanes, CHUNK)
        flags = np.concatenate([fresh, np.ones(pad, bool)]).reshape(lanes, CHUNK)
        state = np.full(lanes, DEAD, np.int64)
        out = np.ascontiguousarray(self._read(np.ascontiguousarray(symbols.T), np.ascontiguousarray(flags.T), state).T)
        head = np.where(flags.any(1), flags.argmax(1), CHUNK)
        self._scan(head, symbols, state, out)
        return out.reshape(-1)[:n]

    def _scan(self, head: np.ndarray, symbols: np.ndarray, state: np.ndarray, out: np.ndarray) -> None:
        """Compose the chunks' maps, and give the bytes before their first starts the changes of the states they are entered with."""
        todo = np.flatnonzero(head > 0)
        if not len(todo):
            return
        # maps by (chunk, entry): the exit and the changes of the head
        maps: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        guess = {int(i): START for i in todo[head[todo] == CHUNK]}
        self._heads(list(guess.items()), head, symbols, maps)
        guess = {i: maps[i, START][0] for i in guess}
        while True:
            missing, entry = [], {}
            for i in todo.tolist():
                before = i - 1
                if head[before] < CHUNK:
                    e = int(state[before])
                else:  # what is known of the chunk before, else what it gives if entered as guessed
                    e = maps[before, entry[before]][0] if (before, entry[before]) in maps else guess[before]
                entry[i] = e
                if (i, e) not in maps:
                    missing.append((i, e))
            if not missing:
                break
            self._heads(missing, head, symbols, maps)
        for i, e in entry.items():
            out[i, : head[i]] = maps[i, e][1]

    def _heads(self, asked: list[tuple[int, int]], head: np.ndarray, symbols: np.ndarray, maps: dict) -> None:
        """Add the maps of the (chunk, entry) pairs ``asked``."""
        if len(asked) <= FEW:
            for i, e in asked:
                maps[i, e] = self._alone(symbols[i, : head[i]], e)
            return
        at, now = (np.array(x, np.int64) for x in zip(*asked))
        order = np.argsort(-head[at], kind="stable")
        names = [asked[i] for i in order.tolist()]
        at, now = at[order], now[order]
        lens = head[at]
        changes = np.zeros((len(at), int(lens[0])), np.int8)
        for k in range(int(lens[0])):
            live = int(np.searchsorted(-lens, -k, "left"))
            part = now[:live]
            changes[:live, k] = self._read(symbols[at[:live], k][None], np.zeros((1, live), bool), part)[0]
        for i, name in enumerate(names):
            maps[name] = int(now[i]), changes[i, : lens[i]]

    def _alone(self, symbols: np.ndarray, state: int) -> tuple[int, np.ndarray]:
        """Exit and changes of one head, byte by byte."""
        out = bytearray(len(symbols))
        for k, b in enumerate(symbols.tobytes()):
            got = self.flat.get(state << 8 | b, -1)
            if got < 0:
                if self.table[state, b] < 0:
                    self._compile(state, b)
                got = self.flat[state << 8 | b] = int(self.table[state, b])
            out[k] = (got & 63) - 32 & 255
            state = got >> 6
        return state, np.frombuffer(out, np.int8)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; ``data`` must not hold special strings."""
        sums = np.concatenate([[0], np.cumsum(self.changes(data, offsets), dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]
