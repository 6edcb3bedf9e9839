"""Byte-level BPE as a deterministic automaton over tokens, and exact prefix counts on top of it.

``Automaton`` compiles a merge list by one *merge gadget* per merge, in order of priority. The automaton that reads
tokens starts as one state that loops on every byte. The gadget of the merge (u, v) -> uv

1. sends every arc labelled u to a copy of its target in which v can no longer be read, and
2. gives every state that can read u an arc uv to where v led before.

After the last merge the automaton reads exactly the token strings that BPE produces. All arcs of one label lead to one
state, so a state is the set of labels that it does *not* read. A token that gets built by a merge is unreadable in a
state when its left part is, hence these sets are unions of subtrees of the left-part forest, cut by merge rank. In a
preorder with late merges first each such subtree is one range, so that automaton is stored as a few ranges per state.

Words are read byte by byte through a second table, whose arcs are stored: each prefix of a word has exactly one path through
the token automaton, and its last token depends on no more than the longest suffix that begins a token and that automaton's
states at the places in it from which a token may begin. These are the byte states. An arc is worked out when it is first walked and looked up from then on; a walk
goes left to right, one arc a byte, and never back. At ``MOST`` states a worker starts its table anew.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import regex

#: Instead of the token automaton's state at a place: the start of the word, or a place that doesn't matter.
START, UNUSED = -1, -2
#: The most byte states that a worker holds.
MOST = 250_000
#: The pre-tokenisation pattern of the public byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)
#: The white space of that pattern (Unicode White_Space), for the cut into chunks that never changes a pre-token.
WHITE = r"\t-\r \x85\xa0  -     　"
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


#: The same pattern where all characters lie below U+0300 and no separator is one that only Python takes for white space.
_LETTERS, _DIGITS = (re.escape("".join(c for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == k)) for k in "LN")
LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\u02ff]")


def pre_tokens(text: str) -> list[str] | None:
    """The pre-tokens of a text; None where it takes the general pattern."""
    return None if NOT_LATIN.search(text) else LATIN.findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, the rest is moved past 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(moved)}


class Automaton:
    """Deterministic automaton of one vocabulary. ``labels[i]`` are the bytes that arc i emits."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        size = 1 + max([*vocab.values(), *special.values()])
        self.labels: list[bytes] = [b""] * size
        self.id_of: dict[bytes, int] = {}
        for s, i in vocab.items():
            if all(c in letters for c in s) and s not in special:
                self.labels[i] = raw(s)
                self.id_of[self.labels[i]] = i
        self.special = special
        for s, i in special.items():
            self.labels[i] = s.encode()
        self._compile([(self.id_of[raw(u)], self.id_of[raw(v)], self.id_of[raw(u) + raw(v)]) for u, v in merges])
        self.lengths = [len(x) for x in self.labels]
        self.fits = Memo(lambda pair: self.reads(pair >> 24, pair & 0xFFFFFF), 300_000)
        self.whole = {x: i for x, i in self.id_of.items() if self.reach[i]}
        self.heads = {x[:k] for x in self.whole for k in range(len(x) + 1)}
        self._forget()

    def _forget(self) -> None:
        #: Byte states are numbered 0, 256, 512, ...; an arc is stored under its state plus its byte.
        self.arcs: dict[int, int] = {}
        #: The last token of what has been read at each state, and what the state follows from.
        self.last: list[int] = [-1]
        self.facts: list[tuple[bytes, tuple[int, ...], int]] = [(b"", (START,), -1)]
        self.states_of = {self.facts[0]: 0}

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        size = len(self.labels)
        rank, left = [-1] * size, [-1] * size
        #: The state that each label leads to: {label: rank from which it and what grows from it is unreadable}.
        to: list[dict[int, int] | None] = [None] * size
        shared = [True] * size  # whether another label leads to the same state
        start: dict[int, int] = {}
        for b in range(256):
            if (i := self.id_of.get(bytes([b]))) is not None:
                to[i] = start

        def readable(state: dict[int, int], token: int) -> bool:
            child_rank = 1 << 60
            while token >= 0:
                if state.get(token, 1 << 60) <= child_rank and token in state:
                    return False
                child_rank, token = rank[token], left[token]
            return True

        children: dict[int, list[int]] = {}
        for k, (u, v, uv) in enumerate(merges):
            if to[u] is None or to[v] is None or to[uv] is not None or not readable(to[u], v):
                continue  # no arc for a part, or the parts never meet: BPE can't make this token
            after, rank[uv], left[uv] = to[v], k, u
            to[uv], shared[uv], shared[v] = after, True, True
            if shared[u]:
                to[u], shared[u] = dict(to[u]), False
            to[u][v] = k
            children.setdefault(u, []).append(uv)
        # preorder over the left-part forest, children of late merges first
        pre, end = [-1] * size, [-1] * size
        n = 0
        for root in (i for i in range(size) if to[i] is not None and left[i] < 0):
            stack = [(root, False)]
            while stack:
                x, done = stack.pop()
                if done:
                    end[x] = n
                    continue
                pre[x], n = n, n + 1
                stack.append((x, True))
                stack.extend((c, False) for c in children.get(x, []))  # popped from the last, which has the highest rank
        self.reach = [s is not None for s in to]
        self.pre = pre
        ranks = {x: [rank[c] for c in cs] for x, cs in children.items()}
        made: dict[tuple, int] = {}
        of: dict[int, int] = {}
        #: The state that each label leads to, and each state's ranges of labels that it doesn't read.
        self.behind: list[int] = [-1] * size
        self.barred: list[tuple[list[int], list[int]]] = []
        for t, state in enumerate(to):
            if state is None:
                continue
            if id(state) in of:
                self.behind[t] = of[id(state)]
                continue
            ranges = []
            for x, k in state.items():
                at = bisect_left(ranks[x], k) if x in ranks else 0
                ranges.append((pre[x], end[children[x][at]] if x in ranks and at < len(ranks[x]) else pre[x] + 1))
            ranges.sort()
            flat: list[list[int]] = []
            for a, b in ranges:
                if flat and a <= flat[-1][1]:
                    flat[-1][1] = max(b, flat[-1][1])
                else:
                    flat.append([a, b])
            key = tuple(map(tuple, flat))
            if key not in made:
                made[key] = len(self.barred)
                self.barred.append(([a for a, _ in flat], [b for _, b in flat]))
            self.behind[t] = of[id(state)] = made[key]

    def reads(self, state: int, token: int) -> bool:
        """Whether a state has an arc ``token``."""
        starts, ends = self.barred[state]
        p = self.pre[token]
        i = bisect_right(starts, p) - 1
        return i < 0 or p >= ends[i]

    def _arc(self, state: int, byte: int) -> int:
        """The byte state behind an arc that hasn't been walked yet."""
        suffix, lasts, _ = self.facts[state >> 8]
        suffix += bytes((byte,))
        get, fits, heads = self.whole.get, self.fits, self.heads
        for k, before in enumerate(lasts):  # the one token that ends here and that the state before it can read
            if before != UNUSED:
                t = get(suffix[k:])
                if t is not None and (before == START or fits[before << 24 | t]):
                    break
        else:
            raise ValueError(f"the vocabulary has no byte {byte}")
        cut = 0
        while suffix[cut:] not in heads:
            cut += 1
        suffix = suffix[cut:]
        # a place from which no token can begin is of no more use
        fact = (suffix, (lasts[cut], *(x if x != UNUSED and suffix[n:] in heads else UNUSED for n, x in enumerate(lasts[cut + 1 :], 1)), self.behind[t]) if suffix else (self.behind[t],), t)
        to = self.states_of.get(fact)
        if to is None:
            to = self.states_of[fact] = len(self.last) << 8
            self.last.append(t)
            self.facts.append(fact)
        self.arcs[state | byte] = to
        return to

    def walk(self, word: bytes) -> list[int]:
        """The byte state behind each prefix of one pre-token."""
        if len(self.last) > MOST:
            self._forget()
        get, arc, state = self.arcs.get, self._arc, 0
        return [state := get(state | byte) or arc(state, byte) for byte in word]  # no arc leads to state 0

    def prefixes(self, word: bytes) -> list[int]:
        """Token count of each prefix of one pre-token, the empty one first."""
        count, last, lengths = [0], self.last, self.lengths
        for i, state in enumerate(self.walk(word), 1):
            count.append(count[i - lengths[last[state >> 8]]] + 1)
        return count

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the one path of the automaton whose labels spell it."""
        t = self.whole.get(word)
        if t is not None:
            return [t]
        states, last, lengths, i, out = self.walk(word), self.last, self.lengths, len(word), []
        while i:
            out.append(t := last[states[i - 1] >> 8])
            i -= lengths[t]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs in order; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Automaton:
    """Compile the automaton of a tokenizers JSON file; once in each Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return Automaton(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


def vocabulary(name: str) -> str:
    """Where the public vocabulary file ``name`` is; each worker asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Special:
    """The names of added special tokens, which stand for one token each."""

    def __init__(self, ids: dict[str, int]):
        self.names = sorted(ids, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.names)) + ")")

    def within(self, text: str) -> bool:
        return any(x in text for x in self.names)

    def split(self, text: str) -> list[str]:
        """Ordinary texts and names in turn; a text without names as a whole."""
        return self.cut.split(text) if self.names else [text]


class Memo(dict):
    """Results by chunk; emptied when it holds ``most`` entries, so a worker's memory stays bounded."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
