"""Byte-level BPE as a deterministic automaton, with a table-driven encoder.

Compilation starts from the one-state automaton that loops on all 256 bytes and
applies one merge gadget for each merge ``(a, b) -> c``, in order: the state
behind ``a`` loses its arc ``b``, and wherever ``a`` leaves a state, ``c`` now
leaves it too and leads to where ``b`` led. The state behind a token is thus a
version of the state behind the token's right part. Versions are kept by the
time (merge rank) up to which gadgets are applied, so the product of 50,000
gadgets stays linear in the merges; whether a state has an arc is read off those
versions and tabulated on first use.

The language of that automaton is exactly the correct tokenizations, and each
byte string has one. Reading bytes is made deterministic lazily: a state is the
longest suffix that begins some token plus the tokens before it and before its own
suffixes that begin tokens, and its transitions are tabulated when first taken. Encoding a word
is one table step a byte and one step back a token, for all new words of a batch at once.
Decoding emits arc labels.

``Encoder`` splits texts into words with array operations (the byte-level
pre-tokenizer's pattern), hashes them, and looks known words up in an open
hash table; only unseen words go through the automaton.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import chain

import numpy as np

START = -1
LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
#: Fixed values of the byte-level pre-tokenizer: its white space and its pattern's suffixes.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
SEPARATOR = "\U0010ffff"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Merges compiled by successive merge gadgets. Pairs of small numbers are keys
    of one integer, so that the tables stay small; ``MEMO`` bounds the tabulated part,
    to which a call of ``encode_words`` adds at most ``BYTES`` states before it is cut."""

    MEMO = 400_000
    SLOTS = 1 << 21
    BYTES = 1 << 18
    MIX = 0x9E3779B97F4A7C15 - (1 << 64)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        self.specials: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.removed: dict[int, int] = {}
        self.born: dict[int, int] = {vocab[s]: -1 for s in symbols}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self.arcs: dict[int, bool] = {}
        self._build_trie({self.labels[t]: t for t in self.born})
        self.labels |= {i: t.encode() for t, i in self.specials.items()}
        self.size = {t: len(x) for t, x in self.labels.items()}
        self.sizes = np.zeros(max(self.size) + 1, np.int64)
        self.sizes[list(self.size)] = list(self.size.values())
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[int, tuple[int, ...]]] = []
        self.table: dict[int, int] = {}  # steps of single long words; those of batches are in an open hash table
        self.steps = np.full(self.SLOTS, -1, np.int64)
        self.nexts = np.zeros(self.SLOTS, np.int32)
        self.n_steps = 0
        self.final = array("i")
        self._forget()

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        """Takes arc ``b`` from the state behind ``a`` and lays ``c`` beside ``a``."""
        self.removed[a << 32 | b] = rank
        self.parts[c] = (a, b)
        self.born[c] = rank

    def has_arc(self, state: int, arc: int) -> bool:
        """Whether, after all gadgets, ``arc`` leaves the state behind token ``state``."""
        key = state << 32 | arc
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > 4 * self.MEMO:
                self.arcs.clear()
            known = self.arcs[key] = self._arc_at(state, arc, len(self.parts) + 1)
        return known

    def _arc_at(self, state: int, arc: int, time: int) -> bool:
        while True:
            gone = self.removed.get(state << 32 | arc)
            if gone is not None and gone < time:
                return False
            ours, its = self.born[state], self.born[arc]
            if ours < 0 and its < 0:
                return True
            if its > ours:  # the arc was laid beside that of its left part
                left, right = self.parts[arc]
                if left == right == state:  # that gadget had taken the left part away here
                    return False
                arc, time = left, its
            elif ours > its:  # the state is a version of the one behind its right part
                state, time = self.parts[state][1], ours
            else:  # a token after itself
                left, right = self.parts[state]
                state, arc, time = right, left, ours

    def _build_trie(self, tokens: dict[bytes, int]) -> None:
        """Suffix links over the labels: which labels end at a byte."""
        child: dict[int, int] = {}  # node << 8 | byte
        ends, parent, depth = [START], [(0, 0)], [0]
        for label, token in tokens.items():
            at = 0
            for b in label:
                step = child.get(at << 8 | b)
                if step is None:
                    step = child[at << 8 | b] = len(ends)
                    ends.append(START)
                    parent.append((at, b))
                    depth.append(depth[at] + 1)
                at = step
            ends[at] = token
        link = [0] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            before, b = parent[node]
            if before:
                back = link[before]
                while back and back << 8 | b not in child:
                    back = link[back]
                link[node] = child.get(back << 8 | b, 0)
        self.child, self.ends, self.link, self.depth = child, ends, array("i", link), depth

    def _forget(self) -> None:
        for held in (self.ids, self.states, self.table):
            held.clear()
        del self.final[:]
        if self.n_steps:
            self.steps.fill(-1)
            self.n_steps = 0
        self._state(0, (START,))

    def _state(self, node: int, history: tuple[int, ...]) -> int:
        key = (node, history)
        known = self.ids.get(key)
        if known is None:
            known = self.ids[key] = len(self.states)
            self.states.append(key)
            self.final.append(history[-1])
        return known

    def _tabulate(self, state: int, byte: int) -> int:
        """The state after ``byte``: the longest suffix that begins a token, and for it and
        all shorter ones the token before them. The token that ends here is the longest
        whose arc leaves the state where it starts; it stands before the empty suffix."""
        node, history = self.states[state]
        child, link, ends, depth = self.child, self.link, self.ends, self.depth
        before, place = {}, node
        for token in history:
            before[depth[place]] = token
            place = link[place]
        at = child.get(node << 8 | byte, 0)
        while not at:  # every byte is a token, so the root has an arc for it
            node = link[node]
            at = child.get(node << 8 | byte, 0)
        now, place, last = [], at, START
        while place:
            token = before[depth[place] - 1]
            now.append(token)
            if last == START and ends[place] >= 0 and (token == START or self.has_arc(token, ends[place])):
                last = ends[place]
            place = link[place]
        now.append(last)
        return self._state(at, tuple(now))

    def _step(self, state: int, byte: int) -> int:
        if len(self.states) > self.MEMO:  # begin the table anew from this state
            node, history = self.states[state]
            self._forget()
            state = self._state(node, history)
        following = self.table[state << 8 | byte] = self._tabulate(state, byte)
        return following

    def _steps(self, wanted: np.ndarray) -> np.ndarray:
        """The states after steps (state << 8 | byte), of which new ones are tabulated."""
        mask = self.SLOTS - 1
        slot = (wanted * self.MIX >> 40) & mask
        held, found = self.steps[slot], self.nexts[slot]
        odd, new = np.flatnonzero(held != wanted), []
        while len(odd):
            free = self.steps[slot[odd]] < 0
            new.append(odd[free])
            odd = odd[~free]
            s = slot[odd] = (slot[odd] + 1) & mask
            found[odd] = self.nexts[s]
            odd = odd[self.steps[s] != wanted[odd]]
        if new:
            missing = np.concatenate(new)
            kinds, back = np.unique(wanted[missing], return_inverse=True)
            made = [self._tabulate(step >> 8, step & 255) for step in kinds.tolist()]
            for step, following, at in zip(kinds.tolist(), made, (kinds * self.MIX >> 40 & mask).tolist()):
                while self.steps[at] >= 0:
                    at = (at + 1) & mask
                self.steps[at], self.nexts[at] = step, following
            self.n_steps += len(made)
            found[missing] = np.array(made, np.int32)[back]
        return found

    def encode_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end in ``data``, each of 1 to ``BYTES`` bytes, and how many
        each word has. Words take a step at a time together, the longest first."""
        stops = np.cumsum(lengths)
        if len(data) > self.BYTES and len(lengths) > 1:
            cut = min(max(int(np.searchsorted(stops, self.BYTES)), 1), len(lengths) - 1)
            parts = [self.encode_words(data[: stops[cut - 1]], lengths[:cut]), self.encode_words(data[stops[cut - 1] :], lengths[cut:])]
            return tuple(map(np.concatenate, zip(*parts)))
        if len(self.states) > self.MEMO or self.n_steps > self.SLOTS // 2:
            self._forget()
        starts = stops - lengths
        order = np.argsort(-lengths, kind="stable")
        at, state = starts[order], np.zeros(len(lengths), np.int64)
        last = np.empty(len(data), np.int32)
        for active in (len(lengths) - np.cumsum(np.bincount(lengths))[:-1]).tolist():
            at = at[:active]
            state = self._steps(state[:active] << 8 | data[at]).astype(np.int64)
            last[at] = np.frombuffer(self.final, np.int32)[state]
            at = at + 1
        ends, first = np.zeros(len(data), bool), starts
        while len(stops):
            ends[stops - 1] = True
            stops = stops - self.sizes[last[stops - 1]]
            more = stops > first
            stops, first = stops[more], first[more]
        return last[ends], np.add.reduceat(ends, starts, dtype=np.int64)

    def encode_word(self, word: bytes) -> list[int]:
        """One table step a byte, one step back a token; words of any length."""
        if len(self.states) > self.MEMO:
            self._forget()
        known, final, state, last = self.table.get, self.final, 0, array("i")
        for b in word:
            state = known(state << 8 | b) or self._step(state, b)
            last.append(final[state])
        out, at, size = [], len(word), self.size
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        category = unicodedata.category
        found = np.fromiter((kinds.get(category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        found[WHITE] = SPACE
        found[ord(SEPARATOR)] = END
        _CLASSES = found
    return _CLASSES


def split_points(codes: np.ndarray) -> np.ndarray:
    """Where words start, over code points of texts that each end in SEPARATOR."""
    kind = classes()[codes]
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    wordy = (kind != SPACE) & (kind != END)
    space = kind == SPACE
    # the last blank before a word stands alone, or belongs to the word if it is U+0020
    start[:-1] |= space[:-1] & wordy[1:]
    start[1:] &= ~(wordy[1:] & (codes[:-1] == 0x20))
    start |= kind == END
    at = np.flatnonzero((codes == 0x27) & start)
    if len(at):
        for suffix in SUFFIXES:
            n = len(suffix)
            hit = at[at + n < len(codes)]
            for i, c in enumerate(suffix):
                hit = hit[codes[hit + 1 + i] == ord(c)]
            start[hit + 1] = False
            follow = hit + n + 1
            start[follow[follow < len(codes)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes texts in batches; memory is bounded by CHUNK, SLOTS and HELD ids.

    Known words are found by one 64-bit hash and confirmed by a second,
    independent one; a word that only shares the first is encoded by itself.
    """

    CHUNK = 200_000
    SLOTS = 1 << 21
    HELD = 1 << 22
    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    WIDE = 48  # longer words are not hashed

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        size = self.CHUNK * 2
        with np.errstate(over="ignore"):
            self.power = [np.cumprod(np.full(size, b, np.uint64)) for b in self.BASES]
            self.inverse = [np.cumprod(np.full(size, pow(b, -1, 1 << 64), np.uint64)) for b in self.BASES]
        self.special = re.compile("(" + "|".join(map(re.escape, self.automaton.specials)) + ")") if self.automaton.specials else None
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.slot_word = np.full(self.SLOTS, -1, np.int32)
        self.n_words = 0
        self.offsets = np.zeros(1 << 14, np.uint32)
        self.lengths = np.zeros(1 << 14, np.int32)
        self.checks = np.zeros(1 << 14, np.uint64)
        self.flat = np.zeros(1 << 16, np.uint16 if max(self.automaton.labels) < 65536 else np.uint32)
        self.used = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Numbers of new words, whose ids are held from now on."""
        first, total = self.n_words, len(ids)
        while first + len(sizes) > len(self.offsets):
            self.offsets, self.lengths, self.checks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offsets, self.lengths, self.checks))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        self.n_words += len(sizes)
        own = slice(first, self.n_words)
        self.offsets[own], self.lengths[own], self.checks[own] = self.used + np.cumsum(sizes) - sizes, sizes, checks
        self.used += total
        return np.arange(first, self.n_words)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 where unknown."""
        mask = self.SLOTS - 1
        slot = (hashes >> np.uint64(40)).astype(np.int64) & mask
        found = self.slot_word[slot]
        odd = np.flatnonzero((self.keys[slot] != hashes) & (found >= 0))
        while len(odd):
            s = (slot[odd] + 1) & mask
            slot[odd] = s
            found[odd] = self.slot_word[s]
            odd = odd[(self.keys[s] != hashes[odd]) & (found[odd] >= 0)]
        return found

    def _put(self, hashes: np.ndarray, words: np.ndarray) -> None:
        """Different hashes take the next free slots; where several want one, the last gets it."""
        slot = (hashes >> np.uint64(40)).astype(np.int64) & (self.SLOTS - 1)
        while len(slot):
            free = self.slot_word[slot] < 0
            self.slot_word[slot[free]] = words[free]
            own = self.slot_word[slot] == words
            self.keys[slot[own]] = hashes[own]
            hashes, words, slot = hashes[~own], words[~own], (slot[~own] + 1) & (self.SLOTS - 1)

    def _hashes(self, which: int, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.power[which][: len(codes)], out=total[1:])
        found = (total[ends] - total[starts]) * self.inverse[which][starts]
        return found ^ (found >> np.uint64(29)) + (ends - starts).astype(np.uint64)

    def _encoded(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = ends - starts
        stops = np.cumsum(n)
        own = codes[np.repeat(starts - (stops - n), n) + np.arange(stops[-1])]
        widths = 1 + (own > 0x7F) + (own > 0x7FF).astype(np.int64) + (own > 0xFFFF)
        data = np.frombuffer(own.tobytes().decode("utf-32-le").encode(), np.uint8)
        return self.automaton.encode_words(data, np.add.reduceat(widths, stops - n))

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens or SEPARATOR."""
        if self.n_words > self.SLOTS // 3 or self.used > self.HELD:
            self._reset()
        joined = SEPARATOR.join(texts) + SEPARATOR
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = split_points(codes)
        ends = np.append(starts[1:], len(codes))
        close = codes[starts] == ord(SEPARATOR)
        text_of = np.cumsum(close)[~close]
        starts, ends = starts[~close], ends[~close]
        hashed = ends - starts <= self.WIDE
        if len(codes) > len(self.power[0]):
            hashed[:] = False  # one very long text: no hashing beyond the tables
        word = np.full(len(starts), -1, np.int32)
        if hashed.any():
            hashes, checks = (self._hashes(which, codes, starts, ends) for which in range(2))
            word[hashed] = self._find(hashes[hashed])
            new = np.flatnonzero((word < 0) & hashed)
            if len(new):
                keys, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
                where = new[first]
                numbers = self._add(*self._encoded(codes, starts[where], ends[where]), checks[where])
                self._put(keys, numbers)
                word[new] = numbers[back]
            word[hashed & (self.checks[word] != checks)] = -1
        odd = np.flatnonzero(word < 0)
        if len(odd):
            alone = [joined[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist())]
            kinds = {w: i for i, w in enumerate(dict.fromkeys(alone))}
            ids = [self.automaton.encode_word(w.encode()) for w in kinds]
            numbers = self._add(np.fromiter(chain.from_iterable(ids), self.flat.dtype), np.fromiter(map(len, ids), np.int64), np.zeros(len(kinds), np.uint64))
            word[odd] = numbers[[kinds[w] for w in alone]]
        n = self.lengths[word].astype(np.int64)
        stop = np.cumsum(n)
        flat = self.flat[np.repeat(self.offsets[word].astype(np.int64) - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        per_text = np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)
        return np.split(flat, np.cumsum(per_text)[:-1])

    def _plain(self, text: str) -> np.ndarray:
        """One text of any length, cut where a word surely starts."""
        out, at = [], 0
        while len(text) - at > self.CHUNK:
            cut = re.compile(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])").search(text, at + self.CHUNK // 2, min(len(text), at + 2 * self.CHUNK - 8))
            if cut is None:
                break
            out += self._chunk([text[at : cut.start()]])
            at = cut.start()
        out += self._chunk([text[at:]])
        return np.concatenate(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                for i, ids in zip(held, self._chunk([texts[i] or "" for i in held])):
                    out[i] = ids
            held, size = [], 0

        for i, text in enumerate(texts):
            text = text or ""
            if SEPARATOR in text or self.special and self.special.search(text):
                out[i] = self._odd(text)
            elif len(text) > self.CHUNK:
                out[i] = self._plain(text)
            else:
                if size + len(text) > self.CHUNK:
                    flush()
                held.append(i)
                size += len(text) + 1
        flush()
        return out

    def _odd(self, text: str) -> np.ndarray:
        """Special tokens are found in the text first; SEPARATOR itself is an ordinary symbol."""
        kinds = self.flat.dtype
        found = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.automaton.specials:
                found.append(np.array([self.automaton.specials[part]], kinds))
            elif SEPARATOR in part:
                stand_in = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in part)
                swapped = part.replace(SEPARATOR, stand_in)
                codes = np.frombuffer((swapped + SEPARATOR).encode("utf-32-le"), np.uint32)
                points = split_points(codes).tolist()
                for a, b in zip(points, points[1:]):
                    found.append(np.array(self.automaton.encode_word(swapped[a:b].replace(stand_in, SEPARATOR).encode()), kinds))
            else:
                found.append(self._plain(part))
        return np.concatenate(found) if found else np.zeros(0, kinds)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process; ``common.lean`` lets it go when another operator's task begins."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
