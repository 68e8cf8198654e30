"""Count tokens with a tokenizer compiled to finite-state transducers.

Two deterministic transducers replace the byte-level BPE tokenizer. The *splitter* reads a text's characters and marks
where a piece of the split pattern begins; it has few states, so chunks of a text run from all states at once and their
state maps compose by a prefix scan. The *counter* reads a piece's bytes and adds up the token counts that its transitions
carry; its states are made when first met and kept in a bounded table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mapwise.llm.words import slices

#: Tokens that a document may have before it is over the limit.
LIMIT = 512
#: Characters of a chunk; the chunks of a slice run side by side.
CHUNK = 512
#: Slots of a worker's transition table (8 bytes each); at half of them the table is emptied and made anew.
SLOTS = 1 << 22
#: Pieces that still run when the rest of each is read alone.
FEW = 24

#: Kinds of characters as the split pattern tells them apart.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)


# ---- the splitter ------------------------------------------------------------------------------------------------

#: States: at a start or behind a finished piece; in letters, numbers, others, white space; behind one space that the next
#: character may join; one or two characters before the end of a contraction.
DONE, LETTERS, NUMBERS, OTHERS, WHITES, BLANK, LAST_ONE, LAST_TWO = range(8)
#: Symbols: kinds, with what the pattern looks ahead for folded in. An apostrophe may begin a contraction of two or three
#: characters; white space ends its run or not, as a character that is no white space follows.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE_END, S_SPACE, S_WHITE_END, S_WHITE, S_BREAK = range(10)


def _splitter() -> np.ndarray:
    """``table[state, symbol]``: the next state, plus 8 where a piece begins.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space but its last before another|white space.
    """
    table = np.zeros((8, 10), np.uint8)
    for state in range(8):
        for symbol in range(10):
            starts, into = True, DONE
            if symbol in (S_LETTER, S_NUMBER, S_OTHER):
                into = (LETTERS, NUMBERS, OTHERS)[symbol]
                starts = state not in (into, BLANK)
                if state == LAST_TWO:
                    into, starts = LAST_ONE, False
                elif state == LAST_ONE:
                    into, starts = DONE, False
            elif symbol in (S_SHORT, S_LONG):
                # Inside a run of others, or behind a space, the apostrophe is one of the others.
                inside = state in (OTHERS, BLANK)
                into = OTHERS if inside else LAST_ONE if symbol == S_SHORT else LAST_TWO
                starts = not inside
            elif symbol == S_SPACE_END:
                into = BLANK
            elif symbol in (S_SPACE, S_WHITE):
                into, starts = WHITES, state != WHITES
            elif symbol == S_BREAK:
                starts = False
            table[state, symbol] = into + 8 * starts
    return table


SPLITTER = _splitter()


def symbols(kinds: np.ndarray, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The splitter's symbol of each character. ``breaks`` marks the characters that only part two texts."""

    def after(found: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([found[n:], np.zeros(min(n, len(found)), bool)])

    def one_of(letters: str) -> np.ndarray:
        return np.isin(points, [ord(c) for c in letters])

    white = (kinds == SPACE) | (kinds == WHITE)
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE], np.uint8)[kinds]
    symbol[white & after(~white & ~breaks, 1)] -= 1
    apostrophe = np.flatnonzero(points == ord("'"))
    if len(apostrophe):
        is_l, is_e, r_or_v = one_of("l"), one_of("e"), one_of("rv")
        long = (after(r_or_v, 1) & after(is_e, 2)) | (after(is_l, 1) & after(is_l, 2))
        symbol[apostrophe[long[apostrophe]]] = S_LONG
        symbol[apostrophe[after(one_of("stmd"), 1)[apostrophe]]] = S_SHORT
    symbol[breaks] = S_BREAK
    return symbol


def scanned(maps: np.ndarray) -> np.ndarray:
    """The state in which each chunk begins: chunk maps (chunk x state) composed by a doubling prefix scan, from DONE."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        # The map of the chunks up to here: first that of the chunks before, then its own.
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.concatenate([[DONE], maps[:-1, DONE]]).astype(np.uint8)


def piece_starts(symbol: np.ndarray, chunk: int | None = None) -> np.ndarray:
    """Where the pieces begin, as one mark per character.

    All chunks advance side by side, one character of each at a time: first every state of each chunk, for its map, then
    from the state that the scan gives.
    """
    n = len(symbol)
    chunk = max(1, min(chunk or CHUNK, n))
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, S_BREAK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    flat = SPLITTER.ravel()
    if lanes > 1:
        maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (lanes, 8)).copy()
        for column in columns:
            maps = flat[(maps & np.uint8(7)) * np.uint8(10) + column[:, None]]
        state = scanned(maps & np.uint8(7))
    else:
        state = np.full(1, DONE, np.uint8)
    marks = np.empty((chunk, lanes), bool)
    for k, column in enumerate(columns):
        out = flat[state * np.uint8(10) + column]
        marks[k] = out >= 8
        state = out & np.uint8(7)
    return marks.T.ravel()[:n]


# ---- the counter -------------------------------------------------------------------------------------------------


def byte_marks() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in
    turn from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """The transducer that counts the tokens of a piece, its states made as they are met.

    For every prefix of a piece, the tokens of the prefix are those of a shorter prefix and one more token, and which one
    follows from the tokens that end there: a token may stand behind another only if the two, merged from their bytes,
    come out as these two. A state therefore holds, for each earlier place from which a token could still begin: the node
    of the vocabulary's trie that the bytes since have reached, the last token up to that place (-1: none), and how many
    more tokens the prefix has than the piece had there. Pieces that reach the same state have the same future, so the
    counts on the transitions are exact.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        marks = byte_marks()
        self.tokens = [b""] * (max(model["vocab"].values()) + 1)
        for text, number in model["vocab"].items():
            if all(c in marks for c in text):
                self.tokens[number] = bytes(marks[c] for c in text)
        number = model["vocab"]
        #: (left, right): the rank of their merge, and the two parts of each merged token with that rank.
        self.ranks: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[number[left], number[right]] = rank
            parts[number[left + right]] = (number[left], number[right], rank)
        self.parts = parts
        self.edges: tuple[dict, dict] = ({}, {})
        #: The vocabulary's trie: (node, byte) to node, the token that ends at a node (-1: none), whether it goes on.
        self.children: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], bytearray(1)
        for i, token in enumerate(self.tokens):
            if not token or (len(token) > 1 and i not in parts):
                continue
            node = 0
            for byte in token:
                self.goes_on[node] = 1
                node = self.children.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.goes_on.append(0)
            self.token_at[node] = i
        self.slots, self.shift = slots, 64 - (slots.bit_length() - 1)
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first."""
        self.table = np.zeros(self.slots, np.uint64)
        self.used = 0
        self.numbers: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = [()]
        self.fitting: dict[int, bool] = {}
        #: State 0 is none, so that a free slot of the table equals no transition.
        self.first = self.number_of((0, -1, 0))

    def full(self) -> bool:
        return self.used > self.slots // 2 or len(self.states) > self.slots // 8

    def number_of(self, held: tuple[int, ...]) -> int:
        number = self.numbers.setdefault(held, len(self.states))
        if number == len(self.states):
            self.states.append(held)
        return number

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of ``token`` while it is merged, from its outermost byte on, and the rank of the merge
        that takes each of them up."""
        known = self.edges[side].get(token)
        if known is None:
            own = self.parts.get(token)
            known = [(token, float("inf"))]
            if own:
                inner = self.edge(own[side], side)
                known = [*inner[:-1], (own[side], own[2]), *known]
            self.edges[side][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand behind ``left``: no merge across the two comes before those that make them.

        Merges go by rank, and a merge needs its two parts, made by lower ranks; so while both sides grow, each pair that
        meets at the border stands until the lower of the two ranks that take it up. Of equal ranks the leftmost is first.
        """
        if left < 0:
            return True
        key = left << 32 | right
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) > self.slots // 8:
                self.fitting.clear()
            lefts, rights, i, j, known = self.edge(left, 1), self.edge(right, 0), 0, 0, True
            while known:
                (a, until_a), (b, until_b) = lefts[i], rights[j]
                rank = self.ranks.get((a, b))
                known = rank is None or rank >= until_a or rank > until_b
                if i == len(lefts) - 1 and j == len(rights) - 1:
                    break
                if until_a <= until_b:
                    i += 1
                else:
                    j += 1
            self.fitting[key] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The state behind ``byte`` and the tokens that the transition adds (less than 0 where tokens merge)."""
        held = self.states[state]
        children, token_at, goes_on = self.children, self.token_at, self.goes_on
        live, found, more = [], -1, 0
        for i in range(0, len(held), 3):
            node = children.get(held[i] << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if found < 0 and token >= 0 and self.fits(held[i + 1], token):
                found, more = token, 1 - held[i + 2]
            if goes_on[node]:
                live += node, held[i + 1], held[i + 2]
        # Counts of the places are held against the new prefix; the new prefix is a place itself.
        for i in range(2, len(live), 3):
            live[i] += more
        return self.number_of((*live, 0, found, 0)), more

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> self.shift

    def make(self, key: int) -> int:
        """The transition of ``key`` (state << 8 | byte), made and entered in the table: (state << 8 | added + 128)."""
        slot, table = self._slot(key), self.table
        while True:
            entry = int(table[slot])
            if not entry:
                break
            if entry >> 32 == key:
                return entry & 0xFFFFFFFF
            slot = (slot + 1) & (self.slots - 1)
        state, more = self.step(key >> 8, key & 255)
        value = state << 8 | (more + 128)
        table[slot] = key << 32 | value
        self.used += 1
        return value

    def counts(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of the pieces ``buffer[start : start + length]``.

        Pieces are read in blocks that cannot fill the table: a block of several pieces makes no more transitions than it
        has bytes.
        """
        block = np.cumsum(lengths) // (self.slots // 4)
        cuts = np.flatnonzero(np.diff(block)) + 1
        parts = [self._block(buffer, *x) for x in zip(np.split(starts, cuts), np.split(lengths, cuts), strict=True)]
        return np.concatenate(parts)

    def _block(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of the pieces of one block, all read side by side, one byte of each at a time."""
        if self.full():
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.full(len(order), self.first, np.uint64), np.zeros(len(order), np.int64)
        multiplier, mask = np.uint64(0x9E3779B97F4A7C15), np.uint64(self.slots - 1)
        # How many pieces are longer than k, for each k.
        longest = int(lengths[0]) if len(lengths) else 0
        alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), "right")
        k = 0
        while k < longest and alive[k] >= FEW:
            n = int(alive[k])
            key = state[:n] << np.uint64(8) | buffer[starts[:n] + k]
            slot = key * multiplier >> np.uint64(self.shift)
            entry = self.table[slot]
            missed = np.flatnonzero(entry >> np.uint64(32) != key)
            while len(missed):
                # An occupied slot sends the search on; a free one means that the transition was never met.
                other = entry[missed]
                new = np.flatnonzero(other == 0)
                if len(new):
                    keys, back = np.unique(key[missed[new]], return_inverse=True)
                    values = np.array([self.make(x) for x in keys.tolist()], np.uint64)
                    entry[missed[new]] = keys[back] << np.uint64(32) | values[back]
                    missed = missed[other != 0]
                slot[missed] = (slot[missed] + np.uint64(1)) & mask
                entry[missed] = self.table[slot[missed]]
                missed = missed[entry[missed] >> np.uint64(32) != key[missed]]
            state[:n] = entry >> np.uint64(8) & np.uint64(0xFFFFFF)
            total[:n] += (entry & np.uint64(0xFF)).astype(np.int64) - 128
            k += 1
        # The few pieces left are read alone, as far as they go; a full table is made anew under way.
        rest = [(i, self.states[int(state[i])]) for i in range(int(alive[k]) if k < longest else 0)]
        for i, held in rest:
            now, added = self.number_of(held), 0
            for byte in buffer[starts[i] + k : starts[i] + lengths[i]].tobytes():
                if self.full():
                    held = self.states[now]
                    self.clear()
                    now = self.number_of(held)
                value = self.make(now << 8 | byte)
                now, added = value >> 8, added + (value & 255) - 128
            total[i] += added
        back = np.empty(len(order), np.int64)
        back[order] = total
        return back


# ---- the whole ---------------------------------------------------------------------------------------------------


@cache
def kind_runs(path: str) -> tuple[tuple[int, int], ...]:
    """(first code point, kind) of each run of code points of one kind, asked of the tokenizer's own splitter.

    All code points in order are one text, whose pieces hold one kind each. Which kind tells the first character of the
    piece: whether it joins a letter, a number or white space in front of it.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def begins(text: str) -> np.ndarray:
        return np.array([first for _, (first, _) in split(text)])

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    firsts = []
    for at in range(0, len(points), 4096):
        some = points[at : at + 4096]
        firsts += [some[i] for i in begins("".join(map(chr, some))).tolist()]
    # A space leads a piece of the kind behind it, so the character behind it is asked as well.
    firsts = np.array(sorted({*firsts, ord(" "), ord(" ") + 1, 0xD800}))
    kinds = np.full(len(firsts), OTHER, np.uint8)
    for lead, tail, kind in (("a", "\n\n", LETTER), ("1", "\n\n", NUMBER), ("\n", "\n#", WHITE)):
        for at in range(0, len(firsts), 500):
            some = [c if not 0xD800 <= c < 0xE000 else ord("#") for c in firsts[at : at + 500].tolist()]
            found = begins("".join(f"{lead}{chr(c)}{tail}" for c in some))
            kinds[at : at + 500][~np.isin(np.arange(len(some)) * 4 + 1, found)] = kind
    kinds[firsts == ord(" ")] = SPACE
    return tuple(zip(firsts.tolist(), kinds.tolist(), strict=True))


class CountedTexts:
    """Both transducers of a tokenizer file, as one Python worker keeps them."""

    def __init__(self, path: str, runs: tuple[tuple[int, int], ...], special: tuple[bytes, ...]):
        self.counter, self.special = Counter(path), special
        firsts = np.array([r[0] for r in runs] + [0x110000])
        # The last code point, beyond Unicode, parts texts.
        self.kinds = np.append(np.repeat(np.array([r[1] for r in runs], np.uint8), np.diff(firsts)), np.uint8(OTHER))

    def of(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text."""
        parts, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = [text]
            for mark in self.special:
                found = [x for part in found for x in part.split(mark)]
            total[i] = len(found) - 1
            parts += found
            owner += [i] * len(found)
        strings = [p.decode("utf-8", "replace") for p in parts]
        text = "\0".join([*strings, ""])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum([len(x) + 1 for x in strings]) - 1
        breaks = np.zeros(len(points), bool)
        breaks[ends] = True
        marks = piece_starts(symbols(self.kinds[points], points, breaks))
        begins = np.flatnonzero(marks | breaks)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        starts, lengths = offsets[begins], np.diff(offsets[np.append(begins, len(points))])
        pieces = np.flatnonzero(~breaks[begins])
        buffer = np.frombuffer(text.encode(), np.uint8)
        counts = self.counter.counts(buffer, starts[pieces], lengths[pieces])
        place = np.array(owner)[np.searchsorted(ends, begins[pieces], "left")]
        return total + np.bincount(place, counts, len(texts)).astype(np.int64)


@cache
def worker_counts(path: str, runs: tuple[tuple[int, int], ...], special: tuple[bytes, ...]) -> CountedTexts:
    """The transducers of this Python worker, over all its tasks."""
    return CountedTexts(path, runs, special)


def special_strings(path: str) -> tuple[bytes, ...]:
    """The strings that the tokenizer takes as one token wherever they stand in a text."""
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"].encode() for t in json.load(file).get("added_tokens", []))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, as the tokenizer's file would encode it.

    ``tokenizer`` is the path of a byte-level BPE file that every executor has. Its special strings count one token each
    and part the text around them. ``n_bytes`` is the length in UTF-8. Documents stay in their tasks: no shuffle, and a
    lost task is counted anew alone. A slice of a few MB, or one very long text, is in memory at a time, and the counter
    keeps at most half of ``SLOTS`` transitions. Null and empty texts have 0 bytes and tokens; repeated rows and null
    ids each give their row; an empty table gives none. Other columns are not read, so they may have any name.
    """
    runs, special = kind_runs(tokenizer), special_strings(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = worker_counts(tokenizer, runs, special)
        for batch in batches:
            for begin, texts in slices(batch.column(1), 2_000_000):
                n_bytes = np.array([len(t) for t in texts], np.int64)
                n_tokens = counted.of(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(n_bytes), pa.array(n_tokens),
                     pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
