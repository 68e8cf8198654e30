"""Find periodic runs of words and collapse them: maximal pairs from a bottom-up tree of common-prefix intervals."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mapwise.llm.words import slices, starts_of

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

Run = tuple[int, int, int]  # start, length, period


class Sorted:
    """Suffixes of several texts in order, refined by prefix doubling, with the longest common prefixes of neighbours.

    Only suffixes that share a prefix with another one of their text are refined further, so texts without repeats cost
    one sort of their words. Level k knows, for the suffixes that were still together then, the class of their first
    2**k words.
    """

    def __init__(self, numbers: np.ndarray, owner: np.ndarray, ends: np.ndarray, depth: int):
        """``numbers``: the words, text after text; ``owner``: the text of each; ``ends``: the end of each place's text;
        ``depth``: common prefixes that are shorter are of no use."""
        n = len(numbers)
        # A word of one text never equals one of another.
        key = owner * (int(numbers.max(initial=0)) + 1) + numbers
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        order, first = self._classes(key)
        rank = np.empty(n, np.int64)
        rank[order] = first
        open_places = self._open(order, first)
        while len(open_places):
            width = 1 << len(self.levels)
            places = np.sort(open_places)
            self.levels.append((places, rank[places]))
            behind = open_places + width
            second = np.where(behind < ends[open_places], rank[np.minimum(behind, n - 1)], -1)
            order, first = self._classes(rank[open_places] * (n + 1) + second + 1)
            # Old classes lie together, so a new class begins as far into its old one as the sorted places tell.
            old = rank[open_places][order]
            begins = np.flatnonzero(np.diff(old, prepend=-1))
            old_first = np.repeat(begins, np.diff(np.append(begins, len(old))))
            rank[open_places[order]] = old + first - old_first
            open_places = self._open(open_places[order], first)
        shared = next((p for k, (p, _) in reversed(list(enumerate(self.levels))) if 1 << k <= depth), np.zeros(0, np.int64))
        self.places = shared[np.argsort(rank[shared], kind="stable")]
        self.common = self._common(self.places)

    @staticmethod
    def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the keys and, in that order, where each one's run of equals begins."""
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        return order, np.repeat(begins, np.diff(np.append(begins, len(key))))

    @staticmethod
    def _open(places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The places whose class holds another one."""
        together = np.zeros(len(first), bool)
        same = first[1:] == first[:-1]
        together[1:] |= same
        together[:-1] |= same
        return places[together]

    def _common(self, places: np.ndarray) -> np.ndarray:
        """Words that each suffix shares with the one before; 0 for the first."""
        a, b = places[:-1].copy(), places[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            held, rank = self.levels[k]
            i, j = (np.minimum(np.searchsorted(held, x), len(held) - 1) for x in (a, b))
            equal = (held[i] == a) & (held[j] == b) & (rank[i] == rank[j])
            for x in (a, b, common):
                x[equal] += 1 << k
        return np.concatenate([[0], common]) if len(places) else common


class Places:
    """Sorted places of an interval's suffixes, and the heads: those whose predecessor has another left word.

    The heads part the places into lists of one left word each, so a search skips all of one list at once.
    """

    def __init__(self, place: int):
        self.places, self.heads = [place], [place]

    def add(self, place: int, left: np.ndarray) -> None:
        places, heads = self.places, self.heads
        i = bisect_left(places, place)
        before = left[places[i - 1]] if i else None
        if i < len(places):
            after = places[i]
            was, now = before is None or before != left[after], left[place] != left[after]
            if now and not was:
                insort(heads, after)
            elif was and not now:
                del heads[bisect_left(heads, after)]
        if before is None or before != left[place]:
            insort(heads, place)
        places.insert(i, place)

    def others(self, place: int, reach: int, left: np.ndarray) -> Iterator[int]:
        """The places within ``reach`` whose left word is not that of ``place``."""
        places, heads, own = self.places, self.heads, left[place]
        middle = bisect_left(places, place)
        i = middle - 1
        while i >= 0 and places[i] >= place - reach:
            if left[places[i]] == own:
                i = bisect_left(places, heads[bisect_right(heads, places[i]) - 1]) - 1
            else:
                yield places[i]
                i -= 1
        i = middle
        while i < len(places) and places[i] <= place + reach:
            if left[places[i]] == own:
                head = bisect_right(heads, places[i])
                i = bisect_left(places, heads[head]) if head < len(heads) else len(places)
            else:
                yield places[i]
                i += 1


def maximal_pairs(
    places: list[int], common: list[int], left: np.ndarray, periods: int
) -> Iterator[tuple[int, int, int]]:
    """(first place, second place, words in common) of the maximal pairs whose distance fits ``periods`` times.

    ``places`` are suffixes in order, ``common[i]`` the words that suffix i shares with the one before (the first is not
    read). The intervals of the tree are closed from the deepest on. Where a child joins its parent, the smaller of the
    two sets searches the larger one, so a pair meets at the interval of its longest common prefix and can not be
    extended to the right; sets skip the places of equal left words, so it can not be extended to the left.
    """
    waiting: list[tuple[int, Places]] = []

    def joined(one: Places, other: Places, depth: int) -> Generator[tuple[int, int, int], None, Places]:
        large, small = (one, other) if len(one.places) >= len(other.places) else (other, one)
        for x in small.places:
            for y in large.others(x, depth // (periods - 1), left):
                yield min(x, y), max(x, y), depth
        for x in small.places:
            large.add(x, left)
        return large

    current = Places(places[0])
    for place, depth in zip([*places[1:], -1], [*common[1:], 0], strict=True):
        while waiting and waiting[-1][0] > depth:
            below, parent = waiting.pop()
            current = yield from joined(parent, current, below)
        if place < 0:
            break
        if waiting and waiting[-1][0] == depth:
            waiting[-1] = depth, (yield from joined(waiting[-1][1], current, depth))
        else:
            waiting.append((depth, current))
        current = Places(place)


def find_runs(
    numbers: np.ndarray, counts: np.ndarray, least_words: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> dict[int, list[Run]]:
    """The runs of each text that has any: by text, sorted by start and period.

    ``numbers`` are the words' numbers, text after text, ``counts`` the words of each text. A maximal pair at distance q
    with l words in common spans a stretch of q + l words of period q that no neighbour extends; with l at least
    ``periods - 1`` times q it is a run or a stretch whose smallest period divides q, which the same stretch's pair at
    the smallest distance then gives.
    """
    n = len(numbers)
    depth = min(max((periods - 1) * q, least_words - q) for q in range(1, least_words + 1))
    if not n:
        return {}
    begins = starts_of(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    suffixes = Sorted(numbers, owner, (begins + counts)[owner], depth)
    left = np.concatenate([[-1], numbers[:-1]])
    left[begins[counts > 0]] = -1  # one place a text, so it equals no other of its text
    # Intervals deep enough; those whose places all lie too far apart hold no run.
    inside = suffixes.common >= depth
    heads = np.flatnonzero(~inside)
    sizes = np.diff(np.append(heads, len(inside)))
    if not len(heads) or sizes.max() < 2:
        return {}
    group = np.repeat(np.arange(len(heads)), sizes)
    by_place = np.sort(group * n + suffixes.places)
    gaps = np.where(np.diff(by_place // n, prepend=-1) == 0, np.diff(by_place, prepend=0), n)
    near = np.minimum.reduceat(gaps, heads)
    deepest = np.maximum.reduceat(np.where(inside, suffixes.common, 0), heads)
    found: dict[tuple[int, int], int] = {}
    for g in np.flatnonzero((sizes >= 2) & (near * (periods - 1) <= deepest)).tolist():
        part = slice(heads[g], heads[g] + sizes[g])
        for i, j, common in maximal_pairs(suffixes.places[part].tolist(), suffixes.common[part].tolist(), left, periods):
            period, length = j - i, j - i + common
            if length >= least_words and period < found.get((i, length), n):
                found[i, length] = period
    out: dict[int, list[Run]] = defaultdict(list)
    for (start, length), period in found.items():
        text = int(owner[start])
        out[text].append((start - int(begins[text]), length, period))
    return {text: sorted(runs, key=lambda r: (r[0], r[2])) for text, runs in out.items()}


def greatest(runs: list[Run]) -> Run:
    """The run with the most periods, compared exactly; of equals the one with the smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    kept, at = [], 0
    for first, last in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[at:first]
        at = max(at, last)
    return kept + words[at:]


def periodic_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) for one document in ten: its words from a on are to repeat the p words at a. None for all others.

    Both follow from the crc32 of the decimal id; a null id changes nothing.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def collapse_runs(
    docs: DataFrame, least_words: int = LEAST_WORDS, periods: int = LEAST_PERIODS,
    tail: Callable[[int | None, int], tuple[int, int] | None] | None = None, with_text: bool = False,
) -> DataFrame:
    """The periodic runs of every whole text, a row per document: (doc_id, n_words, n_runs, start, length, period,
    exponent_milli, runs_sha256, collapsed_sha256 [, runs, collapsed]).

    A run is a stretch of at least ``least_words`` words with smallest period q and at least ``periods`` times q words that
    no neighbouring word extends. ``start`` to ``exponent_milli`` are those of the run with the greatest length to period
    (null without runs); ``runs`` lists all by start and period, their digest being over a line ``start,length,period``
    each. ``collapsed`` is the text without the words that a run holds behind its first period, joined by one space.
    ``tail`` may give (a, p) by id and number of words: the words from a on then repeat the p words at a.

    Each text is a matter of its own task, so nothing is shuffled and a lost task is run again alone. A task sorts the
    suffixes of a slice of about 3 MB, or of one longer text, by prefix doubling (n log n); pairs are enumerated per
    interval of common prefixes, in all no more than the runs' periods add up to, which is in proportion to n. Words are
    compared exactly, by numbers given in turn. Null and empty texts have no words and no runs. Repeated rows and null ids
    each give their row; an empty table gives none. Only ``doc_id`` and ``text`` are read, so other columns may have any
    name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(1), 3_000_000):
                ids = batch.column(0).slice(begin, len(texts))
                known: dict[bytes, int] = {}
                words, parts = [], []
                for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                    own = text.split()
                    number = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own))
                    change = tail(doc_id, len(own)) if tail else None
                    if change:
                        a, p = change
                        place = np.arange(len(own))
                        place[a:] = a + (place[a:] - a) % p
                        number, own = number[place], [own[i] for i in place.tolist()]
                    words.append(own)
                    parts.append(number)
                counts = np.array([len(w) for w in words], np.int64)
                found = find_runs(np.concatenate(parts), counts, least_words, periods)
                rows = []
                for i, own in enumerate(words):
                    runs = found.get(i, [])
                    start, length, period = greatest(runs) if runs else (None, None, None)
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    kept = b" ".join(kept_words(own, runs) if runs else own)
                    row = (len(own), len(runs), start, length, period, 1000 * length // period if runs else None,
                           hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                    if with_text:
                        row += ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept.decode())
                    rows.append(row)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])

    names = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = [pa.int64()] * 6 + [pa.string()] * 2
    kinds = "doc_id long, " + ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, types, strict=True))
    if with_text:
        names += ["runs", "collapsed"]
        types += [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
        kinds += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


#: The runs in SQL: pairs of equal words at each distance, consecutive ones as islands; the digest of the crc32's byte table.
RUNS_SQL = r"""
with bits as (
  select b, list_reduce(list_prepend(cast(b as bigint), range(8)),
           lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as v
  from range(256) r(b)),
crc_table as (select list(v order by b) as entries from bits),
own as (
  select row_number() over () as row_no, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
         xor(4294967295::bigint, list_reduce(
           list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''),
             lambda x: cast(ascii(x) as bigint))),
           lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) as h
  from documents, crc_table),
shape as (
  select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from own),
shaped as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from shape),
texts as (
  select row_no, doc_id, n, case when a is null then w else list_transform(range(0, n),
           lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) end as w
  from shaped),
places as (select row_no, n, unnest(range(0, n)) as i, unnest(w) as word from texts),
equal as (
  select x.row_no, y.i - x.i as q, x.i
  from places x join places y on x.row_no = y.row_no and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (
  select row_no, q, i - row_number() over (partition by row_no, q order by i) as island, i from equal),
stretches as (
  select row_no, q, min(i) as start, count(*) + q as length from islands group by row_no, q, island
  having count(*) >= 3 * q and count(*) + q >= 6),
runs as (select row_no, start, length, min(q) as period from stretches group by row_no, start, length),
listed as (
  select row_no, count(*) as n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
         arg_min((start, length, period), (-(length::double / period), start, period)) as best
  from runs group by row_no),
dropped as (
  select distinct row_no, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select p.row_no, string_agg(word, ' ' order by p.i) as words
  from places p left join dropped d on p.row_no = d.row_no and p.i = d.i where d.i is null group by p.row_no)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best[1]::bigint as start, best[2]::bigint as length,
       best[3]::bigint as period, (1000 * best[2] // best[3])::bigint as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from texts left join listed using (row_no) left join kept using (row_no)
"""
