"""Evaluation passages inside a corpus, by Wu-Manber multi-pattern search."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tickloom.llm.pages import without_headers

LARGEST_SET = 8_000_000  # characters of passages in one broadcast; a larger evaluation set makes several, all searched in one pass
HELD_TEXT = 8_000_000  # characters of documents held taken apart while several blocks go by

# Invisible characters, ways of blacking out, and characters written in more than one form.
INVISIBLE = re.compile("­\\s*|[​-‏⁠﻿ـ︀-️]")
BLACKED = re.compile(r"█+|\[(?:redacted|…|\.\.\.)\]|\*{2,}|■+|_{3,}")
FORMS = {"𠮷": "吉", "髙": "高", "﨑": "崎", "嵜": "崎", "濵": "浜", "濱": "浜", "邊": "辺", "邉": "辺", "澤": "沢", "齋": "斎", "ё": "е", "ı": "i", "ß": "ss", "’": "'"}
IN_FORMS = re.compile("[" + "".join(FORMS) + "]")
# one number, or one elided or possessive form, is one word
WORD = re.compile(r"█|\d+(?:[.,]\d+)*[^\W_]*|[^\W_]+(?:'[^\W_]+|[ऀ-෿฀-໿ً-ْ]+[^\W_]*)*")
CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")


@dataclass(frozen=True)
class Search:
    """Sizes of the search in units (words, or characters for texts in Chinese and Japanese)."""

    least: int  # shortest stretch that counts
    pattern: int  # length of an exact run that any such stretch must hold
    block: int = 2  # units hashed together
    per: int = 10  # one altered unit in so many is allowed


WORDS, CHARS = Search(20, 5), Search(40, 8)


def normalise(text: str) -> str:
    """Letters and digits in one form: headers, invisible characters, case and variants put away."""
    t = INVISIBLE.sub("", without_headers(text.replace("\r\n", "\n"), fill=False))
    if t.isascii():
        return BLACKED.sub(" █ ", t.lower())
    t = BLACKED.sub(" █ ", unicodedata.normalize("NFKC", t.replace("[…]", "█")).lower())
    return IN_FORMS.sub(lambda m: FORMS[m.group()], t)


def spellings(word: str) -> list[str]:
    """The ways punctuation within a word may be written, as written first."""
    bare = re.sub(r"[.,']", "", word)
    return list(dict.fromkeys([word, bare, word.replace(".", ","), word.replace(",", "."), word.translate({44: 46, 46: 44})]))


def units(normal: str, chars: bool) -> list[str]:
    return [c for c in normal if c.isalnum() or c == "█"] if chars else WORD.findall(normal)


def by_characters(text: str) -> bool:
    letters = sum(c.isalnum() for c in text)
    return letters > 0 and len(CJK.findall(text)) * 2 > letters


class PatternSet:
    """All runs of ``pattern`` units of the passages, ready for the search: plain arrays, built once and broadcast."""

    def __init__(self, passages: list[tuple[int, list[str]]], search: Search) -> None:
        self.search, self.ids, self.names = search, {"": 0}, [name for name, _ in passages]
        self.last = 0
        self.items = [np.fromiter((self._id(x) for x in u), np.int64, len(u)) for _, u in passages]
        self.size = self.last + 1
        m, b = search.pattern, search.block
        self.reach = m - b + 1  # the largest shift
        long_ = [k for k, it in enumerate(self.items) if len(it) >= m]
        empty = np.zeros(0, np.int64)
        # the last block of some run has shift 0; only blocks nearer to a passage's start than a run are farther from an end
        hashes = np.concatenate([empty, *[self._blocks_of(self.items[k]) for k in long_]])
        shifts = np.concatenate([empty, *[np.maximum(m - b - np.arange(len(self.items[k]) - b + 1), 0) for k in long_]])
        order = np.lexsort((shifts, hashes))
        first = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0])) if len(order) else empty
        self.blocks, self.shifts = hashes[order][first], shifts[order][first]
        runs = np.concatenate([empty, *[self._runs_of(self.items[k], np.arange(len(self.items[k]) - m + 1)) for k in long_]])
        item = np.concatenate([empty, *[np.full(len(self.items[k]) - m + 1, k) for k in long_]])
        place = np.concatenate([empty, *[np.arange(len(self.items[k]) - m + 1) for k in long_]])
        order = np.lexsort((place, item, runs))
        self.runs, start = np.unique(runs[order], return_index=True)
        self.bucket = np.append(start, len(runs))  # suffix-hash buckets: runs[i] stands at places bucket[i] to bucket[i + 1]
        self.item, self.place = item[order], place[order]

    def _id(self, unit: str) -> int:
        if unit in self.ids:
            return self.ids[unit]
        ways = spellings(unit)
        number = next((self.ids[w] for w in ways if w in self.ids), None)
        if number is None:
            self.last += 1
            number = self.last
        for w in ways:
            self.ids.setdefault(w, number)
        return number

    def _blocks_of(self, x: np.ndarray) -> np.ndarray:
        b, n = self.search.block, len(x)
        h = x[: n - b + 1].copy()
        for k in range(1, b):
            h = h * self.size + x[k : n - b + 1 + k]
        return h

    def _runs_of(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        run = np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.search.pattern):
                run = run * np.uint64(0x100000001B3) + x[starts + k].astype(np.uint64) + np.uint64(1)
        return run.view(np.int64)

    def code(self, u: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, u, repeat(0)), np.int64, len(u))

    def occurrences(self, x: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, place in the item, place in x) of every exact run."""
        m, b, n = self.search.pattern, self.search.block, len(x)
        if n < m or not len(self.runs):
            return
        h = self._blocks_of(x)
        # shift table: every run of m units covers a probe, so windows around probes of full shift are skipped
        probes = np.arange(0, len(h), self.reach)
        live = probes[self._shift(h[probes]) < self.reach]
        if not len(live):
            return
        ends = np.unique((live[:, None] + np.arange(self.reach)).ravel())  # last blocks of possible runs
        ends = ends[(ends < len(h)) & (ends >= m - b)]
        ends = ends[self._shift(h[ends]) == 0]
        if not len(ends):
            return
        starts = ends - (m - b)
        run = self._runs_of(x, starts)
        at = np.searchsorted(self.runs, run)
        at[at == len(self.runs)] = 0
        for i in np.flatnonzero(self.runs[at] == run):
            s = int(starts[i])
            for k in range(self.bucket[at[i]], self.bucket[at[i] + 1]):
                item, place = int(self.item[k]), int(self.place[k])
                if np.array_equal(self.items[item][place : place + m], x[s : s + m]):  # direct comparison
                    yield item, place, s

    def _shift(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.blocks, h)
        at[at == len(self.blocks)] = 0
        return np.where(self.blocks[at] == h, self.shifts[at], self.reach)

    def found(self, x: np.ndarray) -> set[int]:
        """Items of which x holds a stretch that is long enough."""
        seeds: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, place, s in self.occurrences(x):
            seeds[item][s - place].append(place)
        out = set()
        for item, diagonals in seeds.items():
            it = self.items[item]
            n = len(it)
            if n < self.search.least:
                continue
            order = sorted(diagonals)
            groups = [[order[0]]]
            for d in order[1:]:  # a unit lost or gained within a passage moves the rest of it
                if d - groups[-1][-1] <= 3:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            for group in groups:
                same = np.zeros(n, bool)
                if len(group) > 1:
                    self._mark_runs(same, x, it, group)
                else:
                    self._mark(same, x, it, group[0])
                if not self._long_enough(same):  # the rest behind a unit split, joined, lost or gained may be too short for a seed
                    self._mark_runs(same, x, it, sorted({d + k for d in group for k in range(-3, 4)} - set(group)))
                if self._long_enough(same):
                    out.add(self.names[item])
                    break
        return out

    def _mark(self, same: np.ndarray, x: np.ndarray, it: np.ndarray, d: int) -> None:
        """Mark the item's units that x has on a diagonal."""
        lo, hi = max(0, -d), min(len(it), len(x) - d)
        if lo < hi:
            same[lo:hi] |= (x[lo + d : hi + d] == it[lo:hi]) & (it[lo:hi] > 0)

    def _mark_runs(self, same: np.ndarray, x: np.ndarray, it: np.ndarray, diagonals: list[int]) -> None:
        """The same for neighbouring diagonals at once: there only runs of three tell, single equal units do not."""
        n = len(it)
        first, last = max(0, diagonals[0]), min(len(x), n + diagonals[-1])
        if last - first < 3:
            return
        at = np.arange(n)[None, :] + np.array(diagonals)[:, None]
        eq = (at >= 0) & (at < len(x)) & (it > 0)
        eq &= x[np.clip(at, 0, len(x) - 1)] == it
        run = (eq[:, :-2] & eq[:, 1:-1] & eq[:, 2:]).any(axis=0)
        same[:-2] |= run
        same[1:-1] |= run
        same[2:] |= run

    def _long_enough(self, same: np.ndarray) -> bool:
        # a stretch i..j with per * (altered units) <= its length: prefix(j) >= prefix(i), j - i >= least
        least, per = self.search.least, self.search.per
        prefix = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - per))])
        if len(prefix) <= least:
            return False
        low = np.minimum.accumulate(prefix)[: len(prefix) - least]
        return bool(np.any(prefix[least:] >= low))


def pattern_blocks(passages: Iterable[tuple[int, str]], words: Search, chars: Search) -> Iterator[tuple[PatternSet, PatternSet]]:
    """Pattern sets (by words, by characters) of at most LARGEST_SET characters of passages each, or of one passage."""
    held: list[tuple[int, str]] = []

    def built() -> tuple[PatternSet, PatternSet]:
        kinds = {c: [(i, units(normalise(p), c)) for i, p in held if by_characters(p) == c] for c in (False, True)}
        return PatternSet(kinds[False], words), PatternSet(kinds[True], chars)

    size = 0
    for item, passage in passages:
        if held and size + len(passage) > LARGEST_SET:
            yield built()
            held, size = [], 0
        held.append((item, passage))
        size += len(passage)
    yield built()


def leaked_items(docs: DataFrame, items: DataFrame, words: Search = WORDS, chars: Search = CHARS) -> DataFrame:
    """(item_id, doc_id) of every document holding a long enough stretch of an item's passage.

    docs: (doc_id, text); items: (item_id, passage). A stretch may begin or end with an altered word. The tables of the
    search are built once, from passages streamed to the driver a block of at most LARGEST_SET characters (or one
    passage) at a time, and broadcast by block. NULL and empty texts or passages, and
    passages shorter than a stretch, give nothing; repeated items are reported each. Documents are read and taken apart
    once, whole, whatever the number of blocks, and nothing is shuffled; of several blocks a task holds one at a time.
    """
    sc = docs.sparkSession.sparkContext
    known = ((r[0], r[1]) for r in items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage").toLocalIterator())
    blocks = [sc.broadcast(b) for b in pattern_blocks(known, words, chars)]

    def search(taken: list[tuple[int, list[str], list[str] | None]], hits: dict[int, set[int]]) -> None:
        for block in blocks:
            by_word, by_char = block.value
            for k, w, c in taken:
                hits[k] |= by_word.found(by_word.code(w))
                if c is not None and by_char.items:
                    hits[k] |= by_char.found(by_char.code(c))
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # read anew from the worker's disk for the next documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits: dict[int, set[int]] = defaultdict(set)
            taken, size = [], 0
            for k, text in enumerate(pdf["text"]):
                if text:
                    t = normalise(text)
                    taken.append((k, units(t, False), units(t, True) if CJK.search(t) else None))
                    size += len(t)
                    if len(blocks) == 1 or size > HELD_TEXT:
                        search(taken, hits)
                        taken, size = [], 0
            search(taken, hits)
            ids = pdf["doc_id"].to_numpy()
            yield pd.DataFrame([(i, ids[k]) for k in sorted(hits) for i in sorted(hits[k])], columns=["item_id", "doc_id"]).astype("int64")

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, "item_id bigint, doc_id bigint")
