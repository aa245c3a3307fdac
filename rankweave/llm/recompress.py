"""Recompression of word sequences: run and pair naming, and the symbols that represent windows.

Each step renames a sequence of symbols: a *run step* turns every maximal run of one symbol into one
symbol, a *pair step* splits the alphabet into left and right symbols (a bit of the name, other bits in
each step) and joins every left symbol with a right one behind it. A name is a hash of what it stands for,
so all tasks give equal pairs equal names without a dictionary. No symbol covers more than ``cap`` words.

What becomes of a symbol depends on its neighbours, hence every symbol carries the stretch of words that
it depends on: two joined symbols depend on what each did; a left symbol that found no partner depends on
the symbol behind it too, a right one on the symbol before it, and after a run step everything depends on
both neighbours. The edge of a text counts as a word outside it. **A symbol whose stretch lies inside a
window is the same symbol in every occurrence of that window**; words are symbols that depend on nothing
else, so every window has some. The longest of them (ties by name) is the window's *representative*:
windows of equal words have equal representatives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rankweave.llm.textcore import mix

#: Steps of a parse: r run, p pair.
STEPS = "rppprpppppp"
#: Bits of a key that hold a symbol's length in words; the others are bits of its name.
LENGTH_BITS = 6
#: Symbols shorter than this are looked at only if some window has no longer one.
USUAL = 4
_CLOSED = np.uint64(2**64 - 1)


@dataclass
class Symbols:
    """Symbols of some texts: words ``[start, end)``, name, and the words ``[lo, hi)`` they depend on."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def take(self, at: np.ndarray) -> Symbols:
        return Symbols(*(x[at] for x in (self.name, self.start, self.end, self.lo, self.hi)))

    def key(self) -> np.ndarray:
        return ((self.end - self.start).astype(np.uint64) << np.uint64(64 - LENGTH_BITS)) | (self.name >> np.uint64(LENGTH_BITS))


def _joined(parts: list[Symbols]) -> Symbols:
    return Symbols(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("name", "start", "end", "lo", "hi")))


def _neighbours(now: Symbols, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo of the symbol before and hi of the symbol behind each; one word outside at the edges of a text."""
    before, behind = np.empty_like(now.lo), np.empty_like(now.hi)
    before[1:], behind[:-1] = now.lo[:-1], now.hi[1:]
    before[first], behind[last] = now.start[first] - 1, now.end[last] + 1
    return before, behind


def _edges(now: Symbols, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and the last symbol of every text that has some."""
    at = np.searchsorted(now.start, bounds)
    some = at[:-1] < at[1:]
    return at[:-1][some], at[1:][some] - 1


def _run_step(now: Symbols, bounds: np.ndarray, cap: int) -> tuple[Symbols, Symbols]:
    first, last = _edges(now, bounds)
    n = len(now.name)
    head = np.ones(n, dtype=bool)
    head[1:] = now.name[1:] != now.name[:-1]
    head[first] = True
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n))
    tail = at + size - 1
    before, behind = _neighbours(now, first, last)
    # the whole run and both neighbours show that a run ends where it does
    lo, hi = np.minimum(before[at], now.lo[at]), np.maximum(behind[tail], now.hi[tail])
    run = np.repeat(np.arange(len(at)), size)
    short = (size > 1) & (now.end[tail] - now.start[at] <= cap)
    out = Symbols(now.name.copy(), now.start, now.end.copy(), lo[run], hi[run])
    out.end[at[short]] = now.end[tail[short]]
    out.name[at[short]] = mix(now.name[at[short]] * np.uint64(0x9E3779B97F4A7C15) + size[short].astype(np.uint64))
    return out.take(np.flatnonzero(head | ~short[run])), out.take(at[short])


def _pair_step(now: Symbols, bounds: np.ndarray, cap: int, step: int) -> tuple[Symbols, Symbols]:
    first, last = _edges(now, bounds)
    left = (mix(now.name + np.uint64(step)) >> np.uint64(40)) & np.uint64(1) == 0
    before, behind = _neighbours(now, first, last)
    words = now.end - now.start
    meets = np.zeros(len(left), dtype=bool)
    meets[:-1] = left[:-1] & ~left[1:] & (words[:-1] + words[1:] <= cap)
    meets[last] = False
    joins = np.flatnonzero(meets)
    lo, hi = now.lo.copy(), now.hi.copy()
    free = words < cap  # a full symbol joins nothing, whatever stands beside it
    hi[left & free] = np.maximum(hi, behind)[left & free]
    lo[~left & free] = np.minimum(lo, before)[~left & free]
    out = Symbols(now.name.copy(), now.start, now.end.copy(), lo, hi)
    out.name[joins] = mix(mix(now.name[joins] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ now.name[joins + 1])
    out.end[joins], out.lo[joins], out.hi[joins] = now.end[joins + 1], np.minimum(now.lo[joins], now.lo[joins + 1]), np.maximum(now.hi[joins], now.hi[joins + 1])
    keep = np.ones(len(left), dtype=bool)
    keep[joins + 1] = False
    return out.take(np.flatnonzero(keep)), out.take(joins)


def symbols(h: np.ndarray, bounds: np.ndarray, cap: int) -> Symbols:
    """Words and all symbols that the steps make, from word hashes; text k has the words
    ``bounds[k]:bounds[k + 1]``."""
    at = np.arange(len(h), dtype=np.int32)
    now = Symbols(mix(h ^ np.uint64(0x6A09E667F3BCC909)), at, at + np.int32(1), at, at + np.int32(1))
    made = [now]
    for step, kind in enumerate(STEPS):
        if len(now.name):
            now, new = _run_step(now, bounds, cap) if kind == "r" else _pair_step(now, bounds, cap, step)
            made.append(new)
    return _joined(made)


def _slid(op: np.ufunc, x: np.ndarray, levels: int) -> list[np.ndarray]:
    """op over every 2**j consecutive entries, for each j; shorter at the end."""
    out = [x]
    for j in range(1, levels):
        half = 1 << (j - 1)
        out.append(op(out[-1][:-half], out[-1][half:]) if len(out[-1]) > half else out[-1][:0])
    return out


@dataclass
class Represented:
    """Representatives of windows: for each window start its key (0: no window starts there), and the symbols
    that represent some window, with the first and last start of a window that holds their stretch."""

    of: np.ndarray
    chosen: Symbols
    a: np.ndarray
    b: np.ndarray


def represent(h: np.ndarray, bounds: np.ndarray, window: int, cap: int, opened: np.ndarray | None = None) -> Represented:
    """The representative of every window of ``window`` words; of opened starts only, if given."""
    levels = window.bit_length()
    n = len(h)
    all_symbols = symbols(h, bounds, cap)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) if n else np.zeros(0, np.int64)
    owner = text[all_symbols.start]
    a = np.maximum(all_symbols.hi - window, bounds[:-1][owner])
    b = np.minimum(all_symbols.lo, bounds[1:][owner] - window)
    fits = (a <= b) & (all_symbols.lo >= bounds[:-1][owner]) & (all_symbols.hi <= bounds[1:][owner])
    usual = all_symbols.end - all_symbols.start >= USUAL
    size = np.diff(bounds)
    step = np.zeros(n + 1, dtype=np.int32)
    has = size >= window
    np.add.at(step, bounds[:-1][has], 1)
    np.add.at(step, bounds[1:][has] - window + 1, -1)
    starts = np.cumsum(step[:-1]) > 0

    tables = [np.zeros(n, dtype=np.uint64) for _ in range(levels)]
    key = all_symbols.key()
    at = np.flatnonzero(fits & usual)
    top = _paint(tables, key[at], a[at], b[at])
    if (starts & (top == 0)).any():
        more = np.flatnonzero(fits & ~usual)
        top = _paint(tables, key[more], a[more], b[more])
        at = np.concatenate((at, more))
    wanted = starts if opened is None else starts & opened
    top = np.where(starts, top, np.uint64(0))
    # a symbol is chosen if it is the key of some wanted window that holds it: then it is the least one there
    low = _slid(np.minimum, np.where(wanted, top, _CLOSED), levels)
    width = b[at] - a[at] + 1
    j = np.frexp(width.astype(np.float64))[1] - 1
    least = np.empty(len(at), dtype=np.uint64)
    for level in range(levels):
        some = np.flatnonzero(j == level)
        least[some] = np.minimum(low[level][a[at[some]]], low[level][b[at[some]] - (1 << level) + 1])
    at = at[least == key[at]]
    return Represented(top, all_symbols.take(at), a[at], b[at])


def _paint(tables: list[np.ndarray], key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest key at every start, where each key holds for starts a to b; tables keep what was painted."""
    j = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    for level, table in enumerate(tables):
        some = np.flatnonzero(j == level)
        np.maximum.at(table, a[some], key[some])
        np.maximum.at(table, b[some] - (1 << level) + 1, key[some])
    out = tables[-1]
    for level in range(len(tables) - 2, -1, -1):
        half = 1 << level
        below = np.maximum(tables[level], out)
        below[half:] = np.maximum(below[half:], out[:-half] if half else out)
        out = below
    return out
