"""Best segmentations of many texts at once under counts that stay as they are.

While nothing is learnt, texts don't depend on each other: the words of the
lexicon that end at each place of a batch are looked up together, and the
search takes one step for a place of all its texts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .learner import SAME, Segmenter

#: About so many symbols are searched together.
CHUNK = 1 << 18
#: The rest of so few long texts is searched text by text.
FEW = 12
#: Places of tables that lead from the last symbols of a word straight into the trie.
DIRECT = 1 << 20


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, one after the other, and how many each has."""
    texts = pc.fill_null(texts, "")
    own = texts.cast(pa.large_binary())
    start = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    whole = str(own.buffers()[2][int(start[0]) : int(start[-1])], "utf-8") if start[-1] > start[0] else ""
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


class FrozenSearch:
    """The search of a :class:`Segmenter` whose unknown words are products over symbols, for whole batches.

    Words are kept in a trie from their last symbol to their first.  Its nodes
    are numbered level by level, so that the children of a node follow each
    other in order of their symbols: ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, delim: str, words: pa.Array, counts: np.ndarray, costs: tuple[dict[str, float], float, float, float]):
        """``costs`` as :meth:`Segmenter.symbol_costs` has them."""
        symbol, self.other, self.rest, under = costs
        self.under = under if under > -math.inf else 0.0  # without tokens nothing has been counted, and each word's log is -inf
        self.delim = ord(delim)
        words = pc.utf8_reverse(words)
        order = pc.array_sort_indices(words)
        codes, sizes = code_points(words.take(order))
        kinds, kind = np.unique(np.asarray(counts, float)[order.to_numpy()], return_inverse=True)
        self.logs = np.array([0.0, *(math.log(k) if k > 0 else -math.inf for k in kinds.tolist())])
        self.alphabet = np.unique(np.concatenate([codes, np.array([ord(s) for s in symbol], np.uint32)]))
        self.costs = np.array([self.other, *(symbol.get(chr(c), self.other) for c in self.alphabet.tolist())])
        codes = self._index()[codes]
        starts = np.cumsum(sizes) - sizes
        node, count = np.zeros(len(sizes), np.int32), 1
        parents, syms, ended, self.levels = [], [np.zeros(1, np.int32)], [], [0, 1]
        active, depth = np.flatnonzero(sizes), 0
        while len(active):  # words are sorted: those with the same beginning lie side by side
            s, parent = codes[starts[active] + depth], node[active]
            new = np.ones(len(active), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (s[1:] != s[:-1])
            own = node[active] = (count - 1 + np.cumsum(new)).astype(np.int32)
            parents.append(parent[new])
            syms.append(s[new])
            depth += 1
            last = sizes[active] == depth
            ended.append((own[last], kind[active[last]]))
            count += len(parents[-1])
            self.levels.append(count)
            active = active[~last]
        self.longest = depth
        children = np.bincount(np.concatenate(parents), minlength=count) if parents else np.zeros(1, int)
        # one node more than there are stands for none: it has no children and is no word
        self.first = np.concatenate([[1], 1 + np.cumsum(children), [count]]).astype(np.int32)
        self.sym = np.concatenate(syms).astype(np.uint16 if len(self.alphabet) < 1 << 16 else np.int32)
        self.word = np.zeros(count + 1, np.int32)
        for at, k in ended:
            self.word[at] = k + 1

    @classmethod
    def of(cls, model: Segmenter) -> FrozenSearch | None:
        """None if ``model`` searches in another way."""
        if model.config.exact or model.config.max_word_len is not None or not model._by_symbols():
            return None
        costs = model.symbol_costs(len(model.lexicon))
        if not cls.finite(costs):
            return None
        return cls(model.delim, pa.array(list(model.lexicon), pa.large_string()), np.array(list(model.lexicon.values()), float), costs)

    @staticmethod
    def finite(costs) -> bool:
        """Whether every text has some probability."""
        return min(costs[0].values(), default=0.0) > -math.inf and costs[1] > -math.inf and costs[2] > -math.inf

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.first, self.sym, self.word, self.logs, self.alphabet, self.costs))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "direct")}

    def _index(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32)
        out[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return out

    @cached_property
    def index(self) -> np.ndarray:
        """Numbers of symbols from 1, by code point; 0 for others."""
        return self._index()

    @cached_property
    def direct(self) -> list[np.ndarray]:
        """Nodes of the first levels by the numbers of their symbols."""
        width, none, out = len(self.alphabet) + 1, len(self.sym), []
        keys = np.zeros(1, np.int64)
        while len(out) + 2 < len(self.levels) and width ** (len(out) + 1) <= DIRECT:
            low, above, high = self.levels[len(out) : len(out) + 3]
            children = np.diff(self.first[low : above + 1])
            keys = np.repeat(keys, children) * width + self.sym[above:high]
            table = np.full(width ** (len(out) + 1), none, np.int32)
            table[keys] = np.arange(above, high)
            out.append(table)
        return out

    def segment(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Words of each text that has symbols other than delimiters, and where these texts are."""
        points, sizes = code_points(texts)
        kept = points != self.delim
        line = np.repeat(np.arange(len(sizes)), sizes)[kept]
        points, sizes = points[kept], np.bincount(line, minlength=len(sizes))
        some = np.flatnonzero(sizes)
        codes, sizes = self.index[points], sizes[some]
        starts = np.cumsum(sizes) - sizes
        ends = np.zeros(len(codes), bool)
        order = np.argsort(-sizes, kind="stable")
        low = 0
        while low < len(order):
            filled = np.cumsum(sizes[order[low : low + CHUNK]])
            high = low + max(1, int(np.searchsorted(filled, CHUNK, "right")))
            part = order[low:high]
            ends[self._last_symbols(codes, starts[part], sizes[part])] = True
            low = high
        size = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        stops = np.cumsum(size)[ends]
        data = points.tobytes().decode("utf-32-le").encode()
        words = pa.StringArray.from_buffers(len(stops), pa.py_buffer(np.concatenate([[0], stops]).astype(np.int32)), pa.py_buffer(data))
        per = np.add.reduceat(ends, starts, dtype=np.int64) if len(starts) else np.zeros(0, int)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), words), some

    def _last_symbols(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of the last symbols of the words of texts, of which the longest come first.

        Symbols are laid out by their place in the text, then by text; before
        them is a row of ``lines`` entries for the offset 0.
        """
        lines, total = len(sizes), int(sizes.sum())
        steps = int(sizes[0])
        per = lines - np.searchsorted(sizes[::-1], np.arange(steps), "right")
        rows = lines + np.cumsum(per) - per  # where the row of each place begins
        place = np.repeat(np.arange(steps, dtype=np.int32), per)
        text = (np.arange(lines, lines + total) - np.repeat(rows, per)).astype(np.int32)
        where = starts[text] + place
        own = np.concatenate([np.zeros(lines, np.int32), codes[where]])
        before = np.concatenate([np.arange(lines), np.repeat(np.concatenate([[0], rows[:-1]]), per) + text]).astype(np.int32)
        at, start, size, kind = self._words(own, before, lines)
        back = self._steps(lines, rows, per, self.costs[own[lines:]], at, start, place[at - lines] + 1 - size, self.logs[kind])
        found, text, end = [], np.arange(lines), sizes
        while len(text):  # from the ends back to 0
            last = rows[end - 1] + text
            found.append(where[last - lines])
            end = back[last]
            text, end = text[end > 0], end[end > 0]
        return np.concatenate(found)

    def _words(self, own: np.ndarray, before: np.ndarray, lines: int) -> tuple[np.ndarray, ...]:
        """All words of the lexicon: their last symbol, the symbol before them, size and count (by number); sorted by the first."""
        first, sym, word, width = self.first, self.sym, self.word, len(self.alphabet) + 1
        at = np.arange(lines, len(own), dtype=np.int32)
        cur, node, key, depth = at, np.zeros(len(at), np.int32), np.zeros(len(at), np.int32), 0
        found = []
        for table in self.direct:
            key = key * width + own[cur]
            node, cur, depth = table[key], before[cur], depth + 1
            hit = np.flatnonzero(word[node])
            found.append((at[hit], cur[hit], np.full(len(hit), depth, np.int32), word[node[hit]]))
        while len(at):
            low, high = first[node], first[node + 1]
            s = own[cur]
            go = np.flatnonzero((high > low) & (s > 0))
            at, cur, s, low, high = at[go], cur[go], s[go], low[go], high[go]
            if not len(at):
                break
            span, top = high - low, high - 1
            for _ in range(int(span.max()).bit_length()):
                half = span >> 1
                less = (sym[np.minimum(low + half, top)] < s) & (span > 0)
                low = np.where(less, low + half + 1, low)
                span = np.where(less, span - half - 1, half)
            go = np.flatnonzero((low < high) & (sym[np.minimum(low, top)] == s))
            at, cur, node, depth = at[go], before[cur[go]], low[go], depth + 1
            hit = np.flatnonzero(word[node])
            found.append((at[hit], cur[hit], np.full(len(hit), depth, np.int32), word[node[hit]]))
        if not found:
            return tuple(np.zeros(0, np.int32) for _ in range(4))
        parts = [np.concatenate(x) for x in zip(*found)]
        order = np.argsort(parts[0], kind="stable")
        return tuple(x[order] for x in parts)

    def _steps(self, lines, rows, per, costs, at, start, offset, log) -> np.ndarray:
        """Where the last word begins, for each end; choices as in ``Segmenter._symbol_search``."""
        rest, under, size = self.rest, self.under, lines + len(costs)
        best, gains, tops, back = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size, np.int32)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        opens = np.flatnonzero(new)
        ends = at[opens]
        group = np.cumsum(new) - 1
        bounds = np.append(rows, size)
        of_words, of_ends = np.searchsorted(at, bounds).tolist(), np.searchsorted(ends, bounds).tolist()
        sums, top, top_at = np.zeros(lines), np.zeros(lines), np.zeros(lines, np.int32)
        for t, (a, n) in enumerate(zip(rows.tolist(), per.tolist())):
            if n < FEW:
                for i in range(n):
                    self._alone(i, t, int((per > i).sum()), rows, costs, at, start, offset, log, (best, gains, tops, back), sums[i], top[i], int(top_at[i]), lines)
                break
            b, end = a + n, t + 1
            sums, top, top_at = sums[:n] + costs[a - lines : b - lines], top[:n], top_at[:n]
            base = sums + rest
            value, chosen = base + top, top_at
            m, m_end, g, g_end = of_words[t], of_words[end], of_ends[t], of_ends[end]
            if g < g_end:
                chosen = top_at.copy()
                x = best[start[m:m_end]] + log[m:m_end] - under
                s, cut, mine, u = offset[m:m_end], opens[g:g_end] - m, group[m:m_end] - g, ends[g:g_end] - a
                known, unknown, top_u = np.maximum.reduceat(x, cut), value[u], top_at[u]
                same = np.logical_or.reduceat(s == top_u[mine], cut)  # the best start of an unknown word makes a known one
                value_u = np.where(same, known, np.maximum(known, unknown))
                near = value_u - SAME
                first = np.minimum.reduceat(np.where(x >= near[mine], s, end), cut)
                first = np.where(~same & (unknown >= near), np.minimum(first, top_u), first)
                for j in np.flatnonzero(same & (known <= unknown + SAME)).tolist():  # else no unknown word is as good
                    words = slice(cut[j], cut[j + 1] if j + 1 < len(cut) else len(x))
                    value_u[j], first[j] = self._other_start(int(u[j]), end, rows, gains, tops, base[u[j]], known[j], unknown[j], s[words], x[words])
                first[first == end] = 0  # nothing has any probability
                value[u], chosen[u] = value_u, first
            best[a:b], back[a:b] = value, chosen
            gain = value - sums
            top_at = np.where(gain > top + SAME, np.int32(end), top_at)
            top = np.maximum(top, gain)
            gains[a:b], tops[a:b] = gain, top
        return back

    def _alone(self, text: int, low: int, high: int, rows, costs, at, start, offset, log, tables, total, top, top_at, lines) -> None:
        """The steps of one text from place ``low``, for which arrays are too short to pay."""
        best, gains, tops, back = tables
        places = rows[low:high] + text
        opens, closes = np.searchsorted(at, places).tolist(), np.searchsorted(at, places, "right").tolist()
        rest, under = self.rest, self.under
        for end, (i, a, z, cost) in enumerate(zip(places.tolist(), opens, closes, costs[places - lines].tolist()), low + 1):
            total = total + cost
            base = total + rest
            value, chosen = base + top, top_at
            if a < z:
                x, s = (best[start[a:z]] + log[a:z] - under).tolist(), offset[a:z].tolist()
                known = max(x)
                if top_at not in s:
                    unknown, value = value, max(known, value)
                    near = value - SAME
                    chosen = min((k for k, v in zip(s, x) if v >= near), default=end)
                    chosen = min(chosen, top_at) if unknown >= near else chosen
                elif known <= value + SAME:
                    value, chosen = self._other_start(text, end, rows, gains, tops, base, known, value, offset[a:z], np.array(x))
                else:
                    value = known
                    chosen = min(k for k, v in zip(s, x) if v >= known - SAME)
                chosen = 0 if chosen == end else chosen
            gain = value - total
            top_at = end if gain > top + SAME else top_at
            top = max(top, gain)
            best[i], back[i], gains[i], tops[i] = value, chosen, gain, top

    def _other_start(self, text: int, end: int, rows, gains, tops, base, known, unknown, tried, x) -> tuple[float, int]:
        """Value and start where the best start of an unknown word makes a word of the lexicon.

        Starts of such words are among the last ``longest``; before these the
        greatest gains so far are enough.
        """
        low = max(0, end - self.longest)
        place = lambda s: text if s == 0 else int(rows[s - 1]) + text
        near_by = gains[[place(s) for s in range(low, end)]]
        free = np.ones(len(near_by), bool)
        free[tried - low] = False
        most = max(near_by[free].max(initial=-math.inf), tops[place(low - 1)] if low else -math.inf)
        value = max(known, base + most)
        near = value - SAME
        at = int(tried[x >= near].min(initial=end))
        if unknown < near:
            return value, at
        if low and base + tops[place(low - 1)] >= near:
            a, b = 0, low - 1
            while a < b:
                half = (a + b) // 2
                a, b = (a, half) if base + tops[place(half)] >= near else (half + 1, b)
            return value, min(a, at)
        good = np.flatnonzero(free & (base + near_by >= near))
        return value, min(low + int(good[0]), at) if len(good) else at
