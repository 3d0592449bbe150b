"""Periodic runs of words, found by internal pattern matching.

A run with period q and at least 4 q words holds a whole dyadic block (length
2^k, start a multiple of it) with 2^(k-1) < q <= 2^k, and so much on one side of
it that the block occurs again there, q words on or back and no nearer.  The
occurrences of a block in a window about twice as long make a progression; its
nearest two steps, forward and back, are the candidate periods of the block.

1. A suffix array of all texts of a batch comes from doubling: names of
   stretches of 2^k words are refined until all are different.  Each name is a
   range of the suffix array.
2. A wavelet tree over the suffix array answers, for all blocks of a level at
   once, which occurrence comes next after a place and which before it (range
   successor and predecessor), without listing occurrences.
3. Names of all levels give the longest common extension of two places in a
   logarithm of steps; it verifies a candidate and finds the ends of its run.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped, without

# Least words of a run, and least number of its periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# Words of the texts that are searched together; a longer text is searched alone.
TOGETHER = 1 << 18


class Wavelet:
    """Wavelet matrix over different numbers below 2^bits; queries are arrays."""

    def __init__(self, values, bits: int):
        import numpy as np

        self.bits, self.zeros, self.before = bits, [], []
        for bit in range(bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            # zeros before each place
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.before.append(before)
            self.zeros.append(int(before[-1]))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low, high, value):
        """How many numbers of places low to high - 1 are less than ``value``."""
        import numpy as np

        count = np.zeros(len(low), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            a, b = self.before[level][low], self.before[level][high]
            one = (value >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            low = np.where(one, low - a + self.zeros[level], a)
            high = np.where(one, high - b + self.zeros[level], b)
        return count

    def smallest(self, low, high, rank):
        """The number of which ``rank`` numbers of places low to high - 1 are less."""
        import numpy as np

        value, rank = np.zeros(len(low), np.int64), rank.copy()
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            a, b = self.before[level][low], self.before[level][high]
            one = rank >= b - a
            rank -= np.where(one, b - a, 0)
            value |= one.astype(np.int64) << bit
            low = np.where(one, low - a + self.zeros[level], a)
            high = np.where(one, high - b + self.zeros[level], b)
        return value


class Factors:
    """Suffix array and names of dyadic stretches of texts that stand one after the other.

    ``symbols`` are words as numbers from 0; each text is followed by a -1,
    and stretches of different texts have different names.
    """

    def __init__(self, symbols):
        import numpy as np

        n = len(symbols)
        ends = symbols < 0
        text = np.cumsum(ends) - ends
        key = text.astype(np.int64) * (int(symbols.max(initial=0)) + 2) + symbols + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        # a name is the first place of its range in the suffix array
        first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
        sizes = np.diff(np.append(first, n))
        name, size = np.empty(n, np.int32), np.empty(n, np.int32)
        name[order] = np.repeat(first, sizes)
        size[order] = np.repeat(sizes, sizes)
        self.order, self.names, self.sizes = order, [name], [size]
        length = 1
        while True:
            # only stretches that still share their name are refined
            open_places = np.flatnonzero(size[order] > 1)
            if not len(open_places):
                break
            places = order[open_places]
            # two that share a name hold no end of a text, so what follows is in the same one
            following = name[np.minimum(places + length, n - 1)]
            move = np.lexsort((following, name[places]))
            places, following, own = places[move], following[move], name[places[move]]
            order[open_places] = places
            new = np.append(True, (own[1:] != own[:-1]) | (following[1:] != following[:-1]))
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(places)))
            name, size = name.copy(), size.copy()
            name[places] = np.repeat(open_places[first], sizes)
            size[places] = np.repeat(sizes, sizes)
            self.names.append(name)
            self.sizes.append(size)
            length *= 2

    def extended(self, a, b):
        """How many words are the same from places a and b on."""
        import numpy as np

        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            same = name[a] == name[b]
            a, b = a + (same.astype(np.int64) << k), b + (same.astype(np.int64) << k)
        return a - start

    def extended_back(self, a, b):
        """How many words are the same before places a and b, a < b."""
        import numpy as np

        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            fits = a >= step
            same = fits & (name[np.where(fits, a - step, 0)] == name[np.where(fits, b - step, 1)])
            a, b = a - same * step, b - same * step
        return start - a


def find_runs(symbols):
    """Arrays (start, length, period) of the runs, by start, then period. Places count ``symbols``."""
    import numpy as np

    factors = Factors(symbols)
    n, starts, periods = len(symbols), [], []
    levels = len(factors.names)
    if levels > 1:
        # stretches of two words that occur once are in no longer one that occurs twice
        again = factors.sizes[1][factors.order] > 1
        inner = np.append(0, np.cumsum(again))
        tree = Wavelet(factors.order[again], max(1, int(n).bit_length()))
    for k in range(1, levels):
        blocks = np.arange(0, n, 1 << k)
        blocks = blocks[factors.sizes[k][blocks] > 1]
        if not len(blocks):
            continue
        low = factors.names[k][blocks].astype(np.int64)
        low, high = inner[low], inner[low + factors.sizes[k][blocks]]
        rank = tree.below(low, high, blocks)
        for step, some in ((1, low + rank + 1 < high), (-1, rank > 0)):
            near = tree.smallest(low[some], high[some], rank[some] + step)
            distance = np.abs(near - blocks[some])
            # shorter periods belong to shorter blocks; one and two to the shortest
            fit = (distance <= 1 << k) & ((distance > 1 << (k - 1)) | (k == 1))
            starts.append(np.minimum(near, blocks[some])[fit])
            periods.append(distance[fit])
    start, period = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (starts, periods))
    # blocks of one run name it each
    ahead = factors.extended(start, start + period)
    back = factors.extended_back(start, start + period)
    start, length = start - back, ahead + back + period
    fit = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, length, period = start[fit], length[fit], period[fit]
    # of the periods of one stretch the smallest counts: the others are multiples of it
    move = np.lexsort((period, length, start))
    start, length, period = start[move], length[move], period[move]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    move = np.lexsort((period, start))
    return start[move], length[move], period[move]


def _strongest(found: list) -> tuple:
    """Of (start, length, period) the one with the greatest length / period, exactly; the first of equal ones."""
    best = found[0]
    for run in found[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


ADDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256", "collapsed")]
    + [T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])))]
)


class _Numbers(dict):
    """Words by order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _repeating(n: int, h: int):
    """Places that stand for the n words of a planted text: from ``a`` on, the first p again and again."""
    import numpy as np

    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _searcher(outputs: list[str], planted: bool):
    def work():
        import numpy as np

        def search(texts: list, keys: list) -> list:
            number, parts, words = _Numbers(), [], []
            for text, key in zip(texts, keys):
                own = (text or b"").split()
                if planted and key is not None and own:
                    h = crc32(key)
                    if h % 10 == 0:
                        own = [own[i] for i in _repeating(len(own), h).tolist()]
                words.append(own)
                parts.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
                parts.append(np.array([-1]))
            start, length, period = find_runs(np.concatenate(parts))
            first = np.cumsum([0, *[len(w) + 1 for w in words]])
            bounds = np.searchsorted(start, first)
            rows = []
            for i, own in enumerate(words):
                a, b = bounds[i], bounds[i + 1]
                found = list(zip((start[a:b] - first[i]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
                kept = own
                best = [None] * 4
                if found:
                    turn = np.zeros(len(own) + 1, np.int64)
                    for s, n, q in found:
                        turn[s + q] += 1
                        turn[s + n] -= 1
                    kept = [own[j] for j in np.flatnonzero(np.cumsum(turn[:-1]) == 0).tolist()]
                    s, n, q = _strongest(found)
                    best = [s, n, q, 1000 * n // q]
                collapsed = b" ".join(kept)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
                row = dict(zip(("start", "length", "period", "exponent_milli"), best))
                row |= {
                    "n_runs": len(found), "runs_sha256": hashlib.sha256(listed).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed).hexdigest(),
                }
                if "collapsed" in outputs:
                    row["collapsed"] = collapsed.decode()
                if "runs" in outputs:
                    row["runs"] = [dict(zip(("start", "length", "period"), r)) for r in found]
                rows.append([row[o] for o in outputs])
            return rows

        def run(texts: list, keys: list) -> list:
            rows, held, size = [], 0, 0
            for i, text in enumerate(texts):
                # about as many words as spaces
                size += len(text or b"") // 5 + 1
                if size >= TOGETHER:
                    rows += search(texts[held : i + 1], keys[held : i + 1])
                    held, size = i + 1, 0
            if held < len(texts):
                rows += search(texts[held:], keys[held:])
            return list(zip(*rows)) if rows else [[] for _ in outputs]

        return run

    return work


def with_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    outputs: tuple[str, ...] = ("n_runs", "runs", "collapsed"), planted: bool = False,
) -> DataFrame:
    """``docs`` with columns about the periodic runs of each whole text.

    Words are split at white space (space, tab to carriage return).  A run is a
    stretch of words with smallest period q (words q apart are the same), of at
    least 6 words and 4 periods, that cannot be extended; n_runs counts them,
    runs lists (start, length, period), by start, then period.  start, length,
    period and exponent_milli (1000 length / period, rounded down) are those of
    the run of greatest length / period, of equal ones the first; null without
    runs.  collapsed joins by single spaces the words that no run holds beyond
    its first period.  The digests are those of the runs as lines and of
    collapsed.

    ``planted`` puts repeats into every tenth text first, by a checksum of its
    key; a null key gets none.  A null text has no words; repeated rows get a
    result each; input columns named like outputs are replaced; no rows give no
    rows.
    """
    adds = T.StructType([f for f in ADDS if f.name in outputs])
    rows = without(docs, outputs)
    # the row travels as one column, so that no name of its columns clashes
    packed = rows.select(
        F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]).alias("row"),
        F.col(text).cast("string").alias("text"), F.col(key).cast("string").alias("key"),
    )
    found = mapped(packed, ["text", "key"], adds, _searcher([f.name for f in adds], planted))
    return found.select("row.*", *outputs)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and the digests, with repeats planted."""
    outputs = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return with_runs(docs.select("doc_id", "text"), outputs=outputs, planted=True).select("doc_id", *outputs)
