"""Encoding with merge-type SentencePiece vocabularies, and decoding.

The merges run on an agenda: of the adjacent symbol pairs that form a piece the
one with the best score comes first, the leftmost among equals.  The new words
of a batch run theirs together in arrays; a very long one has a heap, where
pairs whose symbols have changed meanwhile are passed over.  No piece of such a vocabulary spans
the start of a word, so a text is merged word by word, and frequent words are
merged once per Python worker.  In every Arrow batch, each word that was
merged anew is held against the sentencepiece library; a difference raises.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import mapped

SPACE = "▁"
# Words a worker remembers at least, of those it met last.
REMEMBERED_WORDS = 150_000
REMEMBERED_LENGTH = 40
# Units of at most so many symbols are merged in arrays, longer ones with a heap each.
FEW_SYMBOLS = 48
NO_RANK = 1 << 30


def words_of(text: bytes) -> list[str]:
    """What stands between the spaces of a text; of several spaces in a row, all but one lead a word.

    A word start counts as a space.
    """
    text = text.decode("utf-8", "replace").replace(SPACE, " ")
    if "  " in text or text[0] == " ":
        return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ")


class Memory:
    """Remembers what was asked for last: at least ``REMEMBERED_WORDS`` words, at most twice as many."""

    def __init__(self):
        self.young, self.old = {}, {}

    def get(self, word: str):
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is not None:
                self.put(word, found)
        return found

    def put(self, word: str, value) -> None:
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.young) >= REMEMBERED_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = value


class Pairs:
    """The agendas of many short units at once, in arrays.

    Every symbol is a number, every pair that forms a piece an entry of an
    open-addressing table.  In each round every unit merges its best pair,
    leftmost among equals, and only the two pairs beside it are looked up anew.
    """

    def __init__(self, pieces: dict[str, int], scores: dict[str, float]):
        import numpy as np

        characters = sorted({c for p in pieces for c in p if c not in pieces})
        # characters that are no piece have numbers beyond those of all pieces
        self.beyond = max(pieces.values(), default=0) + 1
        number = pieces | {c: self.beyond + i for i, c in enumerate(characters)}
        self.base = self.beyond + len(characters)
        self.codes = np.full(0x110000, -1, np.int64)
        for symbol, code in number.items():
            if len(symbol) == 1:
                self.codes[ord(symbol)] = code
        ranks = {s: i for i, s in enumerate(sorted(set(scores.values())))}
        found = [
            (number[p[:i]] * self.base + number[p[i:]], code, ranks[scores[p]])
            for p, code in pieces.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number
        ]
        keys, self.to, self.rank = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.keys, left, probe = keys, np.arange(len(keys)), self.first(keys)
        while len(left):
            free = self.slots[probe] < 0
            self.slots[probe[free]] = left[free]
            # of entries for one slot the last one has it
            out = self.slots[probe] != left
            left, probe = left[out], (probe[out] + 1) & (len(self.slots) - 1)

    def first(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a, b):
        """Ranks and merged symbols of pairs; the rank of no pair is ``NO_RANK``."""
        import numpy as np

        rank, to = np.full(len(a), NO_RANK, np.int64), np.zeros(len(a), np.int64)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(self.keys):
            return rank, to
        keys = a[left] * self.base + b[left]
        probe = self.first(keys)
        while len(left):
            entry = self.slots[probe]
            hit = (entry >= 0) & (self.keys[entry] == keys)
            rank[left[hit]], to[left[hit]] = self.rank[entry[hit]], self.to[entry[hit]]
            on = (entry >= 0) & ~hit
            left, keys, probe = left[on], keys[on], (probe[on] + 1) & (len(self.slots) - 1)
        return rank, to

    def merged(self, units: list[str]):
        """Symbols of all units, one unit after the other, and how many each has."""
        import numpy as np

        symbols = self.codes[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        rank, to = np.full(len(symbols), NO_RANK, np.int64), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], to[inner] = self.find(symbols[inner], symbols[inner + 1])
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(symbols)), starts)
            going = best < NO_RANK << 32
            at = best[going] & 0xFFFFFFFF
            if not going.all():
                keep = np.repeat(going, np.diff(np.append(starts, len(symbols))))
                done.append((owner[~keep], symbols[~keep]))
                at = (np.cumsum(keep) - 1)[at]
                symbols, owner, rank, to = symbols[keep], owner[keep], rank[keep], to[keep]
                if not len(symbols):
                    break
            symbols[at] = to[at]
            alive = np.ones(len(symbols), bool)
            alive[at + 1] = False
            symbols, owner, rank, to = symbols[alive], owner[alive], rank[alive], to[alive]
            # each unit before has lost one symbol
            at = at - np.arange(len(at))
            before = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            at = np.concatenate([at, before])
            after = np.minimum(at + 1, len(symbols) - 1)
            last = (after == at) | (owner[after] != owner[at])
            rank[at], to[at] = self.find(np.where(last, -1, symbols[at]), symbols[after])
        owner, symbols = (np.concatenate([np.zeros(0, np.int64), *[d[i] for d in done]]) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(units))


class Vocabulary:
    """Pieces and scores of a model with byte fallback and plain normalisation."""

    def __init__(self, model: bytes):
        import numpy as np
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        byte_ids = [i for i in ids if lib.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary needs byte fallback")
        self.byte_ids = byte_ids
        special = {i for i in ids if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)}
        self.pieces = {lib.id_to_piece(i): i for i in ids if i not in special}
        self.scores = {p: -lib.get_score(i) for p, i in self.pieces.items()}
        self.surfaces = {i: p.replace(SPACE, " ").encode() for p, i in self.pieces.items()}
        self.surfaces |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.pairs = Pairs(self.pieces, self.scores)
        # surfaces of all ids, one after the other
        each = [self.surfaces.get(i, b"") for i in ids]
        self.surface_sizes = np.array([len(e) for e in each])
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface_bytes = np.frombuffer(b"".join(each), np.uint8)
        # symbols of the library for single words carry no word start of their own
        self.start = lib.encode("")
        self.units = re.compile(self.unit_pattern())
        # packed ids and surfaces of words and of units
        self.known, self.known_units = Memory(), Memory()

    def unit_pattern(self) -> str:
        """Pattern of the stretches of text that no merge leaves.

        Two characters that stand side by side in no piece are never merged:
        here a letter and a punctuation mark, a character and the space after
        it, and a line break and anything.
        """
        side = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] for x in side):
            return "(?s:.+)"
        if any("\n" in x for x in side):
            return f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        letters = {x for x in side if x[0].isalnum() and not x[0].isdecimal()}
        marks = "".join(c for c in ".,;:!?" if all(x[1] != c for x in letters))
        words = f"{SPACE}*[^\\W\\d_]+(?=[{marks}])|" if marks else ""
        return f"{words}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"

    def merge(self, unit: str) -> list[int]:
        """Piece ids of one unit."""
        ids = []
        for s in self.many(list(unit)):
            i = self.pieces.get(s)
            if i is None:
                ids.extend(self.byte_ids[b] for b in s.encode())
            else:
                ids.append(i)
        return ids

    def merge_all(self, units: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Packed piece ids and surface of each unit, each held against the library."""
        import numpy as np

        short = [u for u in units if len(u) <= FEW_SYMBOLS]
        ids, sizes = self.pairs.merged(short)
        # a character that is no piece is spelled in bytes, one unit at a time
        odd = (ids < 0) | (ids >= self.pairs.beyond)
        if odd.any():
            owner = np.repeat(np.arange(len(short)), sizes)
            spelled = np.zeros(len(short), bool)
            spelled[owner[odd]] = True
            ids, sizes = ids[~spelled[owner]], sizes[~spelled]
            plain = [u for u, s in zip(short, spelled.tolist()) if not s]
        else:
            plain = short
        self.check(plain, ids, sizes)
        ends = np.cumsum(sizes)
        lengths = self.surface_sizes[ids]
        at = np.repeat(self.surface_starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        surfaces, packed = self.surface_bytes[at].tobytes(), ids.astype("<u4").tobytes()
        # where the surface of a unit ends: that of its last id
        cuts = np.append(0, np.cumsum(lengths))[ends]
        found, i, j = {}, 0, 0
        for unit, end, cut in zip(plain, (ends * 4).tolist(), cuts.tolist()):
            found[unit] = packed[i:end], surfaces[j:cut]
            i, j = end, cut
        rest = [u for u in units if u not in found]
        if rest:
            merged = [self.merge(u) for u in rest]
            self.check(rest, np.array([i for m in merged for i in m], np.int64), np.array([len(m) for m in merged], np.int64))
            for unit, own in zip(rest, merged):
                found[unit] = struct.pack(f"<{len(own)}I", *own), b"".join(map(self.surfaces.__getitem__, own))
        return found

    def many(self, symbols: list[str]) -> list[str]:
        """Merged symbols; the agenda is a heap."""
        scores, n = self.scores, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def propose(i, j):
            pair = symbols[i] + symbols[j]
            if pair in scores:
                heapq.heappush(agenda, (scores[pair], i, j, pair))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if after[i] != j or symbols[i] + symbols[j] != pair or not symbols[i]:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                propose(i, k)
            if before[i] >= 0:
                propose(before[i], i)
        return [s for s in symbols if s]

    def check(self, units: list[str], ids, sizes) -> None:
        """Raises where the library encodes a unit in another way; ``ids`` of all units, and how many each has."""
        import numpy as np

        # the library puts a word start before each text: units that bring one leave theirs;
        # no merge crosses a line break, so the rest is read after one
        texts = [u[1:] if u[0] == SPACE else "\n" + u for u in units]
        wanted = self.library.encode(texts, num_threads=1)
        wanted = [w if u[0] == SPACE else w[2:] for u, w in zip(units, wanted)]
        # a word start or a line break alone is told by the texts around it
        checked = np.fromiter((u != SPACE and u != "\n" for u in units), bool, len(units))
        flat = np.fromiter(chain.from_iterable(w for w, c in zip(wanted, checked.tolist()) if c), np.int64)
        lengths = np.fromiter(map(len, wanted), np.int64, len(units))
        if not ((lengths == sizes)[checked].all() and np.array_equal(flat, ids[np.repeat(checked, sizes)])):
            starts = np.cumsum(sizes) - sizes
            for u, w, c, a, n in zip(units, wanted, checked.tolist(), starts.tolist(), sizes.tolist()):
                if c and ids[a : a + n].tolist() != w:
                    raise RuntimeError(f"{u!r} became {ids[a : a + n].tolist()}, the library says {w}")

    def encode_batch(self, texts: list[bytes | None]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers and the surface of each text, ends not included."""
        known, met, out = self.known, {}, []
        found = [words_of(text) if text else [] for text in texts]
        packed = [list(map(known.young.get, words)) for words in found]
        for w in dict.fromkeys(w for words, own in zip(found, packed) if None in own for w, p in zip(words, own) if p is None):
            met[w] = known.get(w)
        units_of = self.units_of([w for w, e in met.items() if e is None])
        units = dict.fromkeys(u for own in units_of.values() for u in own)
        for u in units:
            units[u] = self.known_units.get(u)
        merged = self.merge_all([u for u, e in units.items() if e is None])
        units |= merged
        for u, e in merged.items():
            self.known_units.put(u, e)
        for w, own in units_of.items():
            parts = [units[u] for u in own]
            met[w] = parts[0] if len(parts) == 1 else tuple(b"".join(x) for x in zip(*parts))
            known.put(w, met[w])
        for words, own in zip(found, packed):
            each = [p or met[w] for w, p in zip(words, own)] if None in own else own
            surface = b"".join([e[1] for e in each])
            # decoding drops the word start that encoding put first
            out.append((b"".join([e[0] for e in each]), surface[1:] if surface[:1] == b" " else surface))
        return out

    def units_of(self, words: list[str]) -> dict[str, list[str]]:
        """The units of each word with the space before it."""
        # words without spaces are split in one go: each has one unit that leads with a word start
        plain = [w for w in words if w and " " not in w and SPACE not in w]
        found, own = [], None
        for unit in self.units.findall(SPACE + SPACE.join(plain)) if plain else ():
            if unit[0] == SPACE:
                own = [unit]
                found.append(own)
            else:
                own.append(unit)
        held = dict(zip(plain, found, strict=True))
        return {w: held[w] if w in held else self.units.findall(SPACE + w.replace(" ", SPACE)) for w in words}

    def ids_of(self, texts: list[bytes | None]) -> list:
        """Ids of each text as arrays, ends not included, by the library alone."""
        import numpy as np

        found = self.library.encode([text.decode("utf-8", "replace") if text else "" for text in texts], num_threads=1)
        return [np.array(ids, dtype="<u4") for ids in found]

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library decodes them; control ids have no text."""
        surface = b"".join(self.surfaces.get(i, b"") for i in ids)
        first = next((i for i in ids if i in self.surfaces), None)
        if first is not None and surface[:1] == b" " and self.surfaces[first][:1] == b" ":
            surface = surface[1:]
        text = surface.decode("utf-8", "surrogateescape")
        return re.sub("[\udc80-\udcff]", "�", text)


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The worker's vocabulary of a model, loaded once."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


OUTPUTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encoded(docs: DataFrame, model_path: str, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Adds the chosen ``outputs`` of encoding each whole text with begin and end ids.

    ``ids`` holds little-endian unsigned 32-bit integers; ``decoded`` is the
    text that decoding the ids gives.  Null counts as empty: begin and end
    only.  Rows stay where they are (no shuffle); repeated rows are encoded
    each; columns named like an output are replaced.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # the model file, as large as its vocabulary
    adds = T.StructType([OUTPUTS[name] for name in outputs])

    def work():
        vocab = vocabulary(shared.value)
        first, last = struct.pack("<I", vocab.begin), struct.pack("<I", vocab.end)

        def do(texts):
            columns = {name: [] for name in outputs}
            for ids, surface in vocab.encode_batch(texts):
                ids = first + ids + last
                for name, values in columns.items():
                    if name == "n_tokens":
                        values.append(len(ids) // 4)
                    elif name == "ids":
                        values.append(ids)
                    elif name == "ids_sha256":
                        values.append(hashlib.sha256(ids).hexdigest())
                    elif name == "decoded_sha256":
                        values.append(hashlib.sha256(surface).hexdigest())
                    else:
                        values.append(surface.decode())
            return list(columns.values())

        return do

    return mapped(docs, [text], adds, work)


def decoded(rows: DataFrame, model_path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds the text of packed ``ids`` (as :func:`encoded` gives them); null stays null."""
    with open(model_path, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    def work():
        vocab = vocabulary(shared.value)

        def do(packed):
            return [[p if p is None else vocab.decode(list(struct.unpack(f"<{len(p) // 4}I", p))) for p in packed]]

        return do

    return mapped(rows, [ids], T.StructType([T.StructField(output, T.StringType())]), work)
