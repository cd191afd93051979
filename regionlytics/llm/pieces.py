"""SentencePiece encoding and decoding of whole texts, as vectorised merge rounds.

The text is escaped as the model asks (a blank becomes U+2581, one more in front) and falls into
words, since no piece holds U+2581 behind another character. The words that a batch has not seen
yet are laid out as one flat array of symbols. A round looks up the rank of each neighbouring pair,
takes the smallest rank of each word by a segmented minimum, merges its leftmost occurrence - or
all of its occurrences from the left, where that can be proven to be the same - in all words at
once, and compacts the array; words without a pair leave. In a long word the minimum is taken over
the stretch that could still reach a pair before its turn, so that its parts merge side by side.
Characters without a piece become bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: Words that a worker remembers; about 40 MB.
REMEMBER = 200_000
#: From so many characters on a word is long; long words are not remembered.
LONG = 64
#: With so many pairs of one shared rank left, they are merged in one pass.
FEW = 16
ROWS = 128


class PieceModel:
    """The tables of a BPE model file: pieces and byte pieces, and with ``pairs`` the ranks of pairs, which encoding needs."""

    def __init__(self, path: str, pairs: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.unknown = sp.unk_id()
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = np.full(256, self.unknown, np.int64)
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        if sp.normalize("Ａ ² ") != f"{SPACE}Ａ{SPACE}²{SPACE}" or (sp.encode("͸") and not self.byte_of):
            raise ValueError("only models with identity normalisation, a dummy prefix and byte fallback are handled")
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if sp.is_control(i) else " ⁇ ".encode() if i == self.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        if pairs:
            self._rank_pairs(special, np.array([sp.get_score(i) for i in range(n)]))

    def _rank_pairs(self, special: set[int], score: np.ndarray) -> None:
        n = len(self.pieces)
        self.kind = np.dtype("<u2" if n < 1 << 16 else "<u4")
        normal = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.byte_of}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that span words are not handled")
        levels = {s: r for r, s in enumerate(sorted({score[i] for i in normal.values()}, reverse=True))}
        self.rank = np.full(n, NEVER, np.int32)
        for i in normal.values():
            self.rank[i] = levels[score[i]]
        # Symbols are piece ids; characters that occur inside pieces without being one get ids behind them.
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.width = max(symbols.values()) + 1
        self.extra = {i: ord(s) for s, i in symbols.items() if i >= n}
        pairs, tied, sizes = {}, set(), np.bincount(self.rank[list(normal.values())])
        for p, i in normal.items():
            if sizes[self.rank[i]] > 1:
                tied.add(i)
            for at in range(1, len(p)):
                a, b = symbols.get(p[:at]), symbols.get(p[at:])
                if a is None or b is None:
                    continue
                pairs[a * self.width + b] = i
                # merging on with a or b could come before their other occurrences
                tied.update(x for x in (a, b) if x < n and self.rank[i] <= self.rank[x])
        # Open addressing with linear probing: key and merged piece by slot, at most a quarter full.
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        value, at = np.fromiter(pairs.values(), np.int64, len(pairs)), self._slot(keys)
        keys_of, value_of = keys, value
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for a slot the last one gets it
            placed = self.keys[at] == keys
            self.merged[at[placed]] = value[placed]
            keys, value, at = keys[~placed], value[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
        self.single = np.zeros(n, bool)  # of these, one occurrence is merged at a time
        self.single[list(tied)] = True
        self.tie = np.zeros(n, bool)  # several pieces share the score
        self.tie[[i for i in normal.values() if sizes[self.rank[i]] > 1]] = True
        self._reaches(keys_of, value_of, normal)

    def _reaches(self, keys: np.ndarray, value: np.ndarray, normal: dict[str, int]) -> None:
        """For each symbol and bound on ranks: the most characters of a piece that takes the symbol from its left, or right, in a pair below the bound."""
        self.longest = max(map(len, normal))
        size = np.ones(self.width, np.int64)  # symbols that are no pieces are characters
        for p, i in normal.items():
            size[i] = len(p)
        rank, left, right = self.rank[value], keys // self.width, keys % self.width
        self.bounds = np.r_[[1 << b for b in range(4, 31, 2) if 1 << b <= rank.max()], NEVER]
        self.reach = np.zeros((2, len(self.bounds), self.width + 1), np.int64)
        for b, bound in enumerate(self.bounds.tolist()):
            low = rank < bound
            np.maximum.at(self.reach[0, b], right[low], size[left[low]])
            np.maximum.at(self.reach[1, b], left[low], size[right[low]])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that symbols a and b make; -1 where there is none."""
        out = np.full(len(a), -1, np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo] * self.width + b[todo]
        at = self._slot(key)
        while len(todo):
            found = self.keys[at]
            hit = found == key
            out[todo[hit]] = self.merged[at[hit]]
            on = ~hit & (found >= 0)
            todo, key, at = todo[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.char[code].astype(np.int64)
        return np.where(sym < 0, -1 - code, sym)

    def _wakes(self, sym: np.ndarray, part: np.ndarray, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the piece that the pair at ``at`` makes has, with a neighbour or with itself, a pair of no higher rank."""
        if not len(at):
            return np.zeros(0, bool)
        last, own = len(sym) - 1, self.rank[piece]
        low = lambda p: np.where(p >= 0, self.rank[p], NEVER) <= own
        out = self.tie[piece] | low(self._pairs(piece, piece))
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        out |= low(self._pairs(sym[before], piece)) & (part[before] == part[at])
        return out | low(self._pairs(piece, sym[after])) & (part[after] == part[at])

    def _sweep(self, sym: np.ndarray, part: np.ndarray, pair: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The symbols after all merges of one rank, which several pieces share, and the places of those that stay; None if a smaller rank comes up.

        Of pairs of one rank the leftmost merges first, so one pass from the left does: what lies
        behind it has no pair of that rank, and a merge is followed by that with the symbol before.
        """
        known: dict[tuple[int, int], int] = {}

        def made(a: int, b: int) -> int:
            if (a, b) not in known:
                p = int(self._pairs(np.array([a]), np.array([b]))[0])
                known[a, b] = -1 if p < 0 or self.rank[p] > level else p if self.rank[p] == level else -2
            return known[a, b]

        out, at, new = [], [], False
        joint = np.r_[False, part[1:] == part[:-1]].tolist()
        open_ = np.r_[False, pair[:-1] >= 0].tolist()  # there is a pair with the symbol before
        apart: list[bool] = []  # whether a symbol of out begins a word
        for i, s in enumerate(sym.tolist()):
            p = made(out[-1], s) if joint[i] and (new or open_[i]) else -1
            if p == -1:
                new = False
                out.append(s)
                at.append(i)
                apart.append(not joint[i])
                continue
            while p >= 0:
                out[-1], new = p, True
                p = -1 if apart[-1] or len(out) < 2 else made(out[-2], out[-1])
                if p >= 0:
                    out.pop()
                    at.pop()
                    apart.pop()
            if p == -2:
                return None
        return np.array(out, np.int64), np.array(at)

    def _merge_long(self, sym: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of long words, in one array by part, after all merges, and the places where they start.

        A pair may merge before its turn if nothing can take its left symbol from the left, or its
        right one from the right, any earlier. A symbol that does so grows within its reach, by pairs
        that are there now; so it is enough that no pair within reach has a smaller rank. Parts in
        which nothing is left to merge leave the array.
        """
        place, inner = np.arange(len(sym)), np.flatnonzero(part[1:] == part[:-1])
        pair = np.full(len(sym), -1, np.int64)
        pair[inner] = self._pairs(sym[inner], sym[inner + 1])
        final: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0
        while True:
            rank = np.where(pair >= 0, self.rank[pair], NEVER)
            live = np.flatnonzero(rank < NEVER)
            if not len(live):
                break
            turn += 1
            level = rank[live[0]]
            if len(live) > FEW and self.tie[pair[live]].all() and (rank[live] == level).all() and (swept := self._sweep(sym, part, pair, level)) is not None:
                sym, keep = swept
                part, place = part[keep], place[keep]
                inner = np.flatnonzero(part[1:] == part[:-1])
                pair = np.full(len(sym), -1, np.int64)
                pair[inner] = self._pairs(sym[inner], sym[inner + 1])
                continue
            if turn % 4 == 0:
                edge = np.zeros(len(sym) + 1, np.int64)
                np.add.at(edge, np.maximum(live - self.longest, 0), 1)
                np.add.at(edge, np.minimum(live + 2 + self.longest, len(sym)), -1)
                near = np.cumsum(edge[:-1]) > 0
                if 2 * np.count_nonzero(near) < len(sym):
                    final.append((place[~near], sym[~near]))
                    part = np.cumsum(near & ~np.r_[False, near[:-1] & (part[1:] == part[:-1])])
                    sym, pair, place, part = sym[near], pair[near], place[near], part[near]
                    pair[np.flatnonzero(part[1:] != part[:-1])] = -1
                    continue
            own = rank[live]
            bound = np.searchsorted(self.bounds, own, "right")
            # of equal pairs the left one is first; that matters to the others only if its piece makes a smaller rank
            order_of = 2 * rank.astype(np.int64)
            odd = live[self.single[pair[live]]]
            order_of[odd[self._wakes(sym, part, pair[odd], odd)]] -= 1
            pad = np.full(self.longest, 2 * NEVER, np.int64)
            table = [np.r_[pad, order_of, pad]]
            while 2 << (len(table) - 1) <= self.longest:
                table.append(np.minimum(table[-1][: -(1 << len(table) - 1)], table[-1][1 << len(table) - 1 :]))

            def least(first: np.ndarray, count: np.ndarray) -> np.ndarray:
                """The least order of count pairs from first on."""
                out, level = np.full(len(first), 2 * NEVER, np.int64), np.frexp(count)[1] - 1
                for j, t in enumerate(table):
                    q = np.flatnonzero(level == j)
                    at = first[q] + len(pad)
                    out[q] = np.minimum(t[at], t[at + count[q] - (1 << j)])
                return out

            symbol = np.where(sym < 0, self.width, sym)
            k = self.reach[0, bound, symbol[live]]
            before = least(live - k, k)
            after = least(live + 1, self.reach[1, bound, symbol[live + 1]])
            free = (own <= (after + 1) // 2) & (2 * own.astype(np.int64) <= before)
            # of a chain of overlapping occurrences, what stands before the first that must wait
            start = np.r_[True, (live[1:] != live[:-1] + 1) | (own[1:] != own[:-1])]
            link = np.cumsum(start) - 1
            begin = np.flatnonzero(start)
            stuck = np.minimum.reduceat(np.where(free, len(live), np.arange(len(live))), begin)
            order = np.arange(len(live))
            free &= (order < stuck[link]) & ((order - begin[link]) % 2 == 0)
            at = live[free]
            sym[at] = pair[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            pair[at] = -2
            at = np.cumsum(keep)[at] - 1
            sym, part, place, pair = sym[keep], part[keep], place[keep], pair[keep]
            pair[at[at > 0] - 1] = -2
            look = np.flatnonzero(pair == -2)
            after = np.minimum(look + 1, len(sym) - 1)
            same = (part[look] == part[after]) & (after > look)
            pair[look] = -1
            pair[look[same]] = self._pairs(sym[look[same]], sym[after[same]])
        final.append((place, sym))
        place, sym = (np.concatenate(x) for x in zip(*final, strict=True))
        order = np.argsort(place)
        return sym[order], place[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each escaped word, as the bytes of whole numbers of ``kind``."""
        out = [b""] * len(words)
        if many := [i for i, w in enumerate(words) if len(w) >= LONG]:
            ends = np.cumsum([0, *(len(words[i]) for i in many)])
            sym, place = self._merge_long(self._symbols("".join(words[i] for i in many)), np.repeat(many, np.diff(ends)))
            self._emit(out, sym, many, np.searchsorted(place, ends))
        rest = [i for i, w in enumerate(words) if len(w) < LONG]
        sym = self._symbols("".join(words[i] for i in rest))
        word = np.repeat(np.array(rest, np.int64), [len(words[i]) for i in rest])
        pair = np.full(len(sym), -1, np.int64)  # the piece that a symbol makes with the next one of its word
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self._pairs(sym[inner], sym[inner + 1])
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], NEVER)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            done = low == NEVER
            if done.any():
                stay = np.repeat(~done, length)
                self._emit(out, sym[~stay], word[first[done]].tolist(), np.cumsum(np.r_[0, length[done]]))
                sym, word, pair, rank = sym[stay], word[stay], pair[stay], rank[stay]
                low, length = low[~done], length[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, length))
            # every other one of a chain of overlapping occurrences, from its left end
            start = np.r_[True, at[1:] != at[:-1] + 1]
            place = at - at[start][np.cumsum(start) - 1]
            one = self.single[pair[at]]
            if one.any():
                # a word with any such piece merges its leftmost occurrence only
                leftmost = np.r_[True, word[at[1:]] != word[at[:-1]]]
                cautious = np.zeros(int(word[-1]) + 1, bool)
                cautious[word[at[one]]] = True
                at = at[np.where(cautious[word[at]], leftmost, place % 2 == 0)]
            else:
                at = at[place % 2 == 0]
            sym[at] = pair[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            pair[at] = -2  # to be looked up, as is the pair before
            at = np.cumsum(keep)[at] - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            before = at[at > 0] - 1
            pair[before] = -2
            look = np.flatnonzero(pair == -2)
            after = np.minimum(look + 1, len(sym) - 1)
            same = (word[look] == word[after]) & (after > look)
            pair[look] = -1
            pair[look[same]] = self._pairs(sym[look[same]], sym[after[same]])
        return out

    def _emit(self, out: list[bytes], sym: np.ndarray, words: list[int], ends: np.ndarray) -> None:
        """Puts finished words' ids into out; characters without a piece become bytes here."""
        plain = (sym >= 0) & (sym < len(self.pieces))
        if not plain.all():
            size = np.ones(len(sym), np.int64)
            odd = [self._bytes(i) for i in sym[~plain].tolist()]
            size[~plain] = [len(x) for x in odd]
            place = np.r_[0, np.cumsum(size)]
            flat = np.zeros(place[-1], np.int64)
            flat[place[:-1][plain]] = sym[plain]
            for at, ids in zip(place[:-1][~plain].tolist(), odd, strict=True):
                flat[at : at + len(ids)] = ids
            sym, ends = flat, place[ends]
        data, at = sym.astype(self.kind).tobytes(), (ends * self.kind.itemsize).tolist()
        for w, a, z in zip(words, at[:-1], at[1:], strict=True):
            out[w] = data[a:z]

    def _bytes(self, i: int) -> list[int]:
        c = chr(-1 - i if i < 0 else self.extra[i])
        return self.byte_id[list(c.encode("utf-8", "replace"))].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        ids = list(ids)
        data = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            parts: list[str] = []
            run = bytearray()
            for i in [*ids, -1]:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                at = 0
                while at < len(run):
                    for n in (1, 2, 3, 4):
                        try:
                            parts.append(bytes(run[at : at + n]).decode())
                            at += n
                            break
                        except UnicodeDecodeError:
                            pass
                    else:
                        parts.append("�")
                        at += 1
                run.clear()
                if i >= 0:
                    parts.append(self.raw[i].decode())
            text = "".join(parts)
        return text[1:] if text.startswith(" ") and ids and self.pieces[ids[0]].startswith(SPACE) else text


class Encoder:
    """Encodes texts word by word, remembering words."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}
        self.breaks = bool(model.char[10] < 0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split: list[list[str]] = []
        for t in texts:
            t = t.replace(SPACE, " ")
            if not t:
                split.append([])
            elif "  " in t or t[0] == " " or t[-1] == " " or self.breaks and (" \n" in t or "\n " in t or t[0] == "\n"):
                # runs of blanks belong to the word behind them
                split.append(re.findall(r" +[^ ]*", " " + t))
            elif self.breaks:
                # a word is cut before a line end, which no piece spans
                split.append(t.replace("\n", " \n").split(" "))
            else:
                split.append(t.split(" "))
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        if new:
            self.known.update(zip(new, self.model.encode_words([self._escaped(w) for w in new]), strict=True))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), self.model.kind) for words in split]
        for w in new:
            if len(w) >= LONG:
                del self.known[w]
        return out

    @staticmethod
    def _escaped(w: str) -> str:
        """A word that starts with blanks holds its own; one that starts with a line end has none; others get theirs."""
        return w.replace(" ", SPACE) if w[:1] == " " or w[:1] == "\n" else SPACE + w


@lru_cache(1)
def decoder(path: str) -> PieceModel:
    return PieceModel(path, pairs=False)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(PieceModel(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row, the whole text, without begin and end ids.

    Null and empty texts have no ids. Rows that repeat are encoded alike; other columns are ignored.
    path names the model file; executors read it from their own Python installation or a shared folder.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, text) of every row of encoded (id_col, ids); null ids give an empty text."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [m.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    return encoded.select(F.col(id_col), F.col("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, text): decode(encode(docs)) in one pass of the Python workers."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                texts = pa.array([enc.model.decode(x.tolist()) for x in ids], pa.string())
                ends = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), texts], names=[id_col, "ids", "text"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")


def ids_digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")).cast("binary"), 256)
