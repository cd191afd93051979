"""Token counts of whole texts without their ids: byte-pair merging with a heap over linked symbols.

A text falls into words, as no piece holds a blank behind another character. A word's symbols are
its characters, linked to their neighbours; a heap holds the adjacent pairs that make a piece, lowest
rank first, then leftmost. The first one is taken until none is left: each merge takes one from the
count. Symbols that are no piece count as the bytes of their characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLANK = "▁"
#: Words that a worker remembers, and the longest of them.
REMEMBER, SHORT = 200_000, 64


class TokenCounter:
    """Counts by a sentencepiece BPE model file: its pieces with their ranks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not odd(i)}
        if sp.normalize("Ａ ² ") != f"{BLANK}Ａ{BLANK}²{BLANK}" or not any(map(sp.is_byte, range(sp.get_piece_size()))):
            raise ValueError("only models with identity normalisation, a dummy prefix and byte fallback are handled")
        if any(BLANK in p.lstrip(BLANK) for p in score):
            raise ValueError("pieces that span words are not handled")
        self.rank = {p: -s for p, s in score.items()}
        # runs of blanks belong to the word behind them; a line end that no piece holds is a word of its own, of one byte
        self.lines = int(not any("\n" in p for p in score))
        self.cut = re.compile(r" +[^ \n]*|[^ \n]+" if self.lines else " +[^ ]*")
        self.known: dict[str, int] = {}

    def _cost(self, symbol: str) -> int:
        return 1 if symbol in self.rank else len(symbol.encode("utf-8", "replace"))

    def word(self, word: str) -> int:
        """The tokens of one escaped word."""
        rank, piece = self.rank, list(word)
        n = len(piece)
        count = sum(map(cost := self._cost, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[pair], i, pair) for i, pair in enumerate(map(str.__add__, piece, piece[1:])) if pair in rank]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if not piece[i] or j == n or piece[i] + piece[j] != pair:
                continue  # one of both has merged since
            count += 1 - cost(piece[i]) - cost(piece[j])
            piece[i], piece[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + piece[k]
                if new in rank:
                    heappush(heap, (rank[new], i, new))
            k = before[i]
            if k >= 0:
                new = piece[k] + pair
                if new in rank:
                    heappush(heap, (rank[new], k, new))
        return count

    def text(self, text: str) -> int:
        """The tokens of a whole text; none for an empty one."""
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        words, total = self.cut.findall(" " + text), text.count("\n") * self.lines
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(w.replace(" ", BLANK))
                if len(w) <= SHORT:
                    known[w] = n
            total += n
        return total


@lru_cache(1)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes long, n_tokens long) of every row: the whole text's UTF-8 bytes and its tokens without begin and end.

    The model's special strings are ordinary text, as in its library. Null and empty texts have
    none of both. Rows that repeat are counted alike; an empty table gives no rows; other columns are
    ignored. path names the model file; executors read it from their own Python installation or a
    shared folder.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for batch in batches:
            tokens = [count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col(id_col), n_bytes, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
