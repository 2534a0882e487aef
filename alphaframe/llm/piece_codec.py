"""Merge-type subword encoding and decoding, exact, by backtracking.

Merging by priority gives the one split of a text whose neighbouring tokens all stay apart when
their joined text is merged again. So a text is read left to right by longest match (found for all
positions by one Aho-Corasick pass); a token is taken if it is compatible with the one before it,
else a shorter match is tried, else the last token is given up and its end marked as failed in a
bitfield. Pair checks are remembered, and so are the words of a text, in bounded memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import only

SPACE = "▁"
MEMO_WORDS = 1 << 18
MEMO_PAIRS = 1 << 20
SLICE = 256


class PieceCodec:
    """Encoder over a model's own pieces and scores; ``decode`` is the library's."""

    def __init__(self, model_file: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib, size = self.lib, self.lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.end = lib.eos_id()
        self.chars = {p for p in self.ids if len(p) == 1}
        self.bytes_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.joined = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        scores = sorted(self.scores.values())
        equal = {a for a, b in zip(scores, scores[1:]) if a == b}
        # Pieces of equal priority are told apart by position only; texts with them are merged directly.
        self.tied = {p for p, s in self.scores.items() if s in equal and len(p) > 1}
        # A piece that merging its own text does not give can never be a token.
        self.ids = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        self.matches = ahocorasick.Automaton()
        for p in self.ids:
            self.matches.add_word(p, len(p))
        self.matches.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """The definition: join the neighbours of highest score, leftmost first, until none is left."""
        if len(text) <= 64:
            return self._merge_short(text)
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < len(parts):
                both = parts[a] + parts[b]
                score = self.scores.get(both)
                if score is not None:
                    heapq.heappush(heap, (-score, a, both))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = right[a]
            if parts[a] is None or b >= len(parts) or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            if left[a] >= 0:
                offer(left[a])
            offer(a)
        return [p for p in parts if p is not None]

    def _merge_short(self, text: str) -> list[str]:
        parts, score, none = list(text), self.scores.get, float("-inf")
        rank = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank:
            best = max(rank)
            if best == none:
                break
            k = rank.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del rank[k]
            if k:
                rank[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(rank):
                rank[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def fits(self, pair: tuple[str, str]) -> bool:
        """Whether two neighbours stay apart when their joined text is merged again."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        a, b = pair
        known = self.pairs[pair] = a[-1] + b[0] not in self.joined or self.merge(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Tokens of a text each of whose characters is a piece."""
        n = len(text)
        lengths = [0] * n
        for end, size in self.matches.iter(text):
            lengths[end - size + 1] |= 1 << size
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        pos, options, before = 0, lengths[0], ""
        known, fits = self.pairs.get, self.fits
        while pos < n:
            if not options:  # nothing fits here: give up the last token
                failed[pos >> 3] |= 1 << (pos & 7)
                last = len(out.pop())
                before = out[-1] if out else ""
                pos -= last
                options = lengths[pos] & ((1 << last) - 1)
                continue
            size = options.bit_length() - 1
            end, piece = pos + size, text[pos:pos + size]
            good = not failed[end >> 3] >> (end & 7) & 1
            if good and before:
                good = known(pair := (before, piece))
                if good is None:
                    good = fits(pair)
            if good:
                out.append(piece)
                pos, before = end, piece
                options = lengths[pos] if pos < n else 0
            else:
                options ^= 1 << size
        return out

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of text."""
        ids = self.ids
        if text in ids:
            return (ids[text],)
        if self.chars.issuperset(text) and not any(p in text for p in self.tied):
            return tuple([ids[p] for p in self.backtrack(text)])
        # Cut where no piece holds both neighbours, so that unknown characters stand alone.
        out: list[int] = []
        start = 0
        for k in range(1, len(text) + 1):
            if k < len(text) and text[k - 1:k + 1] in self.joined:
                continue
            part, start = text[start:k], k
            if part in ids:
                out.append(ids[part])
            elif len(part) == 1:
                out.extend(self.bytes_ids[b] for b in part.encode())
            elif any(p in part for p in self.tied):
                out.extend(ids[p] for p in self.merge(part))
            else:
                out.extend(ids[p] for p in self.backtrack(part))
        return tuple(out)

    def _parted(self, text: str) -> tuple[int, ...]:
        """Like ``word``; a last mark that no piece joins to what is before it is taken by itself."""
        mark = text[-1]
        if len(text) > 2 and mark in self.chars and text[-2:] not in self.joined and not mark.isalpha():
            stem = text[:-1]
            got = self.words.get(stem) or self.older.get(stem)
            if got is None:
                got = self.words[stem] = self.word(stem)
            return (*got, self.ids[mark])
        return self.word(text)

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id included."""
        if not text:
            return [self.end]
        words = text.split(" ")
        if "" in words or SPACE in text:  # runs of spaces: pieces may hold several
            words = _stretches(SPACE + text.replace(" ", SPACE))
        else:
            words = [SPACE + w for w in words]
        memo = self.words
        found = list(map(memo.get, words))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    w = words[k]
                    got = memo.get(w)
                    if got is None:
                        got = self.older.get(w) or self._parted(w)
                        if len(w) <= 64:
                            memo[w] = got
                    found[k] = got
            if len(memo) >= MEMO_WORDS:
                self.older, self.words = memo, {}
        out = list(chain.from_iterable(found))
        out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def _stretches(text: str) -> list[str]:
    """Cut before each run of space marks that follows another character."""
    out, start = [], 0
    for k in range(1, len(text)):
        if text[k] == SPACE and text[k - 1] != SPACE:
            out.append(text[start:k])
            start = k
    out.append(text[start:])
    return out


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int, the end id last), decoded (text).

    A null text counts as empty and gives the end id alone. Texts may be of any length; they are
    taken whole. Rows that repeat, and null ids, are passed on as they come; an empty table gives
    an empty result, further columns are ignored. ``model_file`` must exist on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())],
                    names=["doc_id", "ids", "decoded"])

    kept = only(docs, doc_id=id_col, text=text_col)
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
