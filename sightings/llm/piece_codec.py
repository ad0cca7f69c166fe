"""Operator 5: encoding with a merge-type piece vocabulary by a score-ordered agenda, checked against sentencepiece.

The agenda holds the adjacent symbol pairs whose join is a piece, best score first and the leftmost of equal ones;
joining a pair puts its two new neighbours on the agenda.  Symbols that are no piece fall back to bytes.  No piece
of the vocabulary goes on past the end of a word (a space mark after another character) or over a line break, so a
normalised text is cut there and each segment is merged once and remembered; a vocabulary that does have such
pieces is merged over whole texts.  Every segment that is merged is compared with the library's answer in the same
Arrow batch; a text with a segment that differs gets the library's ids, and the difference is counted and reported.
Normalising and decoding are the library's.

Defined cases: a null text is empty, which is the begin and the end id and decodes to the empty text.
"""

from __future__ import annotations

import heapq
import logging
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.chunk_tokens import UINT32, Memo, slices
from sightings.llm.common import documents, frames, plain_texts

MARK = "▁"  # stands for a space in pieces
_SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_CUT = "\x00"


class PieceCodec:
    """One vocabulary: encode texts by the agenda, decode with the library."""

    def __init__(self, path: str, generation: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        merged = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.pieces = {lib.id_to_piece(i): (i, lib.get_score(i)) for i in merged}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(size) if lib.is_byte(i)}
        joined = [p for p in self.pieces if len(p) > 1]
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in joined) and len(self.bytes) == 256
        self.memo = Memo(generation)
        self.differences = 0
        self.begin, self.end = array(UINT32, [lib.bos_id()]).tobytes(), array(UINT32, [lib.eos_id()]).tobytes()
        self.before = array(UINT32, lib.encode("\n")).tobytes()

    def merge(self, segment: str) -> list[int]:
        """The ids of one normalised segment."""
        pieces = self.pieces
        symbols: list[str | None] = list(segment)
        left = list(range(-1, len(symbols) - 1))
        right = [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(len(symbols) - 1):
            if found := pieces.get(pair := symbols[i] + symbols[i + 1]):
                agenda.append((-found[1], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been joined with something else since
            symbols[i], symbols[j] = pair, None
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
                if found := pieces.get(new := pair + symbols[after]):
                    heapq.heappush(agenda, (-found[1], i, after, new))
            if (before := left[i]) >= 0:
                if found := pieces.get(new := symbols[before] + pair):
                    heapq.heappush(agenda, (-found[1], before, i, new))
        ids: list[int] = []
        for symbol in symbols:
            if symbol is not None:
                if found := pieces.get(symbol):
                    ids.append(found[0])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in symbol.encode("utf-8"))
                else:
                    ids.append(self.library.unk_id())
        return ids

    def segments(self, text: str) -> list[str]:
        """The normalised text in parts that no piece crosses."""
        normal = self.library.normalize(text)
        if not self.cuts:
            return [normal]
        if MARK + MARK in normal or MARK + "\n" in normal or _CUT in normal:
            return _SEGMENT.findall(normal)
        return normal.replace(MARK, _CUT + MARK).replace("\n", _CUT + "\n" + _CUT).split(_CUT)

    def _differing(self, segments: list[str], ids: dict[str, bytes], texts: Sequence[str]) -> set[str]:
        """Segments that the library encodes otherwise: a line break before one takes the mark that it puts before every text."""
        if self.cuts:
            told = self.library.encode(["\n" + s.replace(MARK, " ") for s in segments])
            return {s for s, x in zip(segments, told, strict=True) if self.before + ids[s] != array(UINT32, x).tobytes()}
        told = self.library.encode(list(texts))
        own = [self.segments(text)[0] for text in texts]
        return {s for s, x in zip(own, told, strict=True) if s in ids and ids[s] != array(UINT32, x).tobytes()}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Begin id, ids and end id of every text, as little-endian unsigned 32-bit integers.

        A text with a segment that differs from the library gets the library's ids; such texts are counted and reported.
        """
        for some in slices(texts):
            lists = [self.segments(text) for text in some]
            wanted: set[str] = set()
            for segments in lists:
                wanted.update(segments)
            known, missing = self.memo.split(wanted)
            fresh = {s: array(UINT32, self.merge(s)).tobytes() for s in missing}
            wrong = self._differing([s for s in missing if s], fresh, some)
            self.memo.add({s: x for s, x in fresh.items() if s not in wrong} if wrong else fresh)
            known |= fresh
            get = known.__getitem__
            for text, segments in zip(some, lists, strict=True):
                if wrong and not wrong.isdisjoint(segments):
                    self.differences += 1
                    logging.getLogger(__name__).warning("a text of %d characters is encoded otherwise by the library, whose ids are taken", len(text))
                    yield self.begin + array(UINT32, self.library.encode(text)).tobytes() + self.end
                else:
                    yield self.begin + b"".join(map(get, segments)) + self.end

    def decode(self, ids: Sequence[bytes]) -> list[str]:
        lists = []
        for one in ids:
            numbers = array(UINT32)
            numbers.frombytes(one)
            lists.append(numbers.tolist())
        return self.library.decode(lists) if lists else []


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each Python worker, kept between tasks."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _rows(batches: Iterator[pd.Series], path: str) -> Iterator[tuple[int, str, str]]:
    for some in slices(plain_texts(batches)):
        ids = list(codec(path).encode(some))
        for one, decoded in zip(ids, codec(path).decode(ids), strict=True):
            yield len(one) // 4, sha256(one).hexdigest(), sha256(decoded.encode("utf-8")).hexdigest()


def encode(text: Column, path: str) -> Column:
    """Begin id, ids and end id of a text column, as bytes of little-endian unsigned 32-bit integers."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = ((x,) for x in codec(path).encode(plain_texts(batches)))
        return (frame["ids"] for frame in frames(ids, ["ids"]))

    return F.pandas_udf(of, "binary")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of a column that encode() made; null as no ids."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series(codec(path).decode([x or b"" for x in some]), dtype="object")

    return F.pandas_udf(of, "string")(ids)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id with count and digests of its ids and of what they decode to; ids never leave the task."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return frames(_rows(batches, path), ["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.pandas_udf(of, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")(F.col("text"))
    return docs.select("doc_id", made.alias("made")).select("doc_id", "made.*")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
