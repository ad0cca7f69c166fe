"""Whole texts to token ids: a public tokenizer is asked once per chunk of text, not once per occurrence.

Both BPE files split a text before they merge, and no token crosses from a non-space character to white space.
Nor does one cross from a letter to punctuation.  A text can therefore be cut before every run of white space and
between a letter and an ASCII mark, and each chunk encoded alone: the ids of the chunks in a row are the ids of the
text.  Chunks repeat as words do, so a bounded memo answers most of them.

Texts stay Arrow buffers: the cuts are found over their bytes, Arrow numbers the different chunks of some texts, and
the ids of all chunks are gathered by these numbers.  Only a different chunk is a Python object, once for some texts.

The files' added tokens, such as an end-of-text mark, have one id where a text spells them; they hold none of the
places where texts are cut, so that a chunk has them whole and the library cuts the chunk at them.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Unicode White_Space, spelt out so that it does not depend on a library's idea of white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
UINT32 = "I"  # array type of an id; four bytes, little-endian on every platform that Spark runs on
# one word for both files' patterns: a space or none, letters of Latin-1
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# Bytes of texts: 1 white space of one byte, 2 perhaps the first byte of a longer one.
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in WHITE if c < "\x80"]] = 1
_LONG_WHITE = [c.encode() for c in WHITE if c >= "\x80"]
_KIND[[c[0] for c in _LONG_WHITE]] = 2
# ASCII punctuation; not what added tokens have behind a letter
_MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(_MARKS.encode())] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
# Bytes of texts whose different chunks are looked up at once, about, and chunks whose ids are gathered at once.
RUN, CHUNKS = 8_000_000, 1 << 20


class Memo:
    """A dictionary of two generations; the older one goes when the younger is full."""

    def __init__(self, generation: int):
        self.generation, self.young, self.old = generation, {}, {}

    def split(self, keys: set[str]) -> tuple[dict, list[str]]:
        """What is known of the keys, and the keys that are not."""
        young, old = self.young, self.old
        hits = keys & young.keys()
        known = dict(zip(hits, map(young.__getitem__, hits), strict=True))
        rest = keys - hits
        again = rest & old.keys()
        if again:
            found = dict(zip(again, map(old.__getitem__, again), strict=True))
            young.update(found)
            known.update(found)
            rest -= again
        return known, list(rest)

    def recall(self, keys: list) -> list:
        """What is known of each key, or None."""
        found = list(map(self.young.get, keys))
        if self.old:
            again = {keys[k]: x for k, v in enumerate(found) if v is None and (x := self.old.get(keys[k])) is not None}
            if again:
                self.young.update(again)
                found = list(map(self.young.get, keys))
        return found

    def add(self, values: dict) -> None:
        self.young.update(values)
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}


CHARS = 5_000_000


def slices(texts: Iterable[str], chars: int = CHARS) -> Iterator[list[str]]:
    """Runs of whole texts of about so many characters: the memo is asked for a run at once, its lists stay small."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def texts_of(batches: Iterator[pa.RecordBatch], doc_ids: deque[int | None], size: int = RUN) -> Iterator[pa.Array]:
    """The texts of (doc_id, text), null as empty, in runs of about so many bytes; their ids wait in the queue."""
    held, many = [], 0
    for batch in batches:
        doc_ids.extend(batch.column(0).to_pylist())
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        ends = _buffers(texts)[1][1:]
        row = 0
        while row < len(texts):
            begun = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, begun + size - many, "right")))
            held.append(texts.slice(row, stop - row))
            many += int(ends[stop - 1]) - begun
            row = stop
            if many >= size or row < len(texts):
                yield pa.concat_arrays(held)
                held, many = [], 0
    if held:
        yield pa.concat_arrays(held)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings without nulls, and where each begins and the last ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are of white space."""
    kind = _KIND[data]
    white = kind == 1
    first = np.flatnonzero(kind == 2)
    if len(first):
        follow = np.pad(data, (0, 2))
        for c in _LONG_WHITE:
            found = first[np.all([follow[first + k] == byte for k, byte in enumerate(c)], axis=0)]
            for k in range(len(c)):
                white[found + k] = True
    return white


class ChunkEncoder:
    """The ``tokenizers`` library behind a memo of chunks.

    ``drops_space``: the file lower-cases and drops white space; otherwise it is a byte-level file that keeps all.
    """

    def __init__(self, path: str, drops_space: bool, generation: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or set(t.content) & set(WHITE + _MARKS) for t in added):
            raise ValueError(f"{path}: an added token that a cut could divide")
        self.added = [t.content.lower().encode() for t in added]
        self.drops_space = drops_space
        self.memo = Memo(generation)
        # how the library spells a space and the letters of Latin-1 before it merges
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {n: spell.pre_tokenize_str(chr(n))[0][0] for n in (0x20, *range(0xC0, 0x100))}

    def chunks(self, data: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The chunks of texts that begin (and the last ends) at the given bytes, and where each text's chunks begin."""
        white = white_space(data)
        first = np.zeros(len(data) + 1, bool)
        np.greater(white[1:], white[:-1], out=first[1:-1])
        first[begins] = True
        if not self.drops_space:  # a line feed alone is a token's end, unlike a space
            first[1:-1] |= first[:-2] & (data[:-1] == 10) & ~white[1:]
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        first[1:-1] |= letter[:-1] & _MARK[data[1:]]
        at = np.flatnonzero(first[:-1])
        of_texts = np.searchsorted(at, begins)
        if self.drops_space:
            kept = ~white
            at = np.cumsum(kept, dtype=np.int64)[at] - kept[at]
            data = self._lower(data)[kept]
        ends = np.append(at, len(data))
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]), of_texts

    def _lower(self, data: np.ndarray) -> np.ndarray:
        """Capital letters before ASCII characters are lower-cased; others, which may compose, are left to the library."""
        capital = data - np.uint8(65) < 26
        capital[:-1] &= data[1:] < 0x80
        lower = data + 32 * capital.astype(np.uint8)
        text = lower.tobytes()
        for token in self.added:  # only texts that spell it as it is have the token
            at = text.find(token)
            while at >= 0:
                lower[at : at + len(token)] = data[at : at + len(token)]
                at = text.find(token, at + 1)
        return lower

    def _library(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks by the library; a word of letters goes straight to its merges."""
        merge, spelling, lower, is_word = self.tokenizer.model.tokenize, self.spelling, self.drops_space, _LETTERS.fullmatch
        # one list for the ids of all chunks: a list for each would keep the garbage collector busy
        flat, ends, order, other = [], [], [], []
        for chunk in chunks:
            if chunk.isalpha():
                word = chunk.decode("ascii").lower() if lower else chunk.decode("ascii")
            elif is_word(chunk):
                word = (chunk.decode().lower() if lower else chunk.decode()).translate(spelling)
            else:
                other.append(chunk)
                continue
            flat += [x.id for x in merge(word)]
            ends.append(len(flat))
            order.append(chunk)
        for begin in range(0, len(other), 256):
            part = other[begin : begin + 256]
            for x in self.tokenizer.encode_batch_fast([chunk.decode() for chunk in part], add_special_tokens=False):
                flat += x.ids
                ends.append(len(flat))
        data = np.array(flat, "<u4").tobytes()
        ends = [4 * end for end in ends]
        return {chunk: data[a:b] for chunk, a, b in zip(order + other, [0, *ends], ends, strict=False)}

    def _learn(self, missing: list[bytes]) -> list[bytes]:
        """Ids of unknown chunks, which the memo keeps."""
        fresh = self._library(missing)
        self.memo.add(fresh)
        return list(map(fresh.__getitem__, missing))

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        numbered = chunks.dictionary_encode()
        different = numbered.dictionary.to_pylist()
        ids = self.memo.recall(different)
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            for k, x in zip(missing, self._learn([different[k] for k in missing]), strict=True):
                ids[k] = x
        many = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(many) - many
        at = numbered.indices.to_numpy()
        many = many[at]
        ends = np.cumsum(many)
        places = np.repeat(begins[at] - (ends - many), many)
        places += np.arange(len(places))
        return np.frombuffer(b"".join(ids), "<u4")[places], many

    def encode_arrays(self, runs: Iterable[pa.Array]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every text of some arrays, in order."""
        for texts in runs:
            chunks, of_texts = self.chunks(*_buffers(texts.cast(pa.large_string())))
            found = [self._ids(chunks.slice(k, CHUNKS)) for k in range(0, len(chunks), CHUNKS)]
            ids = b"".join(x.tobytes() for x, _ in found)
            ends = np.cumsum(np.concatenate([[0], *(many for _, many in found)]), dtype=np.int64)[of_texts] * 4
            for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield ids[begin:end]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every text, in order."""
        return self.encode_arrays(pa.array(some, pa.large_string()) for some in slices(texts))


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, drops_space: bool) -> ChunkEncoder:
    """One encoder for each Python worker, kept between tasks."""
    key = path, drops_space
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, drops_space)
    return _ENCODERS[key]
