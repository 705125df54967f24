"""Whole-text token ids from the ``tokenizers`` library, each distinct word encoded once per Python worker.

Both public vocabularies split a text at white space before they merge, so the ids of a text are the ids of its
white-space-delimited chunks, one after the other. The chunks of a text are looked up in a bounded per-worker cache, and
the library encodes those that are missing. A text that holds any character for which libraries disagree on what white
space is, or a special token's string, is handed to the library whole. Results equal ``encode(text,
add_special_tokens=False)`` with special tokens read as ordinary text.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: White space on which all agree is \t \n \v \f \r and blank; a text with any other candidate takes the slow way.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<\\|")
#: The same for Arrow's matcher, which wants its own notation.
_SLOW_WORD = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]|<\|"
_SLOW_BYTE = r"[\t-\r ] |" + _SLOW_WORD
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of letters that white space, ASCII punctuation, a digit or the end follows is a piece of its own in both.
_RUN = f"[{_LETTERS}]++(?=[\t-\r -@\\[-`{{-~]|$)"
#: byte level: one blank belongs to the word that follows it; a longer run leaves its last character to that word.
_BYTE_CHUNKS = re.compile(f" ?{_RUN}| ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")
#: A unit of two pieces, for Arrow's matcher: letters (and the blank before them), and what follows from a sign or digit on.
_TWO = f"(?s)^(?P<head> ?[{_LETTERS}]+)(?P<tail>[\t-\r -@\\[-`{{-~].*)$"
#: word level: white space separates and is dropped.
_WORD_CHUNKS = re.compile(f"{_RUN}|[^\t-\r ]+")
#: Entries kept per worker (about 120 MB) unless fewer are asked for; a full cache drops its long words, which costs time and changes nothing else.
CACHE_ENTRIES = 600_000

#: Characters up to which a word outlives a full cache, about: short ones come again.
_SHORT = 10

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """``ids(texts)`` gives for each text its ids as little-endian unsigned 32-bit integers, as bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.marks = np.zeros(max(vocab.values()) + 1, bool)
        if self.tokenizer.normalizer is None:  # a word's first piece has the blank, its last one the word's end
            self.chunks, self.first, self.glue = _BYTE_CHUNKS.findall, True, ""
            self.plain = re.compile(f" [{_LETTERS}]+").fullmatch
            self.bare, self.feed = re.compile(f"[{_LETTERS}]+").fullmatch, vocab["Ċ"]
            self.marks[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        else:
            self.chunks, self.first, self.glue = _WORD_CHUNKS.findall, False, " "
            self.plain = re.compile(f"[{_LETTERS}]+").fullmatch
            self.marks[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.limit = CACHE_ENTRIES

    def encode(self, texts: list[str]) -> list[bytes]:
        """The library's answer for each text."""
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], glue: str) -> None:
        """Encode words in long lines, cut where the vocabulary marks words; a line that doesn't cut evenly, word by word."""
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            lines = [glue.join(part[j : j + 200]) + "\n" * (glue == "\n") for j in range(0, len(part), 200)]
            ids = np.asarray([x for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], "<u4")
            if glue == "\n":  # a line feed's own id ends each word
                ends = np.flatnonzero(ids == self.feed)
                begins = np.append(0, ends + 1)[:-1]
            elif self.first:
                begins = np.flatnonzero(self.marks[ids])
                ends = np.append(begins, len(ids))[1:]
            else:
                ends = np.flatnonzero(self.marks[ids]) + 1
                begins = np.append(0, ends)[:-1]
            if len(ends) != len(part):
                self.cache.update(zip(part, self.encode(part), strict=True))
                continue
            raw = ids.tobytes()
            self.cache.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, begins.tolist(), ends.tolist(), strict=True))

    def _shrink(self) -> None:
        """Keep the short words of a full cache, which come again; all go if that is not enough."""
        if len(self.cache) > self.limit:
            short = {w: r for w, r in self.cache.items() if len(w) <= _SHORT - 2}
            self.cache = short if len(short) < self.limit // 2 else {}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        split = [None if t and _ODD.search(t) else self.chunks(t or "") for t in texts]
        self._shrink()
        new: set[str] = set()
        for chunks in split:
            if chunks:
                new |= set(chunks).difference(self.cache)
        self._learn([w for w in new if self.plain(w)], self.glue)
        if self.first:
            self._learn([w for w in new if self.bare(w)], "\n")
        rest = [w for w in new if w not in self.cache]
        self.cache.update(zip(rest, self.encode(rest), strict=True))
        whole = iter(self.encode([t for t, chunks in zip(texts, split, strict=True) if chunks is None]))
        get = self.cache.__getitem__
        return [next(whole) if chunks is None else b"".join(map(get, chunks)) for chunks in split]


    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        self._shrink()
        raws = list(map(self.cache.get, pieces))
        new = [p for p, r in zip(pieces, raws) if r is None]
        if not new:
            return raws
        plain, rest = [], []
        for p in new:
            (plain if self.plain(p) else rest).append(p)
        self._learn(plain, self.glue)
        if self.first:
            bare = [p for p in rest if self.bare(p)]
            self._learn(bare, "\n")
            rest = list(set(rest).difference(bare))
        self.cache.update(zip(rest, self.encode(rest), strict=True))
        return [self.cache[p] if r is None else r for p, r in zip(pieces, raws)]

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column (null: none), each distinct piece of the column looked up once.

        A unit is a word (word level) or a word with the blank before it (byte level); it is one piece, or its letters and
        the signs or digits after them. Texts in which units would not part as the library parts them (a blank after
        other white space, and those of :data:`_ODD`) go through :meth:`ids`.
        """
        texts = pc.fill_null(texts, "")
        slow = pc.match_substring_regex(texts, _SLOW_BYTE if self.first else _SLOW_WORD).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        if slow.any():
            at = np.flatnonzero(slow)
            for i, raw in zip(at.tolist(), self.ids(texts.take(pa.array(at)).to_pylist()), strict=True):
                out[i] = np.frombuffer(raw, "<u4")
        fast = np.flatnonzero(~slow)
        if not len(fast):
            return out
        split = (pc.split_pattern(texts, " ") if self.first else pc.ascii_split_whitespace(texts)) if len(fast) == len(texts) else (pc.split_pattern(texts.take(pa.array(fast)), " ") if self.first else pc.ascii_split_whitespace(texts.take(pa.array(fast))))
        cuts = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(coded.dictionary)
        if self.first:  # a text's first piece has no blank before it
            head = cuts[:-1] - cuts[0]
            codes = codes.astype(np.int64)
            first = np.unique(codes[head])
            own = np.zeros(n, np.int64)
            own[first] = np.arange(n, n + len(first))
            codes[head] = own[codes[head]]
            blank = pc.binary_join_element_wise(pa.scalar(" "), coded.dictionary, pa.scalar(""))
            units = pa.concat_arrays([blank, coded.dictionary.take(pa.array(first))])
        else:
            units = coded.dictionary
        parts = pc.extract_regex(units, _TWO)
        heads, tails = (pc.coalesce(pc.struct_field(parts, i), other) for i, other in ((0, units), (1, pa.scalar(""))))
        pieces = pa.concat_arrays([heads, tails]).dictionary_encode()
        raws = self._pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(r) // 4 for r in raws], np.int64)
        flat, begin = np.frombuffer(b"".join(raws), "<u4"), np.cumsum(size) - size
        head, tail = np.split(pieces.indices.to_numpy(), 2)
        two = np.stack([head[codes], tail[codes]], 1).ravel()  # each unit's two pieces, in order
        lengths = size[two]
        ends = np.cumsum(lengths)
        two, lengths = two[lengths > 0], lengths[lengths > 0]
        stops = np.cumsum(lengths)
        all_ = flat[np.repeat(begin[two] - (stops - lengths), lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]
        ends = ends[1::2]
        bounds = np.concatenate([[0], ends])[cuts - cuts[0]]
        for i, a, b in zip(fast.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = all_[a:b]
        return out


def encoder(path: str, limit: int = CACHE_ENTRIES) -> Encoder:
    """The worker's encoder for a vocabulary file, keeping so many entries."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].limit = limit
    return _encoders[path]


def slices(texts: pa.Array, size: int = 4_000_000):
    """Pieces of a column with at most about so many bytes each, so that memory stays bounded; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end
