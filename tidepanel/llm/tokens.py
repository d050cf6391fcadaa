"""Token ids of whole texts by the ``tokenizers`` library.

Most running text repeats its words, so a task encodes each space-separated chunk once
and keeps the ids. A chunk boundary is taken only where the tokenizer's own
pre-tokenisation always has one: before a single space that is followed by a
non-space character. Tokenizers for which that cannot be told encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

from tidepanel.llm.common import bounded

# Entries a worker process keeps (about 250 MB): the newest half, and the half before it,
# from which what comes again moves up. With half as many, prose with many rare words is
# mostly encoded anew.
CACHE_ENTRIES = 800_000
# Bytes of text encoded at a time: each of its chunks is an object for a while, and kept
# ones among them hold on to the memory of all.
ENCODED_BYTES = 1 << 18
# Longer chunks are encoded each time, so that the cache's size in bytes is bounded.
CACHED_CHARS = 48

# Byte-level models write each byte as one printable character: printable Latin-1 bytes as
# themselves, the others as the characters from U+0100 on. Here for letters up to U+00FF.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}
_LETTERS = {c: "".join(_BYTE_CHAR[b] for b in chr(c).encode("utf-8")) for c in range(128, 256)}

# White space next to a space or line feed, or a space that ends the text.
_ODD_SPACE = re.compile(r"\s[ \n]|[ \n]\s| \Z")
_BEFORE_WORD = re.compile(r" (?=\S)")
# Separators that Python counts as white space and the tokenizers do not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
# White space besides space and line feed, by whether a text is all ASCII.
_RARE_ASCII = "\t\r\x0b\x0c" + _SEPARATORS
_RARE_SPACE = _RARE_ASCII + "".join(c for c in map(chr, range(128, 0x3001)) if c.isspace())
_LETTER_RUN = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"
# Latin letters, then plain punctuation: both kinds of tokenizer cut between the two.
_WORD_MARK = re.compile(rf"({_LETTER_RUN})([,.!?;:%$#&*|]*)\Z")
_MARKS = ",.!?;:%$#&*|"
# In keys of the first kind of tokenizer: the chunk opens the text, or follows a line feed.
OPENS, NEXT_LINE = "\t", "\n"


def boundary_kind(path: str) -> str:
    """How the tokenizer treats the space before a word: "kept", "dropped" or "unknown"."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    if spec["model"].get("type") != "BPE":
        return "unknown"
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel":
        return "kept" if pre.get("use_regex") and not pre.get("add_prefix_space") else "unknown"
    steps = pre.get("pretokenizers", [])
    if steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
        return "dropped"
    return "unknown"


def _odd_space(text: str) -> bool:
    """Whether a pre-tokenisation may join white space in another way than one space a word;
    plain searches settle nearly all texts before the regular expression is asked."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] == " ":
        return True
    rare = _RARE_ASCII if text.isascii() else _RARE_SPACE
    return any(map(text.__contains__, rare)) and _ODD_SPACE.search(text) is not None


class Encoder:
    """Encodes batches of texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per Spark task
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._kind = boundary_kind(path)
        self._entries = entries
        self._ids: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}
        self.vocabulary = self._tokenizer.get_vocab_size()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _word(self, word: str, spaced: bool) -> bytes:
        """Ids of a word of Latin letters, which the pre-tokenisation leaves whole: straight
        from the library's model, past its regular expressions."""
        if spaced and (known := self._ids.get(word) or self._older.get(word)):
            return known
        return self._new_word(word, spaced)

    def _new_word(self, word: str, spaced: bool) -> bytes:
        plain = word if self._kind == "kept" else word.lower()
        shown = plain if plain.isascii() else plain.translate(_LETTERS)
        lead = _BYTE_CHAR[32] if spaced and self._kind == "kept" else ""
        found = array("I", [t.id for t in self._model.tokenize(lead + shown)]).tobytes()
        if spaced and len(word) <= CACHED_CHARS:
            self._ids[word] = found
        return found

    def _mark(self, mark: str) -> bytes:
        """Ids of punctuation without a space before it."""
        if len(mark) > 4:
            return self._library([mark])[0]
        if mark not in self._marks:
            self._marks[mark] = self._library([mark])[0]
        return self._marks[mark]

    def _chunks(self, text: str) -> list[str]:
        if self._kind == "dropped":  # white space is nothing but a boundary
            return text.split(" ") if any(map(text.__contains__, _SEPARATORS)) else text.split()
        if _odd_space(text):
            parts = _BEFORE_WORD.split(text)
        else:  # a single line feed is a piece of its own, and what follows it has no space
            parts = text.replace("\n", " \n").split(" ")
        parts[0] = OPENS + parts[0]
        return parts

    def _parts(self, core: str) -> tuple[str, str] | None:
        """Letters and the marks behind them, if a chunk is no more than that."""
        word = core.rstrip(_MARKS)
        if word.isascii():
            return (word, core[len(word) :]) if word.isalpha() else None
        m = _WORD_MARK.match(core)
        return m.groups() if m else None

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not kept yet; keeps those that are not too long."""
        kept, older = self._kind == "kept", self._older
        got: dict[str, bytes] = {}
        rest: dict[str, str] = {}
        for chunk in chunks:
            if (known := older.get(chunk)) is not None:
                got[chunk] = known
                continue
            lead = chunk[:1] if kept and chunk[:1] in (OPENS, NEXT_LINE) else ""
            core = chunk[1:] if lead else chunk
            if m := self._parts(core):
                word, mark = m
                if not mark and not lead:  # the chunk itself, known to be new
                    got[chunk] = self._new_word(word, True)
                    continue
                found = self._word(word, not lead) + (self._mark(mark) if mark else b"")
                got[chunk] = self._mark(NEXT_LINE) + found if lead == NEXT_LINE else found
            else:
                rest[chunk] = core if lead == OPENS else chunk if lead or not kept else " " + core
        got.update(zip(rest, self._library(list(rest.values())), strict=True))
        self._ids.update(got)
        for chunk in got:
            if len(chunk) > CACHED_CHARS:
                del self._ids[chunk]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        if self._kind == "unknown":
            return self._library(texts)
        if len(self._ids) > self._entries // 2:
            self._ids, self._older = {}, self._ids
        get, parts = self._ids.get, [self._chunks(t) for t in texts]
        found = [list(map(get, p)) for p in parts]
        gaps = [_places_of_none(f) for f in found]
        new = {p[k] for p, own in zip(parts, gaps, strict=True) for k in own}
        learned = self._learn(new) if new else {}
        for p, f, own in zip(parts, found, gaps, strict=True):
            for k in own:
                f[k] = learned[p[k]]
        return list(map(b"".join, found))


def _places_of_none(values: list) -> list[int]:
    places, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            places.append(at)
    except ValueError:
        return places


def encodable(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to what is encoded at a time; ``text`` is the text column's place."""
    return bounded(batches, text, ENCODED_BYTES, rows=256)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
