"""Cached access to public tokenizers: exact ids of whole texts, one lookup for each run of non-space characters."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable

import numpy as np

#: Entries that a worker's cache of chunks holds before it starts anew (bounds memory).
MAX_CACHED = 500_000
#: White space that isn't handled by plain splitting; a text with any goes through the library whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_loaded: dict[tuple, object] = {}


class ChunkCache(dict):
    """chunk -> encoded bytes; full caches are emptied."""

    limit = MAX_CACHED

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, key: str) -> bytes:
        # letters before one final stop or comma are a pre-token of their own, and so is the mark
        if len(key) > 2 and key[-1] in ".," and key[-2].isalpha() and "\n" not in key:
            out = self[key[:-1]] + self.mark(key[-1])
        else:
            out = self.encode(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = out
        return out

    def mark(self, key: str) -> bytes:
        if (m := _loaded.get((id(self), key))) is None:
            m = _loaded[id(self), key] = self.encode_mark(key)
        return m

    def encode_mark(self, key: str) -> bytes:
        return self.encode(key)


#: The splitting pattern for which words of letters go to the BPE model directly, and the marks that end a run of letters.
_LETTERS_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = ".,!?;:#*$%&"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _splits_letters(tokenizer) -> bool:
    """Whether a tokenizer only composes, lower-cases and splits by _LETTERS_SPLIT before its byte-level BPE."""
    spec = json.loads(tokenizer.to_str())
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
        return False
    return pre[0]["pattern"] == {"Regex": _LETTERS_SPLIT} and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and spec["model"]["type"] == "BPE"


class _WordCache(ChunkCache):
    """A chunk of lower-case letters below U+0300 is one pre-token in composed form, which the BPE model takes as it
    is; marks behind letters are a pre-token of their own. Other chunks go through the library whole."""

    def __init__(self, tokenizer, encode: Callable[[str], bytes]):
        super().__init__(encode)
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, key: str) -> bytes:
        word = key.rstrip(_MARKS)
        if not word.isalpha() or max(word) >= "\u0300" or word != word.lower():
            out = self.encode(key)
        elif len(word) < len(key):
            out = self[word] + self[key[len(word) :]]
        else:
            symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            out = np.array([t.id for t in self.model.tokenize(symbols)], dtype="<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[key] = out
        return out


class WordTokenizer:
    """ids of a ``tokenizers`` file whose pre-tokenizer drops white space, as little-endian 32-bit numbers.

    Pre-tokens never hold white space, so a text's ids are those of its space-separated chunks in order. As in the
    library, a special token that a text spells out gets its own id.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = _splits_letters(self.tokenizer)
        self.cache = _WordCache(self.tokenizer, self._whole) if self.lowers else ChunkCache(self._whole)
        self._plain = any("<" not in t for t in added)
        # texts with one of these aren't lower-cased here, for its spelling counts; one with white space needs the whole text
        self.spelt = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.spaced = any(any(c.isspace() for c in t) for t in added) or any(t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values())

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        spelt = "<" in text and self.spelt.search(text) or "<" not in text and self._plain and self.spelt.search(text)
        if _ODD_SPACE.search(text) or spelt and self.spaced:
            return self._whole(text)
        if self.lowers and not spelt:
            if text.isascii():
                text = text.lower()
            else:
                try:
                    text.encode("latin-1")
                    text = text.lower()
                except UnicodeEncodeError:
                    pass
        return b"".join(map(self.cache.__getitem__, text.split()))

    @property
    def vocab_size(self) -> int:
        return max(self.tokenizer.get_vocab().values()) + 1


class _SpacedCache(ChunkCache):
    """Chunks stand behind one space, except those that begin with their newline."""

    limit = MAX_CACHED * 2 // 5  # two Python workers a task, where the other tokenizers have one

    def encode_mark(self, key: str) -> bytes:
        return self.plain(key)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteDecoder:
    """The bytes of a rank file's ids, and the ids as decimal text."""

    def __init__(self, path: str):
        ranks = _ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.decimal = [str(i) for i in range(len(tokens))]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        shift = np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[np.arange(len(shift)) + shift].tobytes()


class ByteTokenizer:
    """ids of a rank file with a splitting pattern, as little-endian 32-bit numbers.

    A single space or newline between non-space characters always begins a pre-token; only there is a text cut.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
        self.cache = _SpacedCache(lambda chunk: self._whole(chunk if chunk[0] == "\n" else " " + chunk))
        self.cache.plain = self._whole

    def _whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = text.replace("\n", " \n").split(" ")
        if "" in chunks or "\n" in chunks or _ODD_SPACE.search(text) or re.search("[\t\r\x0b\x0c]", text):
            return b"".join(self._whole(p) for p in _glued(chunks))
        return self._whole(chunks[0]) + b"".join(map(self.cache.__getitem__, chunks[1:]))


def seam(text: str, i: int) -> bool:
    """Whether every tokenisation has a pre-token boundary at i: an isolated space or newline between non-space characters."""
    return 0 < i < len(text) - 1 and text[i] in " \n" and not text[i - 1].isspace() and not text[i + 1].isspace()


def _glued(chunks: list[str]):
    """Pieces of a text with runs of white space, cut at its seams only."""
    text = " ".join(chunks).replace(" \n", "\n")
    at = 0
    for m in re.finditer("[ \n]", text):
        if seam(text, i := m.start()):
            yield text[at:i]
            at = i
    yield text[at:]


def word_tokenizer(path: str) -> WordTokenizer:
    if ("word", path) not in _loaded:
        _loaded["word", path] = WordTokenizer(path)
    return _loaded["word", path]


def byte_tokenizer(path: str, pattern: str) -> ByteTokenizer:
    if ("byte", path, pattern) not in _loaded:
        _loaded["byte", path, pattern] = ByteTokenizer(path, pattern)
    return _loaded["byte", path, pattern]


def byte_decoder(path: str) -> ByteDecoder:
    if ("bytes", path) not in _loaded:
        _loaded["bytes", path] = ByteDecoder(path)
    return _loaded["bytes", path]
