"""Token ids of whole texts, exactly as the tokenizers library gives them, with a memo of words.

Both vocabularies used here cut a text into words before they merge anything, so a text's ids are its words' ids
one after the other. Where all characters of a text lie in a range whose tables are fixed (below U+0230, but for
U+0130), the words are cut by a pattern and each distinct word goes through the library once; any other text, any
that holds a special token and any other tokenizer goes through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters below this have their lower case below 0x2B0, up to where the classes go.
LIMIT = 0x230
#: Words of a generation of a worker's memo: with so many, a new one begins, and the last but one is dropped.
MEMO_WORDS = 100_000
#: Characters of text that are cut and looked up together.
TOGETHER = 1_000_000
_LETTERS = "".join(chr(c) for c in range(0x2B0) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x2B0) if unicodedata.category(chr(c))[0] == "N")
_SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
#: How the two known kinds of files cut words (fixed values of those files).
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_WORDS = re.compile(f"{_ENDINGS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: \x1c to \x1f are white space to Python only.
_OUTSIDE = f"[^\\x00-{chr(LIMIT - 1)}]|[\\x1c-\\x1f]|İ"
#: For RE2.
_END_WORDS = f"{_ENDINGS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"


class WordTokenizer:
    """ids(texts): each text's ids as little-endian uint32 bytes; None counts as the empty text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.words, self.lower = self._cutter(spec)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.lower:
            vocabulary = self.library.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    @staticmethod
    def _cutter(spec: dict):
        cut, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if norm is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
            return _BYTE_WORDS, False
        kinds = [x["type"] for x in (norm or {}).get("normalizers", [])]
        steps = cut.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and not steps[1]["use_regex"] and steps[0]["pattern"].get("Regex") == _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return _END_WORDS, True
        return None, False

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _memorize(self, words: set[str]) -> None:
        """Puts the words that the memo lacks through the library, but for those of the generation before, which move on: words that
        are met again and again are never encoded again."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        new = words.difference(self.memo)
        if self.older:
            met = new.intersection(self.older)
            self.memo.update((w, self.older.pop(w)) for w in met)
            new -= met
        new = list(new)
        if not self.lower:
            self.memo.update(zip(new, self._whole(new), strict=True))
            return
        for i in range(0, len(new), 500):  # many at once: each word's last token is marked as an end
            part = new[i : i + 500]
            data = self._whole([" ".join(part)])[0]
            stops = (4 * np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 4).tolist()
            if len(stops) == len(part):
                self.memo.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
            else:
                self.memo.update(zip(part, self._whole(part), strict=True))

    def _by_columns(self, texts: pa.Array) -> list[bytes]:
        """For the kind that drops white space: words are cut, coded and looked up as columns, each distinct word once,
        and their ids are laid end to end by arrays of places."""
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), _END_WORDS, "\\0 ")
        words = pc.utf8_split_whitespace(apart)
        coded = words.flatten().dictionary_encode()
        named = coded.dictionary.to_pylist()
        self._memorize(set(named))
        known = [self.memo[w] for w in named]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        firsts = (np.cumsum(sizes) - sizes)[codes]
        ids = flat[np.repeat(firsts - ends + lengths, lengths) + np.arange(lengths.sum())]
        stops = np.concatenate(([0], ends))[words.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        cut = [self.words.findall(x) for x in texts]
        self._memorize(set(chain.from_iterable(cut)))
        memo = self.memo
        return [b"".join([memo[w] for w in words]) for words in cut]

    def ids(self, texts) -> list[bytes]:
        texts = [x or "" for x in texts]
        out: list[bytes] = []
        first = size = 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= TOGETHER or i + 1 == len(texts):
                out += self._ids(texts[first : i + 1])
                first, size = i + 1, 0
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, _OUTSIDE)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(column, s))
        marks = [True] * len(texts) if self.words is None else whole.to_pylist()
        simple = column.filter(pa.array([not w for w in marks]))
        fast = iter(self._by_columns(simple) if self.lower else self._by_words(simple.to_pylist()))
        return [self._whole([x])[0] if w else next(fast) for x, w in zip(texts, marks, strict=True)]


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One a worker process."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file and the library's version: the version part of the cache's key."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()
