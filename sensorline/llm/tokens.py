"""Encoding of whole texts by the tokenizers library, with each distinct word encoded once.

Vocabularies whose pre-tokenizer cuts at white space encode each stretch between white space on its own, so a text is the
sequence of its stretches and their ids can be kept. The memo is emptied when it is full: it bounds memory, not results.
For any other vocabulary whole texts go through the library.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np

#: The pre-tokenizer pattern that may be used word by word (a fixed value of the vocabulary file).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same over lower-cased text of the safe characters.
SAFE_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
#: Printable ASCII, white space and the Latin letters that normal form C and lower-casing treat one by one.
SAFE = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
#: Distinct words and pieces of words that the memo holds.
MOST_WORDS = 700_000


class _Memo(dict):
    """Packed ids by key; what is missing is made, and a full memo is emptied first."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MOST_WORDS:
            self.clear()
        ids = self[key] = self.make(key)
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.code = "<u2" if self.size <= 1 << 16 else "<u4"
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        norms = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec.get("added_tokens", []))
        self.by_word = (
            plain and norms == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern", {}).get("Regex") == WORD_SPLIT
            and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("use_regex", True)
        )
        if self.by_word:
            self.special = [x["content"] for x in spec.get("added_tokens", [])]
            byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.as_bytes = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}
            self.words = _Memo(self._word)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.code == '<u2' else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        found = self.library.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))
        return self._packed([t.id for t in found])

    def _word(self, word: str | bytes) -> bytes:
        """Ids of a safe lower-cased word from those of its pieces; of other stretches (bytes) by the whole library.

        A piece splits into itself alone, so words and pieces share one memo.
        """
        if isinstance(word, str):
            pieces = SAFE_SPLIT.findall(word)
            return self._piece(word) if pieces == [word] else b"".join(map(self.words.__getitem__, pieces))
        return self._packed(self.library.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)

    def _safe(self, text: str) -> bool:
        return SAFE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _split(self, text: str) -> list[str | bytes]:
        if self._safe(text):
            return text.lower().split()
        words: list[str | bytes] = []
        for stretch in text.encode("utf-8", "surrogatepass").split():
            part = stretch.decode("utf-8", "surrogatepass")
            words.append(part.lower() if self._safe(part) else stretch)
        return words

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a whole text; null encodes as empty."""
        if not text:
            return np.zeros(0, np.uint32)
        if not self.by_word:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, self._split(text))), self.code).astype(np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    return Encoder(path)
