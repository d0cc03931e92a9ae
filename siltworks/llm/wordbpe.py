"""Ids of whole texts by a vocabulary of lower-case words with word ends.

The tokenizer lowers a text, drops its white space and merges within words only, so each distinct word is encoded once
and kept. Texts with a sign whose lowering or class may differ here, or with an added token, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Distinct words that a worker keeps; once full, rarer ones are encoded each time.
CACHE_WORDS = 200_000
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
#: Lower case of these stays among them; U+0130, whose does not, is left out.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ſ‐-‧‰-⁞]*+")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t\n\r {_LETTER}{_DIGIT}]+")
#: Byte-level BPE spells bytes as characters: printable ones as themselves, the rest from 256 on in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Words(dict):
    def __init__(self, tokenizer, code: str) -> None:
        self.model, self.code = tokenizer.model, code

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(_SPELLED)
        out = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


class WordEncoder:
    """A text's ids as bytes of ``dtype``, which is two bytes an id if the vocabulary has room in them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        narrow = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.dtype = np.dtype("<u2" if narrow else "<u4")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.words = _Words(self.tokenizer, "H" if narrow else "I")

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and not self.added.search(text):
            return b"".join(map(self.words.__getitem__, _SPLIT.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
