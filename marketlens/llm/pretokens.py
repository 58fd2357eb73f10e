"""Pre-tokens of the byte-level vocabularies: pieces of a text that are encoded one by one."""

from __future__ import annotations

import re
from itertools import chain

from tokenizers import Tokenizer

# letters, numbers and white space below U+0250, as Unicode classes them (fixed values)
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \x85\xa0"
#: The pre-tokens of texts below U+0250, in the order in which the vocabulary's own pattern tries them.
PIECES = re.compile(
    rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Anything above, and control characters of which libraries disagree whether they are white space.
UNUSUAL = re.compile("[^\x00-\x1b\x20-ɏ]")


class Splitter:
    """Cuts texts into pre-tokens exactly as the tokenizer does: special tokens first, then its pattern."""

    def __init__(self, tokenizer: Tokenizer):
        self.own = tokenizer.pre_tokenizer
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = tuple(special)

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(mark in text for mark in self.marks):
            return self.plain(text)
        parts = self.special.split(text)
        return list(chain.from_iterable([part] if i % 2 else self.plain(part) for i, part in enumerate(parts)))

    def plain(self, text: str) -> list[str]:
        if UNUSUAL.search(text) is None:
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)] if text else []


def byte_level(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer encodes pre-tokens of a byte-level pattern, each by itself."""
    kind = type(tokenizer.pre_tokenizer).__name__
    return kind == "ByteLevel" and not tokenizer.pre_tokenizer.add_prefix_space and tokenizer.normalizer is None


def encoded(tokenizer: Tokenizer, pieces: list[str]) -> list[list[int]]:
    """Token ids of each piece; nothing is added."""
    return [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
