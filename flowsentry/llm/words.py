"""Ids of a tokenizers vocabulary, word by word.

The vocabulary used here drops white space, so the ids of a text are those of its white-space-separated words in
order. Words repeat; the library is asked once for each word that a worker has not met lately.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache


#: Python also splits at U+001C to U+001F; the library does not take these for white space.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(r"[\S\x1c-\x1f]+")


def split_words(text: str) -> list[str]:
    """Words between white space as the tokenizer sees it."""
    if any(c in text for c in _NOT_SPACE):
        return _WORD.findall(text)
    return text.split()


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of this file, once per process; without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Words of ASCII and Latin-1 letters, ASCII digits and signs: lower case is all that the normalizer does to them.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Fixed pattern: the vocabulary's own split, for lower-case plain words.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+").findall
#: Stands for the end of a word behind a piece's bytes; no UTF-8 text holds it.
_WORD_END = b"\xff"


@lru_cache(maxsize=4)
def pieces(path: str):
    """Bytes of a piece of a word to ids: the same vocabulary and merges in tiktoken, which is faster for single words.

    None if the vocabulary does not number its tokens in the order of its merges (single bytes, bytes at a word's end,
    then the merges); then :func:`load` does all the work.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, merges = model["vocab"], model["merges"]
    if model.get("end_of_word_suffix") != "</w>" or any(vocabulary["".join(m)] != 512 + i for i, m in enumerate(merges)):
        return None
    byte = byte_symbols()
    ranks = {}
    for token, i in vocabulary.items():
        if i < 512 + len(merges):
            ends = token.endswith("</w>") and len(token) > 4
            ranks[bytes(byte[c] for c in token.removesuffix("</w>" if ends else "")) + _WORD_END * ends] = i
    ranks[_WORD_END] = 512 + len(merges)
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Recent(dict):
    """A cache filled by ``make``, emptied when it holds ``limit`` keys; keys over ``longest`` are not kept."""

    def __init__(self, make, limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Words to little-endian unsigned 32-bit ids. Remembers a bounded number of short words and pieces."""

    def __init__(self, path: str, limit: int = 300_000, longest: int = 64):
        self.tokenizer, self.piece, self.longest = load(path), pieces(path), longest
        self.known = Recent(self.word, limit, longest)
        self.known_pieces = Recent(self.piece_ids, limit // 3, longest)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, split_words(text)))

    def piece_ids(self, piece: str) -> bytes:
        return array("I", self.piece(piece.encode() + _WORD_END)).tobytes()

    def word(self, w: str) -> bytes:
        if self.piece and len(w) <= self.longest:
            if _LETTERS(w):
                return self.known_pieces[w.lower()]
            if _LETTERS(w, 0, len(w) - 1) and w[-1] in ".,;:!?|":
                return self.known_pieces[w[:-1].lower()] + self.known_pieces[w[-1]]
            if _PLAIN(w) and "<|" not in w:
                return b"".join(map(self.known_pieces.__getitem__, _PIECE(w.lower())))
        return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One for each worker process and file."""
    return WordIds(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
