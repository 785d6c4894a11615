"""Ids of public byte-level BPE files, as ``tokenizers`` gives them.

The merges of such a file run on tiktoken, whose ranks are the file's ids. It is used for characters on
which both libraries split alike; any other text goes through ``tokenizers`` whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Words whose ids one Python worker remembers.
CACHE_WORDS = 400_000
#: Texts outside these characters go through the tokenizer whole: there its Unicode tables decide.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]|<\|")
_WORD = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")
#: How byte-level BPE splits a text before merging, and the mark of a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END = "</w>"


def _byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: itself if printable, else the next free one."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """A tokenizer file as a function from texts to ids."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.loaded = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, special = _byte_letters(), {t["content"] for t in spec["added_tokens"]}
        self.words, vocabulary = spec["model"].get("end_of_word_suffix") == WORD_END, spec["model"]["vocab"]
        del spec
        ranks = {}
        for token, number in vocabulary.items():
            if token not in special:
                last = self.words and token.endswith(WORD_END) and token != WORD_END
                raw = bytes(letters[c] for c in (token[:-len(WORD_END)] if last else token))
                # A word's end is a zero byte here; no text that comes this far holds one.
                ranks[raw + b"\0" * last] = number
        self.merges = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00" if self.words else SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.merges)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not _OTHER.search(text):
            if self.words:
                return b"".join(map(self.known.__getitem__, _WORD.findall(text.lower())))
            try:
                return self.merges.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # very long white space is more than tiktoken's pattern takes
                pass
        return np.array(self.whole().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self):
        """The tokenizer itself, loaded when a text needs it."""
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded


class _Known(dict):
    """Little-endian ids of a word, worked out once."""

    def __init__(self, merges):
        self.encode = merges.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids = array("I", self.encode(word + "\0")).tobytes()
        return ids


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
