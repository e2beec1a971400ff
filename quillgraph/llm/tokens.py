"""Byte-level BPE vocabularies read from a tokenizer file, and fast exact encoding with them.

The file's path is a parameter; it is read once on the driver and its content travels to the executors as a broadcast
(a few MB, bounded by the vocabulary). Encoding goes through a compiled BPE over the same ranks; a test holds it against
the tokenizers library over every code point.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the pre-tokenizer's pattern of this family of vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters without a change between white space and other that the compiled splitter is not given.
LONG_RUN = 20_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, merge ranks and special tokens of a byte-level BPE file (JSON of the tokenizers library)."""

    def __init__(self, content: bytes):
        self.content = content
        spec = json.loads(content)
        model = spec["model"]
        if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        alphabet = byte_alphabet()
        raw = {token: bytes(alphabet[c] for c in token) for token in model["vocab"] if all(c in alphabet for c in token)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of: dict[int, bytes] = {i: raw[token] for token, i in model["vocab"].items() if token in raw and token not in self.specials}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merges: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.append((self.id_of[raw[left]], self.id_of[raw[right]], self.id_of[raw[left] + raw[right]]))
        for text, i in self.specials.items():
            self.bytes_of[i] = text.encode()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read())

    def pieces(self) -> list[bytes]:
        """Bytes by id, for decoding."""
        return [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]


class RankEncoder:
    """Whole texts to ids with the compiled BPE; special tokens' strings become their ids, as the tokenizers library does.

    The compiled splitter goes back over a run of one kind of character and fails on very long ones, so texts with a run of LONG_RUN
    characters between two changes of white space and other go through the tokenizers library.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        ranks = {vocabulary.bytes_of[i]: i for i in range(256) if i in vocabulary.bytes_of} | {vocabulary.bytes_of[i]: i for _, _, i in vocabulary.merges}
        if [i for _, _, i in vocabulary.merges] != list(range(256, 256 + len(vocabulary.merges))):
            raise ValueError("token ids must be merge ranks after the 256 bytes")
        self._inner = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=vocabulary.specials)
        self._names = set(vocabulary.specials)
        self._content = vocabulary.content
        self._library = None

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and _RUN.search(text):
            return self._encode_long(text)
        return self._inner.encode_to_numpy(text, allowed_special=self._names, disallowed_special=())

    def _encode_long(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._content.decode())
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4")
