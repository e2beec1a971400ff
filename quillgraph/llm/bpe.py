"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a slice of texts that have no encoding yet go into a trie of bytes whose edges are stretches of words, so it
takes no more memory than the words. A depth-first walk carries, for each prefix on the current path, the last token of that prefix's encoding. The last token of a longer prefix is the longest
vocabulary token that ends there and that may stand after the last token of what it leaves: two tokens may be neighbours
if merging their joint bytes gives just these two again. As an encoding is valid exactly if all neighbours are, each prefix
has one such state, and prefixes that words share are worked out once. Reading a word's tokens off follows the states back.

No shuffle: each task encodes its own rows. Memory grows with a slice of texts (a single longer text at least), however long its
words are, and with a word cache of fixed size.

Nulls encode as the empty text (no ids); repeated rows are encoded each; an empty table gives an empty one. Columns of the
input other than the text are passed on; output columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import struct
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, sliced, unused
from .tokens import SPLIT, Vocabulary

#: Words whose encodings one Python worker keeps; the cache starts anew beyond it.
CACHED_WORDS = 1_200_000
#: Distinct words in one trie.
TRIE_WORDS = 40_000
#: Longer words don't stay in the cache.
CACHED_LENGTH = 64
#: Code points whose class the regex module's Unicode version may judge otherwise than the tokenizers library does; words of
#: texts that hold one are split by that library.
_UNSURE = regex.compile(r"[՘֋֌࢏౜೜₏₝-₟꟎-꟱꭬꭭\U00010000-\U0001efff\U0001fb00-\U0010ffff]")


_NEVER = 1 << 62  # the rank of a merge that doesn't come


class Trie:
    """A trie of distinct words, in which a path without branches or ends is one edge: the stretch of a word between two depths.

    Words are put in in order of their bytes, so a word leaves the path of the one before it where both begin to differ, and only
    nodes on that path can still get children.
    """

    def __init__(self, words: list[str]):
        texts = sorted((w.encode("utf-8", "replace"), w) for w in words if w)
        #: For each node: its text (a word that goes through it), its depth, the word that ends there, its children.
        self.text, self.depth, self.word, self.below = [b""], [0], [None], [[]]
        path = [0]
        before = b""
        for text, word in texts:
            shared = _shared(before, text)
            child = None
            while self.depth[path[-1]] > shared:
                child = path.pop()
            if self.depth[path[-1]] < shared:  # both part within an edge: a node for what they share
                fork = self._add(before, shared, None)
                self.below[path[-1]][-1] = fork
                self.below[fork].append(child)
                path.append(fork)
            leaf = self._add(text, len(text), word)
            self.below[path[-1]].append(leaf)
            path.append(leaf)
            before = text

    def _add(self, text: bytes, depth: int, word: str | None) -> int:
        self.text.append(text)
        self.depth.append(depth)
        self.word.append(word)
        self.below.append([])
        return len(self.text) - 1

    def edges(self) -> Iterator[tuple[str | None, bytes, int]]:
        """Depth first: (word that ends below the edge or None, the prefix down to its lower end, depth of its upper end)."""
        todo = [(child, 0) for child in self.below[0]]
        while todo:
            node, begin = todo.pop()
            depth = self.depth[node]
            yield self.word[node], self.text[node][:depth], begin
            todo += [(child, depth) for child in self.below[node]]


def _shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, min(n, 16)
    while a[:high] == b[:high]:
        low, high = high, min(n, 2 * high)
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self._pieces = vocabulary.pieces()
        self._specials = vocabulary.specials
        self._special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self._specials, key=len, reverse=True)) + ")") if self._specials else None
        self._words = regex.compile(SPLIT)
        self._content = vocabulary.content
        self._library = None
        self._pair = {(a << 32) | b: rank for rank, (a, b, _) in reversed(list(enumerate(vocabulary.merges)))}
        self._made = {i: (rank, a, b) for rank, (a, b, i) in reversed(list(enumerate(vocabulary.merges)))}
        self._tokens = {b: i for b, i in vocabulary.id_of.items() if len(b) == 1 or i in self._made}
        #: Every start of a token; its id if it is a token, else -1.
        self._starts = {b[:k]: -1 for b in self._tokens for k in range(1, len(b))} | self._tokens
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}

    # -- neighbours ---------------------------------------------------------------------------------------------------

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` while it is built up from bytes, each with the rank of the merge that ends it."""
        known = (self._left, self._right)[side]
        if token not in known:
            chain, above = [], _NEVER
            at = token
            while True:
                chain.append((at, above))
                if at not in self._made:
                    break
                above, a, b = self._made[at]
                at = b if side else a
            known[token] = chain[::-1]
        return known[token]

    def may_neighbour(self, a: int, b: int) -> bool:
        """Whether the boundary of a and b outlasts all merges of their joint bytes. Equal ranks merge from the left."""
        right, left = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        pair = self._pair
        while True:
            x, x_until = right[i]
            y, y_until = left[j]
            rank = pair.get((x << 32) | y)
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until <= y_until:
                if x_until == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    # -- trie -----------------------------------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word, little-endian, 32 bits each."""
        out = {"": b""}
        starts, fits, pieces = self._starts, self._fits, self._pieces
        last = [-1]  # for each prefix on the path, the last token of its encoding
        reach = [0]  # and the length of its longest end that a token starts with
        for word, text, begin in Trie(words).edges():
            del last[begin + 1 :], reach[begin + 1 :]
            for depth in range(begin + 1, len(text) + 1):
                size = reach[depth - 1] + 1
                while (token := starts.get(text[depth - size : depth])) is None:
                    size -= 1
                reach.append(size)
                while True:
                    if token is not None and token >= 0:
                        before = last[depth - size]
                        if before < 0:
                            break
                        both = (before << 32) | token
                        fit = fits.get(both)
                        if fit is None:
                            if len(fits) > 4_000_000:
                                fits.clear()
                            fit = fits[both] = self.may_neighbour(before, token)
                        if fit:
                            break
                    size -= 1
                    token = starts.get(text[depth - size : depth])
                last.append(token)
            if word is not None:
                ids, at = [], len(text)
                while at:
                    token = last[at]
                    ids.append(token)
                    at -= len(pieces[token])
                ids.reverse()
                out[word] = _pack(ids)
        return out

    # -- texts -----------------------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's words of a text without special tokens."""
        if text.isascii() or not _UNSURE.search(text):
            return self._words.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._content.decode()).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, 32 bits each."""
        split = []
        for text in texts:
            if self._special_split and any(s in text for s in self._specials):
                words: list[str | int] = []
                for k, part in enumerate(self._special_split.split(text)):
                    words += [self._specials[part]] if k % 2 else self.split(part)
                split.append(words)
            else:
                split.append(self.split(text))
        if len(self._cache) > CACHED_WORDS:
            self._cache = {}
        cache = self._cache
        new = [w for w in set().union(*split) if w not in cache]
        out_of_cache = {w: w.to_bytes(4, "little") for w in new if isinstance(w, int)}
        new = [w for w in new if not isinstance(w, int)]
        for at in range(0, len(new), TRIE_WORDS):
            for word, ids in self.encode_words(new[at : at + TRIE_WORDS]).items():
                (cache if len(word) <= CACHED_LENGTH else out_of_cache)[word] = ids
        if not out_of_cache:
            return [b"".join(map(cache.__getitem__, words)) for words in split]
        return [b"".join([cache[w] if w in cache else out_of_cache[w] for w in words]) for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids; special tokens keep their strings, invalid sequences become U+FFFD."""
        joined = b"".join(map(self._pieces.__getitem__, ids.tolist()))
        try:
            joined.decode()
        except UnicodeDecodeError:
            return joined.decode("utf-8", "replace").encode()
        return joined


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[int, TrieEncoder] = {}
_lock = threading.Lock()


def _encoder(content: bytes, key: int) -> TrieEncoder:
    """One encoder for each Python worker and vocabulary."""
    with _lock:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = TrieEncoder(Vocabulary(content))
        return _encoders[key]


#: What the operator can add to a row, with its type.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def bpe_encode(df: DataFrame, vocabulary_path: str, text_col: str = "text", emit: tuple[str, ...] = ("ids",), keep: list[str] | None = None) -> DataFrame:
    """Encode ``text_col`` of every row; add the columns named in ``emit`` (of OUTPUTS), keep the columns ``keep`` (all by default).

    ``decoded`` is the text decoded again from the ids; the digests are of ids (little-endian, 32 bits) and of decoded UTF-8.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in emit]
    spark = df.sparkSession
    content = Vocabulary.read(vocabulary_path).content
    shared, key = spark.sparkContext.broadcast(content), hash(content)
    work = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text_col}`"].alias(unused(keep, "__text")))
    schema = T.StructType([*work.schema.fields[: len(keep)], *[T.StructField(name, OUTPUTS[name]) for name in emit]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, key)
        for batch in sliced(batches, len(keep)):
            encoded = encoder.encode([t.decode("utf-8", "replace") for t in as_bytes(batch.column(len(keep)))])
            out: dict[str, pa.Array] = {}
            if "ids" in emit:
                ends = np.cumsum([0, *(len(x) // 4 for x in encoded)])
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
            if "n_tokens" in emit:
                out["n_tokens"] = pa.array([len(x) // 4 for x in encoded], pa.int64())
            if "ids_sha256" in emit:
                out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string())
            if "decoded" in emit or "decoded_sha256" in emit:
                decoded = [encoder.decode(np.frombuffer(x, "<u4")) for x in encoded]
                out["decoded"] = pa.array(decoded, pa.binary()).cast(pa.string()) if "decoded" in emit else None
                out["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[out[name] for name in emit]], names=[*keep, *emit])

    return work.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Decode an array of ids in every row into ``out_col``. Null ids give the empty text; unknown ids raise an IndexError."""
    keep = [c for c in df.columns if c != out_col]
    content = Vocabulary.read(vocabulary_path).content
    shared, key = df.sparkSession.sparkContext.broadcast(content), hash(content)
    work = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{ids_col}`"].cast("array<int>").alias(unused(keep, "__ids")))
    schema = T.StructType([*work.schema.fields[: len(keep)], T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, key)
        for batch in sliced(batches, len(keep)):
            decoded = [encoder.decode(np.array(x or [], "<u4")) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(decoded, pa.binary()).cast(pa.string())], names=[*keep, out_col])

    return work.mapInArrow(run, schema)
