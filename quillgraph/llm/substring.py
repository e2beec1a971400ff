"""Substring de-duplication by super-k-mer partitioning.

A window is ``window`` consecutive words; its minimiser is the smallest hash of ``WORDS`` consecutive words in it. Consecutive
windows of a document that share their minimiser are a super-k-mer: one string of words that stands for all of them. Equal
windows have equal minimisers, so they meet in the minimiser's bucket, where the windows of the super-k-mers there are sorted and
equal ones counted exactly, by their words.

What travels is cut down first, without losing a window:

1. occurrences of super-k-mers (document, start, number of windows, minimiser, hash of the string) are written once, without strings;
2. only minimisers that at least two documents have can matter;
3. equal super-k-mers (copies of documents, the inside of common passages) are one, with the smallest document they occur in;
   its string is taken from that document only, and travels to the bucket;
4. a bucket with more than HOT_STRINGS different strings (the edges of a passage that very many documents share) is dealt out
   by window instead, where sorting and counting is an aggregation with map-side combining.

A bucket answers, for runs of windows of each string, with the smallest document that has them; the occurrences in later documents
give the words to remove. Windows are judged on the input, not on what is left.

Words are what ASCII white space separates (bytes 0x20, 0x09 to 0x0D); a null text has none. A row with a null id is never
removed from and removes nothing. Rows that repeat an id are each judged against smaller ids. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, few, materialize, sliced

#: Words of a minimiser, at most.
WORDS = 8
#: Windows of one super-k-mer, at most.
MOST_WINDOWS = 64
#: Different strings that a bucket sorts in memory (about 1 KB each); beyond it windows are dealt out singly.
HOT_STRINGS = 2000
#: Spans to remove (with their rows) that are broadcast to where the texts are; beyond it texts travel to them, compressed.
MOST_SPANS = 1_000_000
_CACHED = 300_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    """Hash of each word, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) > _CACHED:
            self.clear()
        self[word] = value
        return value


def minimisers(hashes: np.ndarray, window: int, words: int) -> np.ndarray:
    """Smallest hash of ``words`` consecutive words in each window."""
    n = len(hashes) - words + 1
    mixed = np.zeros(n, "u8")
    for k in range(words):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    width, reach = 1, window - words + 1
    low = mixed
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    return low


def super_kmers(words: list[bytes], cache: dict, window: int) -> list[tuple[int, int, int]]:
    """(start, number of windows, minimiser) of a document's super-k-mers."""
    if len(words) < window:
        return []
    low = minimisers(np.array(list(map(cache.__getitem__, words)), "u8"), window, min(WORDS, window))
    edges = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(low)]
    values = low.view("i8")
    return [(a, min(MOST_WINDOWS, b - a), int(values[a])) for x, b in zip(starts, ends, strict=True) for a in range(x, b, MOST_WINDOWS)]


def _key(text: F.Column) -> F.Column:
    """Tells rows apart that share an id."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def occurrences(df: DataFrame, window: int) -> DataFrame:
    schema = "doc long, row long, start int, windows int, minimiser long, string long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in sliced(batches, "text"):
            docs, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for doc, row, text in zip(docs, rows, as_bytes(batch.column(2)), strict=True):
                words = text.split()
                for a, n, m in super_kmers(words, cache, window):
                    out.append((doc, row, a, n, m, xxhash.xxh3_64_intdigest(b" ".join(words[a : a + n + window - 1])) - (1 << 63)))
            for at in range(0, len(out), 50_000):
                columns = list(zip(*out[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc", "row", "start", "windows", "minimiser", "string"])

    return df.where("doc is not null").select("doc", "row", "text").mapInArrow(run, schema)


def packed_texts(df: DataFrame) -> DataFrame:
    """(doc, row, z): texts compressed for their way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, "text"):
            packed = [packer.compress(t) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc", "row", "z"])

    return df.select("doc", "row", "text").mapInArrow(run, "doc long, row long, z binary")


def strings_of(df: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The wanted super-k-mers (doc, row, start, windows, minimiser, string, hot, first) with their packed words."""
    lists = wanted.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "windows", "minimiser", "string", "hot")).alias("w"))
    # Where few texts are asked for, others are left out by a broadcast of ids before any is packed; else all travel, packed.
    asked = materialize(wanted.select("doc", "row").distinct(), "asked")
    named = df.where("doc is not null")
    joined = packed_texts(named.join(F.broadcast(asked), ["doc", "row"], "left_semi") if few(asked) else named).join(lists, ["doc", "row"]).select("doc", "z", "w.start", "w.windows", "w.minimiser", "w.string", "w.hot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        names = ["minimiser", "string", "first", "windows", "hot", "words"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        for batch in sliced(batches, "z"):
            out: list[tuple] = []
            size = 0
            for doc, z, *lists in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = opener.decompress(z).split()
                for a, n, m, s, hot in zip(*lists, strict=True):
                    packed = b" ".join(words[a : a + n + window - 1])
                    out.append((m, s, doc, n, hot, packed))
                    size += len(packed)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return joined.mapInArrow(run, "minimiser long, string long, first long, windows int, hot boolean, words binary")


def windows_of(packed: bytes, n: int, window: int) -> list[bytes]:
    """The words of each of the ``n`` windows of a packed string."""
    if n == 1:
        return [packed]
    spaces = [-1, *np.flatnonzero(np.frombuffer(packed, "u1") == 32).tolist(), len(packed)]
    return [packed[spaces[k] + 1 : spaces[k + window]] for k in range(n)]


def runs(firsts: list[int]) -> list[tuple[int, int, int]]:
    """(from, number, value) of runs of equal values."""
    out: list[tuple[int, int, int]] = []
    for k, x in enumerate(firsts):
        if out and out[-1][2] == x:
            out[-1] = (out[-1][0], out[-1][1] + 1, x)
        else:
            out.append((k, 1, x))
    return out


def sort_buckets(strings: DataFrame, window: int) -> DataFrame:
    """(minimiser, string, from, number, first) for runs of windows: the smallest document in which they start; one bucket at a time."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    names = ["minimiser", "string", "from", "number", "first"]

    def bucket(rows: list[tuple]) -> list[tuple]:
        sorted_windows = sorted((w, first, r, k) for r, (_, _, first, n, packed) in enumerate(rows) for k, w in enumerate(windows_of(packed, n, window)))
        answers = [[0] * row[3] for row in rows]
        last, least = None, 0
        for w, first, r, k in sorted_windows:
            if w != last:
                last, least = w, first
            answers[r][k] = least
        return [(row[0], row[1], *run) for row, answer in zip(rows, answers, strict=True) for run in runs(answer)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][0] != row[0]:
                    out += bucket(held)
                    held = []
                    if len(out) > 20_000:
                        yield made(out)
                        out = []
                if not held or held[-1] != row:
                    held.append(row)
        if held:
            out += bucket(held)
        if out:
            yield made(out)

    dealt = strings.select("minimiser", "string", "first", "windows", "words").repartition("minimiser").sortWithinPartitions("minimiser", "string")
    return dealt.mapInArrow(run, "minimiser long, string long, from int, number int, first long")


def deal_windows(strings: DataFrame, window: int) -> DataFrame:
    """As ``sort_buckets``, for hot minimisers: window by window, with an aggregation over each window's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["minimiser", "string", "from", "own", "words"]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            for at in range(0, len(rows), 200):
                out = [(m, s, k, first, w) for m, s, first, n, packed in rows[at : at + 200] for k, w in enumerate(windows_of(packed, n, window))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    singly = strings.select("minimiser", "string", "first", "windows", "words").distinct().mapInArrow(run, "minimiser long, string long, from int, own long, words binary")
    least = singly.groupBy("words").agg(F.min("own").alias("first"))
    return singly.join(least, "words").select("minimiser", "string", "from", F.lit(1).alias("number"), "first")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, passed: list[str] | None = None, layout: bool = False) -> DataFrame:
    """Every row with ``n_words``, ``n_removed`` (long), ``kept`` (the kept words joined by one space) and the columns ``passed``.

    A word goes if a window covers it whose words, in order, also start somewhere in a row with a smaller id. With ``layout``, ``kept`` is
    the text itself where nothing goes, and else keeps the white space between words that stay next to each other.
    """
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), _key(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    seen = materialize(occurrences(base, window), "superkmers")
    # Written before they are joined, as are other aggregates here: a join of plain shuffles is one that Spark can split where a key is hot.
    several = materialize(seen.groupBy("minimiser").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("minimiser"), "several")
    shared = materialize(seen.join(several, "minimiser", "left_semi"), "shared")
    strings = materialize(shared.groupBy("minimiser", "string").agg(F.min("doc").alias("first")), "distinct")
    hot = materialize(strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_STRINGS).select("minimiser", F.lit(True).alias("hot")), "hot")
    flagged = strings.join(hot, "minimiser", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = shared.join(flagged, ["minimiser", "string"]).where("doc = first")
    packed = materialize(strings_of(base, wanted, window), "strings")
    found = materialize(sort_buckets(packed.where("not hot"), window).unionByName(deal_windows(packed.where("hot"), window)), "repeats")
    hits = shared.select("doc", "row", "start", "minimiser", "string").join(found, ["minimiser", "string"]).where("doc > first")
    spans = hits.select("doc", "row", (F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("from") + F.col("number") + window - 1).alias("b"))
    lists = materialize(spans.groupBy("doc", "row").agg(F.collect_set(F.struct("a", "b")).alias("s")), "spans")
    return _without_spans(df, lists, id_col, text_col, passed or [], layout)


def _as_laid_out(text: bytes, stay: list[tuple[int, int]]) -> bytes:
    """The words [a, b) of a text for each of ``stay``, with the white space between them; runs are parted by a line break if the text breaks there."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, before = [], 0
    for a, b in stay:
        start, end = places[a][0], places[b - 1][1]
        if out:
            out.append(b"\n" if b"\n" in text[before:start] else b" ")
        out.append(text[start:end])
        before = end
    return b"".join(out)


def _without_spans(df: DataFrame, lists: DataFrame, id_col: str, text_col: str, passed: list[str], layout: bool) -> DataFrame:
    """Take the word spans out of the rows; ``lists`` has (doc, row, s) for some of them."""
    keep = [c for c in dict.fromkeys([id_col, *passed]) if c not in ("n_words", "n_removed", "kept")]
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("__doc"), _key(F.col(f"`{text_col}`")).alias("__row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.col(f"`{text_col}`").alias("__text"))
    z_schema = T.StructType([*base.schema.fields[:3], T.StructField("__z", T.BinaryType())])
    same = (F.col("__doc") == F.col("doc")) & (F.col("__row") == F.col("row"))
    packed = lists.agg(F.coalesce(F.sum(F.size("s") + 2), F.lit(0))).head()[0] > MOST_SPANS

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([packer.compress(t) for t in as_bytes(batch.column(3))], pa.binary())], names=z_schema.names)

    if packed:  # texts travel
        joined = base.mapInArrow(shrink, z_schema).join(lists, same, "left")
    else:
        joined = base.withColumnRenamed("__text", "__z").join(F.broadcast(lists), same, "left")
    work = joined.select("__keep", "__z", "s.a", "s.b")
    out = T.StructType([work.schema["__keep"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        for batch in sliced(batches, "__z"):
            total, removed, kept = [], [], []
            for z, starts, ends in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = opener.decompress(z) if packed else z
                words = text.split()
                total.append(len(words))
                stay, at, gone = [], 0, 0
                for a, b in sorted(zip(starts or (), ends or (), strict=True)):
                    if b > at:
                        a = max(a, at)
                        stay.append((at, a))
                        gone += b - a
                        at = b
                stay = [x for x in (*stay, (at, len(words))) if x[0] < x[1]]
                removed.append(gone)
                if layout:
                    kept.append(_as_laid_out(text, stay) if gone else text)
                else:
                    kept.append(b" ".join(words if not gone else [w for a, b in stay for w in words[a:b]]))
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, long), pa.array(removed, long), pa.array(kept, pa.binary()).cast(pa.string())], names=out.names)

    done = work.mapInArrow(cut, out)
    return done.select(*[F.col("__keep")[c].alias(c) for c in keep], "n_words", "n_removed", "kept")
