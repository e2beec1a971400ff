"""Groups of near copies by SimHash: texts whose sets of five-word shingles are similar by 0.8 or more.

Texts that differ only in white space and A-Z are one text, known by a 64-bit hash of it (``content``). Each distinct text gets TABLES
fingerprints, made of independently mixed hashes of its distinct words, of which an edit changes fewer than of shingles. Anchor-point
covering links them at the usual threshold. The values of each table are moved by a constant of the table, which leaves distances
within a table as they are and makes values of different tables as distant as random ones, so one covering does for all tables. The
clusters propose first: a member is compared with its cluster's smallest text, exactly, by its shingles. This joins most of a large group
with few comparisons.

What it leaves is found completely, by prefix filtering. Put the distinct shingles of all texts in one order; of two texts of this
similarity with n shingles each, the first 0.2 n + 1 have one in common. The order is that of hashes, but shingles that many texts
have come last, so that they are rarely among the first. Texts with a shingle among their first in common are a cell. One aggregation
of (shingle, group so far) leaves the cells that hold texts of different groups; only their rows go further. Pairs of such a
cell whose sizes, places and sketches (parities of shingle hashes) allow the similarity are compared exactly, unless links join them already. In a large
cell some texts lead: they are compared with all others, then links are followed, then more lead, until all have. So a large
group of copies is joined by its first leaders, and no pair that is similar stays apart. Groups are components over the links.

Texts stay where they are, but for those that are in pairs. Texts of fewer words than a shingle have one, the whole; texts without words
are copies of each other. A null text has no words. Rows with a null id take no part. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Keep, as_bytes, materialize, scratch, sliced, small, unused
from .simhash import COUNTED, SEED, components, links, shingles

#: Independent fingerprints of a text.
TABLES = 4
SIZE, SIMILARITY, THRESHOLD = 5, 0.8, 3
#: Shingle hashes counted at once for hot ones; how often a hot one is met in such counts; the most hot ones (broadcast).
COUNT_AT, HOT, MOST_HOT = 1 << 20, 100, 65_536
#: Leaders of a cell in the first round, and by how much they grow with each; pairs of one leader that meet in one task.
LEADERS, GROWTH, LEADER_BLOCK = 16, 8, 4096
#: Bits of a sketch, a power of two.
SKETCH_BITS = 512
#: Pairs that a task is meant to compare.
PAIRS_A_TASK = 1000
#: Shingles of cells of several groups that are broadcast (8 bytes each); more are joined.
MOST_WANTED = 2_000_000


# -- one text -------------------------------------------------------------------------------------------------------------


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def content_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash values of the distinct words with these hashes, one for each table."""
    distinct = np.unique(hashes)
    out = np.zeros(TABLES, "<u8")
    for t in range(TABLES):
        shift = np.uint64(0x9E3779B97F4A7C15 * (t + 1) & (1 << 64) - 1)
        mixed = (distinct ^ shift) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        counts = np.zeros(64, "i8")
        for at in range(0, len(mixed), COUNTED):
            counts += np.unpackbits(mixed[at : at + COUNTED].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
        out[t] = np.packbits(2 * counts > len(mixed), bitorder="little").view("<u8")[0] ^ shift
    return out


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; none for texts of fewer words, which are similar to their copies only."""
    if len(hashes) < SIZE:
        return np.zeros(0, "i8")
    n = len(hashes) - SIZE + 1
    out = np.zeros(n, "<u8")
    for k in range(SIZE):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out.view("i8"))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The number of distinct shingle hashes, then, for each value of their first bits, whether an odd number has it, packed."""
    odd = np.bincount((hashes.view("u8") >> np.uint64(65 - SKETCH_BITS.bit_length())).astype("i8"), minlength=SKETCH_BITS) & 1
    return np.append(np.array([len(hashes)], "i8"), np.packbits(odd.astype("u1"), bitorder="little").view("<i8"))


def first_shingles(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Those of a text's shingles of which a similar text shares one; ``hot`` (sorted) come last. One more, lest hashes be equal."""
    late = np.isin(hashes, hot, assume_unique=True)
    n = len(hashes)
    return np.concatenate([hashes[~late], hashes[late]])[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 2]


def similarity(a: bytes, b: bytes, size: int = SIZE) -> float:
    """Jaccard similarity of the sets of word shingles; 1 for texts without words."""
    x, y = set(shingles(a, size)), set(shingles(b, size))
    return len(x & y) / len(x | y) if x or y else 1.0


def _longs(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "i8"), *lists])))


# -- passes over all texts --------------------------------------------------------------------------------------------------


def _digests(base: DataFrame) -> DataFrame:
    """For rows (id, row, text): (id, row, content, fps, sketch), and rows without content: counts of shingles that recur nearby (hs, ns)."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([base.schema["id"], base.schema["row"], *[T.StructField(c, t) for c, t in (("content", T.LongType()), ("fps", longs), ("sketch", longs), ("hs", longs), ("ns", longs))]])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, id_type = 0, None

        def counts() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            more = n > 1
            none = pa.nulls(1, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), none, none, _longs([h[more]]), _longs([n[more].astype("i8")])], names=schema.names)

        for batch in sliced(batches, 2):
            id_type = batch.schema.field(0).type
            content, fps, sketches = [], [], []
            for text in as_bytes(batch.column(2)):
                words = words_of(text)
                hashes = word_hashes(words)
                content.append(content_of(words))
                fps.append(fingerprints(hashes).view("i8"))
                held.append(shingle_hashes(hashes))
                sketches.append(sketch(held[-1]))
                size += len(held[-1])
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.int64()), _longs(fps), _longs(sketches), none, none], names=schema.names)
            if size >= COUNT_AT:
                yield counts()
                held, size = [], 0
        if held:
            yield counts()

    return base.mapInArrow(run, schema)


def often(digests: DataFrame) -> np.ndarray:
    """Hashes of shingles that very many texts have, sorted. They only order shingles: one more or less changes no result."""
    each = digests.where("content IS NULL").select(F.explode(F.arrays_zip("hs", "ns")).alias("x")).select(F.col("x.hs").alias("h"), F.col("x.ns").alias("n"))
    counts = each.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(MOST_HOT).collect()], "i8"))


def _first_keys(base: DataFrame, hot: np.ndarray) -> DataFrame:
    """(content, n, keys) of each row: the number of its shingles and the first of them; copies give the same row again."""
    shared = base.sparkSession.sparkContext.broadcast(hot)  # at most MOST_HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            content, sizes, keys = [], [], []
            for text in as_bytes(batch.column(0)):
                words = words_of(text)
                if len(words) >= SIZE:
                    h = shingle_hashes(word_hashes(words))
                    content.append(content_of(words))
                    sizes.append(len(h))
                    keys.append(first_shingles(h, shared.value))
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.array(sizes, pa.int32()), _longs(keys)], names=["content", "n", "keys"])

    return base.select("text").mapInArrow(run, "content long, n int, keys array<long>")


# -- pairs --------------------------------------------------------------------------------------------------------------------


def _proposed(nodes: DataFrame, keep: Keep) -> DataFrame:
    """Pairs (a, b) of each SimHash cluster's smallest text and another of its members."""
    values = keep(nodes.select("content", F.explode("fps").alias("fp")), "values")
    distinct = keep(values.select("fp").distinct(), "distinct")
    roots = components(links(distinct, distinct.count(), THRESHOLD, keep), keep)
    members = values.join(roots, F.col("fp") == F.col("node"), "left").select("content", F.coalesce("root", "fp").alias("cluster"))
    leaders = keep(members.groupBy("cluster").agg(F.min("content").alias("a"), F.max("content").alias("most")).where("a < most").select("cluster", "a"), "leaders")
    return members.join(leaders, "cluster").where("content <> a").select("a", F.col("content").alias("b")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the group ``root`` of their content so far."""
    return rows.join(roots, F.col("content") == F.col("node"), "left").withColumn("root", F.coalesce("root", "content")).drop("node")


def _cells(keys: DataFrame, roots: DataFrame, keep: Keep) -> DataFrame:
    """(h, content, n, at, size, turn) of texts that share one of their first shingles, in cells that hold more than one group.

    ``size`` is that of the cell, ``turn`` a text's random place in it from 0 to ``size``, ``at`` the place of the shingle in the text.
    """
    grouped = _rooted(keys, roots).select(F.explode("keys").alias("h"), "root")
    mixed = keep(grouped.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h"), "mixed")
    live = keep(_among(keys, mixed).distinct(), "live")
    sizes = keep(live.groupBy("h").agg(F.count(F.lit(1)).alias("size")), "sizes")
    # A text's place is the same share of each of its cells, so cells of the same texts have the same leaders, and a pair is compared once.
    turn = F.pmod(F.xxhash64("content", F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52)) * F.col("size")
    return keep(live.join(sizes, "h").withColumn("turn", turn), "members")


def _among(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(content, n, at, h) of the ``keys`` that are among ``wanted`` (h). Up to MOST_WANTED are broadcast, so that other keys aren't shuffled."""
    if wanted.count() > MOST_WANTED:
        return keys.select("content", "n", F.posexplode("keys").alias("at", "h")).join(wanted, "h").select("content", "n", "at", "h")
    found = np.sort(wanted.toArrow().column("h").to_numpy().astype("i8"))
    shared = keys.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = shared.value
        for batch in sliced(batches, 2):
            lists = batch.column(2)
            h = lists.flatten().to_numpy()
            at = np.searchsorted(among, h)
            place = np.flatnonzero(among[np.minimum(at, len(among) - 1)] == h) if len(among) else np.zeros(0, "i8")
            sizes = lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            rows = np.searchsorted(starts, place, side="right") - 1
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array((place - starts[rows]).astype("i4")), pa.array(h[place])], names=["content", "n", "at", "h"])

    return keys.select("content", "n", "keys").mapInArrow(run, "content long, n int, at int, h long")


def _led(cells: DataFrame, roots: DataFrame, low: int, high: int, keep: Keep) -> DataFrame:
    """Pairs (a, b) of a leader, whose turn is from ``low`` to ``high``, and a text of its cell whose turn is later; linked ones are left out."""
    # Links join most cells whole; a leader meets its cell in blocks.
    rooted = _rooted(cells.where(F.col("size") > low), roots)
    mixed = keep(rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h"), "mixed")
    live = keep(rooted.join(mixed, "h"), "rooted")
    blocks = F.ceil(F.col("size") / LEADER_BLOCK).cast("int")
    names = ["content", "n", "at", "turn", "root"]
    leaders = live.where((F.col("turn") >= low) & (F.col("turn") < high)).select("h", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *[F.col(c).alias(f"a_{c}") for c in names])
    others = live.where(F.col("turn") >= low).select("h", F.pmod(F.xxhash64("content"), blocks).cast("int").alias("block"), *[F.col(c).alias(f"b_{c}") for c in names])
    later = (F.col("a_turn") < F.col("b_turn")) | ((F.col("a_turn") == F.col("b_turn")) & (F.col("a_content") < F.col("b_content")))
    # At the first shingle that two texts share, what comes after it must suffice for the similarity.
    least = (F.col("a_n") + F.col("b_n")) * (SIMILARITY / (1 + SIMILARITY)) - 2
    enough = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= least
    met = leaders.join(others, ["h", "block"]).where((F.col("a_root") != F.col("b_root")) & later & enough)
    if low:
        return met.select(F.col("a_content").alias("a"), F.col("b_content").alias("b")).distinct()
    # In small cells either may lead: take a pair once.
    return met.select(F.least("a_content", "b_content").alias("a"), F.greatest("a_content", "b_content").alias("b")).distinct()


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) without those whose sketches rule the similarity out: texts differ by as many shingles at least as their sketches by bits.

    Of m and n shingles, similar texts have (m + n) (1 - s) / (1 + s) at most that are not in common; two more are let pass, lest hashes be equal.
    """
    side = lambda x: nodes.select(F.col("content").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    bits = F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(F.slice(bits, 2, SKETCH_BITS // 64), F.lit(0), lambda total, n: total + n)
    most = (F.col("sketch_a")[0] + F.col("sketch_b")[0]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 2
    return pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= most).select("a", "b")


def _texts(base: DataFrame, pairs: DataFrame, nodes: DataFrame, keep: Keep) -> DataFrame:
    """(content, z): the compressed text of each content that is in a pair. Other texts are not moved where the ids wanted are few enough to broadcast."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct()
    places = keep(nodes.join(wanted, "content").select(F.col("first.id").alias("id"), F.col("first.row").alias("row")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, 0):
            texts = as_bytes(batch.column(0))
            content = [content_of(words_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.array([packer.compress(t) for t in texts], pa.binary())], names=["content", "z"])

    packed = base.join(small(places), ["id", "row"], "left_semi").select("text").mapInArrow(run, "content long, z binary")
    # A row may repeat as a whole.
    return keep(packed.groupBy("content").agg(F.min("z").alias("z")), "texts")


def similar(pairs: DataFrame, texts: DataFrame, keep: Keep) -> DataFrame:
    """Those of the pairs (a, b) whose texts (content, z) are similar, compared by their shingles; a text with many pairs on its side a is dealt out."""
    hot = keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "hot")
    ones = F.coalesce("blocks", F.lit(1))
    # Pairs are few bytes and much work, so tasks are dealt out by their number; those of a text are next to each other.
    tasks = max(1, -(-pairs.count() // PAIRS_A_TASK))
    dealt = pairs.join(hot, "a", "left").withColumn("block", F.pmod(F.xxhash64("b"), ones).cast("int")).drop("blocks").repartition(tasks, "a", "block").sortWithinPartitions("a")
    wanted = texts.select(F.col("content").alias("a"), F.col("z").alias("za")).join(hot, "a", "left").withColumn("block", F.explode(F.sequence(F.lit(0), ones - 1))).drop("blocks")
    both = dealt.join(texts.select(F.col("content").alias("b"), F.col("z").alias("zb")), "b").join(wanted, ["a", "block"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        last, known = None, set()
        for batch in batches:
            good = []
            for row, (to, a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if to != last:
                    last, known = to, set(shingles(opener.decompress(a), SIZE))
                own = set(shingles(opener.decompress(b), SIZE))
                if len(own & known) >= SIMILARITY * len(own | known):
                    good.append(row)
            kept = batch.take(pa.array(good, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return both.select("a", "b", "za", "zb").mapInArrow(check, "a long, b long")


# -- groups -------------------------------------------------------------------------------------------------------------------


def _row(text: Column) -> Column:
    """Tells rows apart that share an id."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _groups(base: DataFrame, keep: Keep) -> DataFrame:
    """(id, row, copies, first) of each distinct (id, row) of rows (id, row, text): how often it comes, and its group's smallest (id, row)."""
    digests = keep(_digests(base), "digests")
    seen = digests.where("content IS NOT NULL").groupBy("id", "row", "content").agg(F.count(F.lit(1)).alias("copies"), F.min("fps").alias("fps"), F.min("sketch").alias("sketch"))
    seen = keep(seen, "seen")
    nodes = keep(seen.groupBy("content").agg(F.min(F.struct("id", "row")).alias("first"), F.min("fps").alias("fps"), F.min("sketch").alias("sketch")), "nodes")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = keep(_likely(keep(pairs, "met"), nodes), "pairs")
        return keep(similar(pairs, _texts(base, pairs, nodes, keep), keep), "links")

    roots = components(linked(_proposed(nodes, keep)), keep)
    cells = _cells(keep(_first_keys(base, often(digests)), "keys"), roots, keep)
    largest = cells.agg(F.max("size")).head()[0] or 0
    done, leading = 0, LEADERS
    while done < largest:
        more = linked(_led(cells, roots, done, leading, keep))
        done, leading = leading, leading * GROWTH
        if more.head(1):
            # What was linked before is as well told by its roots.
            roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), keep)
    named = _rooted(nodes.select("content", "first"), roots)
    firsts = keep(named.groupBy("root").agg(F.min("first").alias("least")), "firsts")
    of = keep(named.join(firsts, "root").select("content", "least"), "of")
    return seen.join(of, "content").select("id", "row", "copies", F.col("least").alias("first"))


def _base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), _row(text).alias("row"), text.alias("text"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of the rows that have an id, one for each distinct text of an id: the smallest id of the text's group."""
    with scratch(df.sparkSession) as keep:
        groups = materialize(_groups(_base(df, id_col, text_col), keep), "groups")
    return groups.select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group, that of the smallest id; columns as they are.

    Rows that share an id are documents of their own: they stay together only if none is a near copy of another row. Of rows that are
    equal in id and text one stays. Rows with a null id are not compared and stay. Only what goes (and what repeats) is joined to the texts.
    """
    with scratch(df.sparkSession) as keep:
        groups = keep(_groups(_base(df, id_col, text_col), keep), "groups")
        stays = (F.col("id") == F.col("first.id")) & (F.col("row") == F.col("first.row"))
        own, row = unused(df.columns, "__id"), unused(df.columns, "__row")
        names = [F.col("id").alias(own), F.col("row").alias(row)]
        gone = materialize(groups.where(~stays).select(*names), "gone")
        again = materialize(groups.where(stays & (F.col("copies") > 1)).select(*names), "again")
    keyed = df.withColumn(own, F.col(f"`{id_col}`")).withColumn(row, _row(F.col(f"`{text_col}`")))
    stay = keyed.join(small(gone), [own, row], "left_anti")  # a null id meets none
    if again.head(1):
        once = stay.join(small(again), [own, row], "left_semi").dropDuplicates([own, row])
        stay = stay.join(small(again), [own, row], "left_anti").unionByName(once)
    return stay.select(*[F.col(f"`{c}`") for c in df.columns])
