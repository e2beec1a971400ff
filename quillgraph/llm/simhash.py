"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, each set if it is set in over half of the hashes of the text's word shingles. Equal fingerprints are
one from here on. Anchors are the words of a covering code (an extended BCH code, or a product of two). A fingerprint's home
is its nearest anchor; it is replicated to every anchor within its own covering radius (its distance to its home) plus the
threshold. For two fingerprints within the threshold, the one that is nearer to its home finds the other there: the other's
distance to that anchor is at most this radius plus the threshold, and its own radius is no smaller. So comparing homes with
replicas anchor by anchor finds every link, and no worst-case radius of the code is needed.

The code grows with the number of distinct fingerprints, so an anchor's share stays bounded; anchors that many fingerprints
call home are cut into blocks of homes and blocks of replicas. A block emits a spanning forest of its links instead of
all pairs, so a group of thousands of near copies gives as many rows as it has members. Components over these links come
from alternating star steps, each written to the shared folder.

Texts without words (null too) have fingerprint zero, linked like any other. Rows with a null id take part; a component's id is
the smallest id that is not null. Repeated rows and ids are each in the result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Keep, as_bytes, materialize, sliced

SEED = 42
#: Homes and replicas in one block of comparisons.
HOME_BLOCK, REPLICA_BLOCK = 4096, 32768
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


# -- fingerprints ---------------------------------------------------------------------------------------------------------


def shingles(text: bytes, size: int = 3) -> list[bytes]:
    """The word shingles of a text (A-Z lower-cased, split at ASCII white space), repeats included."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    return [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, size: int = 3) -> int:
    parts = shingles(text, size)
    if not parts:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), "<u8", len(parts))
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[at : at + COUNTED].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""
    work = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([work.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            values = np.array([fingerprint(t, size) for t in as_bytes(batch.column(1))], "u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view("i8"))], names=schema.names)

    return work.mapInArrow(run, schema)


# -- covering codes -------------------------------------------------------------------------------------------------------


def extended_bch(m: int, dimension: int) -> np.ndarray:
    """All words of an extended BCH code of length 2**m (m 5 or 6) with the largest designed distance that leaves ``dimension`` bits."""
    n, field_poly = (1 << m) - 1, {5: 0b100101, 6: 0b1000011}[m]
    power = [1]
    for _ in range(n - 1):
        x = power[-1] << 1
        power.append(x ^ field_poly if x >> m else x)
    log = {x: k for k, x in enumerate(power)}

    def times(a: int, b: int) -> int:
        return power[(log[a] + log[b]) % n] if a and b else 0

    generator, seen = [1], set()
    for root in range(1, n):
        if root in seen:
            continue
        coset = {root * 2**k % n for k in range(m)}
        if len(generator) - 1 + len(coset) > n - dimension:
            break
        seen |= coset
        for r in coset:  # times (x - alpha^r)
            generator = [times(power[r], c) ^ (generator[k - 1] if k else 0) for k, c in enumerate([*generator, 0])]
    k = n - (len(generator) - 1)
    if k != dimension:
        raise ValueError(f"no such code: {k} bits")
    base = sum(1 << i for i, c in enumerate(generator) if c)
    words = np.zeros(1, "u8")
    for shift in range(k):
        row = base << shift
        row |= (row.bit_count() & 1) << n
        words = np.concatenate([words, words ^ np.uint64(row)])
    return words


def anchor_blocks(distinct: int) -> list[np.ndarray]:
    """The anchors for so many distinct fingerprints, as words of one code of 64 bits, or of two codes of 32 (anchors are all pairs)."""
    if distinct <= 1 << 20:
        return [extended_bch(6, 10)]
    if distinct <= 1 << 27:
        return [extended_bch(6, 16)]
    return [extended_bch(5, 16)] * 2


def cover(values: np.ndarray, blocks: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the fingerprint, anchor, is home) for each anchor within the fingerprint's covering radius plus the threshold."""
    if len(blocks) == 1:
        rows, anchors, homes = [], [], []
        step = max(1, (1 << 21) // len(blocks[0]))
        for at in range(0, len(values), step):
            distance = np.bitwise_count(values[at : at + step, None] ^ blocks[0][None, :])
            home = distance.argmin(axis=1)
            radius = distance[np.arange(len(home)), home]
            r, a = np.nonzero(distance <= radius[:, None] + threshold)
            rows.append(r + at)
            anchors.append(blocks[0][a])
            homes.append(a == home[r])
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)
    out: list[tuple[int, int, bool]] = []
    low = np.uint64(0xFFFFFFFF)
    for row, value in enumerate(values):
        parts = []
        for code, half in zip(blocks, (value & low, value >> np.uint64(32)), strict=True):
            distance = np.bitwise_count(code ^ half)
            near = np.flatnonzero(distance <= distance.min() + threshold)
            near = near[np.argsort(distance[near], kind="stable")]
            parts.append((code[near], distance[near].astype("i8")))
        (a, da), (b, db) = parts
        i, j = np.nonzero(da[:, None] + db[None, :] <= da[0] + db[0] + threshold)
        out += zip([row] * len(i), (a[i] | (b[j] << np.uint64(32))).tolist(), ((i == 0) & (j == 0)).tolist(), strict=True)
    rows, anchors, homes = zip(*out, strict=True) if out else ((), (), ())
    return np.array(rows, "i8"), np.array(anchors, "u8"), np.array(homes, bool)


# -- links ------------------------------------------------------------------------------------------------------------------


def forest(homes: np.ndarray, replicas: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (member, root) values, of the links between homes and replicas."""
    nodes = np.unique(np.concatenate([homes, replicas]))
    at = np.searchsorted(nodes, replicas)
    root = np.arange(len(nodes))
    for home in np.unique(homes):
        near = at[np.bitwise_count(replicas ^ home) <= threshold]
        if len(near) == 0:
            continue
        met = np.unique(root[np.append(near, np.searchsorted(nodes, home))])
        for other in met[1:]:
            root[root == other] = met[0]
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def links(distinct: DataFrame, n: int, threshold: int = 3, keep: Keep = materialize) -> DataFrame:
    """(a, b) with a > b: links between distinct fingerprints (column fp) whose components are those of all pairs within the threshold."""
    blocks = anchor_blocks(n)
    shared = distinct.sparkSession.sparkContext.broadcast(blocks)  # at most 65536 words a block
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("home", T.BooleanType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.column(0).slice(at, 8192).to_numpy().view("u8")
                rows, anchors, homes = cover(part, shared.value, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view("i8")), pa.array(part[rows].view("i8")), pa.array(homes)], names=schema.names)

    covered = keep(distinct.select("fp").mapInArrow(spread, schema), "anchors")
    count = covered.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count(F.lit(1)).alias("r")).where("h > 0")
    sizes = count.select("anchor", F.ceil(F.col("h") / HOME_BLOCK).cast("int").alias("nh"), F.ceil(F.col("r") / REPLICA_BLOCK).cast("int").alias("nr"))
    sized = covered.join(sizes, "anchor")
    salt = lambda k: F.pmod(F.xxhash64("fp"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    as_home = sized.where("home").select("anchor", salt("nh").alias("hb"), every("nr").alias("rb"), "fp", F.lit(True).alias("home"))
    as_replica = sized.select("anchor", every("nh").alias("hb"), salt("nr").alias("rb"), "fp", F.lit(False).alias("home"))
    edge = "a long, b long"

    def compare(group: pa.Table) -> pa.Table:
        values, home = group.column("fp").to_numpy().view("u8"), group.column("home").to_numpy(zero_copy_only=False).astype(bool)
        member, root = forest(values[home], values[~home], threshold)
        a, b = member.view("i8"), root.view("i8")
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return as_home.unionByName(as_replica).groupBy("anchor", "hb", "rb").applyInArrow(compare, edge).distinct()


def components(edges: DataFrame, keep: Keep = materialize) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that is not its component's smallest; by alternating star steps."""
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(smaller, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = keep(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of every row: hexadecimal fingerprint and the smallest id reachable over links."""
    fps = materialize(fingerprints(df, id_col, text_col, size), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    n = distinct.agg(F.count(F.lit(1))).head()[0]
    roots = components(links(distinct, n, threshold)) if n else None
    labelled = distinct.withColumn("root", F.col("fp"))
    if roots is not None:
        labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
