"""Spans (half open, by document and block): overlap joins, as-of lookups, greedy selection, matching, windows.

Overlap and as-of joins bring both sides together by an equality on the key and on a bucket of positions, so a long block or a
key with very many spans spreads over tasks; a pair that shares several buckets is taken in the bucket where it first meets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.taken import Taken


def _bucketed(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bucket that [start, end) touches; empty spans touch none."""
    last = F.floor((F.col(end) - 1) / width)
    return df.where(F.col(end) > F.col(start)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, how: str = "inner", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of spans with equal keys that share a position. ``how``: inner, left_semi or left_anti.

    Columns of the right side beside the keys get the prefix ``r_``; ``width`` should be a few times the usual length of a span.
    """
    if how in ("left_semi", "left_anti"):
        marked = left.withColumn("__row", F.monotonically_increasing_id())
        met = overlap_join(marked, right, keys, width, "inner", start, end).select("__row").distinct()
        # The row number is only compared within this plan; a checkpointed or cached left side keeps it stable.
        return marked.join(met, "__row", how).drop("__row")
    renamed = right.select(*[F.col(c) if c in keys else F.col(c).alias(f"r_{c}") for c in right.columns])
    a, b = _bucketed(left, start, end, width), _bucketed(renamed, f"r_{start}", f"r_{end}", width)
    pairs = a.join(b, [*keys, "__bucket"])
    meet = (F.col(start) < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(end))
    first = F.col("__bucket") == F.floor(F.greatest(start, f"r_{start}") / width)
    return pairs.where(meet & first).drop("__bucket")


def exists_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], id_cols: Sequence[str], width: int, how: str, start: str = "start", end: str = "end") -> DataFrame:
    """Semi or anti overlap join for a left side whose ``id_cols`` identify its rows."""
    met = overlap_join(left, right.select(*keys, start, end), keys, width, "inner", start, end).select(*id_cols).distinct()
    return left.join(met, list(id_cols), how)


def segment_at(points: DataFrame, segments: DataFrame, keys: Sequence[str], position: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Points (left outer) with the segment that holds their position; segments of a key are disjoint, so there is one at most."""
    renamed = segments.select(*[F.col(c) if c in keys else F.col(c).alias(f"s_{c}") for c in segments.columns])
    spread = _bucketed(renamed, f"s_{start}", f"s_{end}", width)
    at = points.withColumn("__bucket", F.floor(F.col(position) / width))
    same = [at[k] == spread[k] for k in keys] + [at["__bucket"] == spread["__bucket"], at[position] >= spread[f"s_{start}"], at[position] < spread[f"s_{end}"]]
    joined = at.join(spread, same, "left")
    return joined.select(*[at[c] for c in points.columns], *[spread[f"s_{c}"] for c in segments.columns if c not in keys])


def gaps(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Uncovered stretches between spans of a key: keys, gap_start, gap_end."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = df.withColumn("__reached", F.max(end).over(before))
    return reached.where(F.col(start) > F.col("__reached")).select(*keys, F.col("__reached").alias("gap_start"), F.col(start).alias("gap_end"))


def best_per_span(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[Column]) -> DataFrame:
    """Of rows with equal keys the one with the highest score."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def drop_fragments(df: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Drop spans cut by an inner edge of a window (``at_edge``) if a longer span of their kind overlaps them."""
    cut = overlap_join(df, df.select(*keys, "kind", "start", "end"), [*keys, "kind"], width).where("at_edge AND r_end - r_start > `end` - start")
    return df.join(cut.select(*keys, "kind", "start", "end").distinct(), [*keys, "kind", "start", "end"], "left_anti")


def _runs(df: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """``df`` with ``__run``: rows of a key that are connected by overlaps have one number, so a key's work falls into small parts."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("__new", (low >= F.coalesce(F.max(high).over(before), low)).cast("int"))
    return marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _chosen(runs: DataFrame, keys: Sequence[str], fields: Sequence[str], choose: Callable[[list[dict]], list[int]]) -> DataFrame:
    """The rows that ``choose`` takes of each run (places in its list of ``fields``); runs of one row are taken without Python."""
    columns = [c for c in runs.columns if c != "__run"]
    listed = runs.groupBy(*keys, "__run").agg(F.collect_list(F.struct(*columns)).alias("__rows"))

    @F.pandas_udf("array<int>")
    def places(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: choose(list(r)))

    slim = F.transform("__rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    single = listed.where(F.size("__rows") == 1).select(F.col("__rows")[0].alias("__r"))
    several = listed.where(F.size("__rows") > 1).withColumn("__kept", places(slim))
    taken = several.select(F.explode(F.transform("__kept", lambda k: F.get("__rows", k))).alias("__r"))
    return single.unionByName(taken).select("__r.*")


def greedy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans that overlap no better one: by score (null counts as 1) and length falling, then start and kind."""

    def choose(rows: list[dict]) -> list[int]:
        rank = lambda k: (-(1.0 if rows[k]["score"] is None else rows[k]["score"]), rows[k]["start"] - rows[k]["end"], rows[k]["start"], rows[k]["kind"] or "")
        taken = Taken()
        return [k for k in sorted(range(len(rows)), key=rank) if taken.take(rows[k]["start"], rows[k]["end"])]

    return _chosen(_runs(df, keys, F.col("start"), F.col("end")), keys, ["start", "end", "kind", "score"], choose)


def match_one_to_one(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs (keys, g_start, g_end, p_start, p_end, shared): largest overlap first, each span once.

    Only spans of one connected run can compete, so candidates are assigned run by run.
    """
    pairs = overlap_join(gold.select(*keys, "start", "end"), predicted.select(*keys, "start", "end"), keys, width)
    pairs = pairs.withColumn("shared", F.least("end", "r_end") - F.greatest("start", "r_start"))

    def assign(rows: list[dict]) -> list[int]:
        used_gold, used_pred, kept = set(), set(), []
        for k in sorted(range(len(rows)), key=lambda k: (-rows[k]["shared"], rows[k]["start"], rows[k]["end"], rows[k]["r_start"], rows[k]["r_end"])):
            g, p = (rows[k]["start"], rows[k]["end"]), (rows[k]["r_start"], rows[k]["r_end"])
            if g not in used_gold and p not in used_pred:
                used_gold.add(g)
                used_pred.add(p)
                kept.append(k)
        return kept

    runs = _runs(pairs, keys, F.least("start", "r_start"), F.greatest("end", "r_end"))
    taken = _chosen(runs, keys, ["start", "end", "r_start", "r_end", "shared"], assign)
    return taken.select(*keys, F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("r_start").alias("p_start"), F.col("r_end").alias("p_end"), "shared")


#: Words of a needle that are looked up together; the least number of words for that; needles without so many that are looked for in each text.
HEAD, HEADED, MOST_PLAIN = 6, 8, 1000


def passages(documents: DataFrame, needles: DataFrame) -> DataFrame:
    """First place of each needle (needle_id, needle) in each document (doc_id, text) that holds it: adds ``start`` and ``end``.

    A needle may begin and end within words, so its first and last word are not looked up: HEAD words from its second on are, among
    those of all places of the documents, and hits are compared in full. Needles of fewer than HEADED words are compared with every text
    (MOST_PLAIN of them at most, which are broadcast; more raise a ValueError). Empty and null needles are nowhere.
    """
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    parted = needles.where("needle <> ''").withColumn("__w", words(F.col("needle")))
    head = parted.where(F.size("__w") >= HEADED).withColumn("__head", F.xxhash64(F.array_join(F.slice("__w", 2, HEAD), " "))).drop("__w")
    plain = parted.where(F.size("__w") < HEADED).select("needle_id", "needle")
    each = documents.where("text IS NOT NULL")
    places = F.transform(F.array(words(F.col("text"))), lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (HEAD - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, HEAD), " "))))[0]
    hashed = each.select("doc_id", F.explode(F.array_distinct(places)).alias("__head"))
    candidates = hashed.join(head, "__head").select("doc_id", "needle_id", "needle").distinct().join(each, "doc_id")
    few = plain.count()
    if few > MOST_PLAIN:
        raise ValueError(f"{few} needles of fewer than {HEADED} words; at most {MOST_PLAIN} can be looked for")
    if few:
        listed = F.array(*[F.struct(F.lit(r["needle_id"]).alias("needle_id"), F.lit(r["needle"]).alias("needle")) for r in plain.collect()])
        held = each.select("doc_id", "text", F.explode(F.filter(listed, lambda n: F.contains("text", n["needle"]))).alias("n"))
        candidates = candidates.select("doc_id", "needle_id", "needle", "text").unionByName(held.select("doc_id", "n.needle_id", "n.needle", "text"))
    found = candidates.withColumn("start", F.expr("instr(text, needle) - 1").cast("int")).where("start >= 0")
    return found.select("doc_id", "needle_id", "needle", "text", "start", (F.col("start") + F.length("needle")).cast("int").alias("end"))
