"""Evaluation of recognition against marked-up letters: gold spans, scores, error classes, integrity of enrichment, corpus selection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tei
from ..sources.tei import Letter, local, project
from . import scores, spans
from .enrich import dissolve, serialised
from .recognise import Span, trimmed

GOLD = "letter string, block int, block_type string, start int, end int, kind string, text string, excluded string"


def gold_rows(letter: Letter) -> Iterator[tuple]:
    """Typed references as spans; implied ones and those inside another are marked as excluded."""
    for index, block in enumerate(letter.blocks()):
        p = project(block)
        for a in p.annotations:
            if not a.kind:
                continue
            span = trimmed(Span(a.start, a.end, a.kind), p.text)
            if span is None:
                continue
            nested = any(o is not a and o.kind and o.element in list(letter.ancestors(a.element)) for o in p.annotations)
            excluded = "implied" if a.element.get("subtype") == "implied" else "nested" if nested else None
            yield letter.doc_id, index, local(block), span.start, span.end, a.kind, p.text[span.start : span.end], excluded


def scan_gold(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in gold_rows(Letter(bytes(c), p))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in GOLD.split(", ")])

    return files.mapInPandas(run, GOLD)


def strip_references(content: bytes) -> bytes:
    """The letter without typed references in its body; their text stays."""
    letter = Letter(content)
    inside = {n for b in letter.blocks() for n in b.iter()} - {letter.root}
    dissolve(letter.root, {n for n in inside if tei.is_element(n) and tei.name_kind(n)})
    return serialised(letter.root)


def strict_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 by kind and in all, for equal spans counted as often as both sides have them."""
    keys = ["letter", "block", "start", "end", "kind"]
    return scores.prf(scores.multiset_matches(gold, predicted, keys, "kind"), "kind")


def overlap_scores(gold: DataFrame, predicted: DataFrame, width: int = 64) -> DataFrame:
    """The same for spans of a kind that share a character, matched one to one."""
    keys = ["letter", "block", "kind"]
    common = spans.match_one_to_one(gold, predicted, keys, width).groupBy("kind").agg(F.count(F.lit(1)).alias("common"))
    counts = gold.groupBy("kind").agg(F.count(F.lit(1)).alias("gold")).join(predicted.groupBy("kind").agg(F.count(F.lit(1)).alias("predicted")), "kind", "full").join(common, "kind", "left")
    return scores.prf(counts.fillna(0, ["gold", "predicted", "common"]), "kind")


def errors(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(letter, block, start, end, kind, category), in order of category and place."""
    rank = F.array_position(F.array(*[F.lit(c) for c in ("missed", "spurious", "boundary", "type")]), F.col("category"))
    return scores.error_classes(gold, predicted, ["letter", "block"]).orderBy(rank, "letter", "block", "start", "end", "kind")


def spot_check(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (letter, block, occurrence, kind, text) with the span of the nth occurrence of their text in the block; null if there is none."""
    joined = rows.join(blocks.select(F.col("doc_id").alias("letter"), "block", F.col("text").alias("whole")), ["letter", "block"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts = []
            for whole, text, n in zip(batch["whole"], batch["text"], batch["occurrence"], strict=True):
                at = -1
                for _ in range(int(n)):
                    at = whole.find(text, at + 1) if whole is not None else -1
                    if at < 0:
                        break
                starts.append(at)
            batch = batch.drop(columns="whole").assign(start=starts)
            batch["end"] = [a + len(t) if a >= 0 else -1 for a, t in zip(batch["start"], batch["text"], strict=True)]
            yield batch

    schema = ", ".join(f"{n} {t}" for n, t in joined.drop("whole").dtypes) + ", start int, end int"
    return joined.mapInPandas(run, schema)


def integrity(before: bytes, after: bytes) -> dict[str, int]:
    """Counts over names of an enriched letter: new ones, and those in places where a name has no business."""
    old = Letter(before)
    new = Letter(after)
    names = [n for n in new.root.iter() if tei.is_element(n) and local(n) in ("persName", "placeName", "orgName") and (n.get("resp") or "").startswith("#quill-run")]
    above = [[local(a) for a in new.ancestors(n)] for n in names]
    return {
        "new": len(names),
        "in_note": sum("note" in a for a in above),
        "in_reference": sum(bool(set(a) & tei.REFERENCES) for a in above),
        "in_token": sum(bool(set(a) & tei.NO_NAMES_INSIDE) for a in above),
        "text_changed": int([project(b).text for b in old.blocks()] != [project(b).text for b in new.blocks()]),
    }


def git_blob(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def select_corpus(letters: DataFrame, least_chars: int = 150, per_bin: int = 10, every: int = 25) -> DataFrame:
    """Letters (letter, chars, gold) for a corpus: every ``every``-th in order, long enough and with a gold span, ``per_bin`` evenly spaced of each quarter of length."""
    from . import samples

    chosen = samples.every_nth(letters, ["letter"], every).where((F.col("chars") >= least_chars) & (F.col("gold") >= 1)).drop("rn")
    cuts = samples.quartile_cuts(chosen, "chars")
    binned = samples.binned(chosen, "chars", cuts)
    parts = [samples.evenly_spaced(binned.where(F.col("bin") == b), ["chars", "letter"], per_bin) for b in (1, 2, 3, 4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("rn")


def markdown(rows: list[dict], title: str) -> str:
    """A table of score rows."""
    head = list(rows[0]) if rows else []
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r[k]) for k in head) + " |" for r in rows]]) + "\n"
