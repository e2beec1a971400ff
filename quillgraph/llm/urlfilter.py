"""URL filter: rules of hosts and path starts first, else a logistic regression on hashed character n-grams of host and path.

Everything that touches the pages is a DataFrame expression on the page's own row: no shuffle, no Python. The regression is
fitted on the driver from a small labelled table (at most MOST_LABELLED rows), whose features come from the same expressions;
what the pages see of it is an array of ``dimensions`` weights.

A null url, or one without ``://``, has an empty host and path. Urls are judged row by row, so repeated rows get equal
verdicts and an empty table an empty result; very long urls cost time in proportion to their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused
from .quality import bound

DIMENSIONS, SIZES = 4096, (3, 4, 5)
MOST_LABELLED, MOST_RULES = 1000, 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_BAD = """casino-royal online-casino casino-bonus casino-spin grand-casino casino-win win-casino free-bets sports-bets bets-club live-bets bet-win bets-online
cheap-pills buy-pills cheap-meds pills-online diet-pills cheap-viagra adult-cams xxx-adult adult-videos adult-dating adult-x hot-adult spam-links link-farm seo-spam
spam-farm spam-mail content-farm ads-server ad-tracker ads-click click-track track-ads ads-pop win-prizes free-win lottery-win payday-loans quick-loans replica-watches"""
_GOOD = """city-library museum history gardening university weather-report daily-news python-guide the-theatre travelnotes cooking-school townhall research-lab bookshop
thinker thermal athletics another-thing together forest-trail ontheriver handicraft brewery astronomy mathematics language-course weathervane orchestra lighthouse
parish-church bicycle hospital mothering thistle northern-lights stationery trainspotting chess-club furthermore science-fair thunderstorm open-archive heather-moor
national-station action-sports fashion traditions education relations thatched-roof thanks whatthat athens further anthem rhythm wealth earth-science other-side there threads
pilgrim filling-station addresses advice better-living alphabet window-maker winter spinning trackside farmhouse farm-shop freedom freelance linking-words loaning-books"""
_PREFIXES, _PATHS = ("", "www.", "m.", "blog."), ("/en/1", "/de/22.html", "/fr/306", "/es/44/", "/en/7?page=2", "/en/540#top")


def _urls(hosts: str, label: int) -> tuple[tuple[str, int], ...]:
    """Each host with two of the prefixes and paths in turn, so that these say nothing about the label."""
    names = hosts.split()
    return tuple((f"https://{_PREFIXES[(k + j * 2 + k // 4) % 4]}{name}.example{_PATHS[(k + 3 * j) % 6]}", label) for k, name in enumerate(names) for j in (0, 1))


#: The labelled table: 1 for urls to block.
LABELLED: tuple[tuple[str, int], ...] = _urls(_BAD, 1) + _urls(_GOOD, 0)


def host_and_path(url: Column) -> Column:
    """A struct of host (A-Z lower-cased) and path."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.struct(host.alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


def features(host: Column, path: Column, dimensions: int = DIMENSIONS, sizes: tuple[int, ...] = SIZES) -> Column:
    """Distinct buckets (from 1) of the n-grams of host and path, with their ends marked."""

    def bucket(characters: Column, size: int):  # noqa: ANN202
        return lambda i: F.pmod(F.xxhash64(*[F.element_at(characters, i + j) for j in range(size)]), F.lit(dimensions)).cast("int") + 1

    def grams(characters: Column) -> Column:
        n = F.size(characters)
        places = [F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>")) for k in sizes]
        return F.array_distinct(F.concat(*[F.transform(at, bucket(characters, k)) for at, k in zip(places, sizes, strict=True)]))

    characters = F.split(F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$")), "")
    return bound(F.filter(characters, lambda x: x != ""), grams)


def fit(rows: list[tuple[list[int], int]], dimensions: int = DIMENSIONS, rounds: int = 300, rate: float = 2.0, penalty: float = 0.002) -> tuple[float, list[float]]:
    """Bias and weights (index 0 is bucket 1) by full-batch gradient steps; rows are scaled to length 1."""
    bias, weights = 0.0, [0.0] * dimensions
    scaled = [(sorted(set(f)), 1 / math.sqrt(max(1, len(set(f)))), y) for f, y in rows]
    for _ in range(rounds):
        step: dict[int, float] = {}
        total = 0.0
        for f, scale, y in scaled:
            p = 1 / (1 + math.exp(-(bias + scale * sum(weights[i - 1] for i in f))))
            total += y - p
            for i in f:
                step[i - 1] = step.get(i - 1, 0.0) + (y - p) * scale
        n = max(1, len(scaled))
        bias += rate * total / n
        for i, g in step.items():
            weights[i] += rate * (4 * g / n - penalty * weights[i])
    return bias, weights


def train(spark: SparkSession, labelled: tuple[tuple[str, int], ...] = LABELLED, dimensions: int = DIMENSIONS) -> tuple[float, list[float]]:
    """Fit on (url, label) pairs; at most MOST_LABELLED of them."""
    if not 0 < len(labelled) <= MOST_LABELLED:
        raise ValueError(f"1 to {MOST_LABELLED} labelled urls are needed")
    quoted = ", ".join(f"('{u.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', {int(y)})" for u, y in labelled)
    parts = spark.sql(f"SELECT url, label FROM VALUES {quoted} AS t(url, label)").select(host_and_path(F.col("url")).alias("u"), "label")
    rows = parts.select(features(F.col("u.host"), F.col("u.path"), dimensions).alias("f"), "label").collect()
    return fit([(r["f"], r["label"]) for r in rows], dimensions)


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], model: tuple[float, list[float]], url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``score`` (probability of block) to every row.

    ``rules`` are (rule, verdict), as ("example.com/en/", "block"): a rule's text up to the first slash is its host, which fits
    itself and its subdomains, the rest a start of the path. Of the rules that fit, the longest holds; of equals the first by text.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    bias, weights = model
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    out = df.select(*[F.col(f"`{c}`") for c in keep], bound(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), host_and_path).alias(own := unused(keep, "__u")))
    host, path = F.col(own)["host"], F.col(own)["path"]
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    score = F.aggregate(
        F.transform(features(host, path, len(weights)), lambda i: F.element_at(table, i)),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, w: F.struct((a["s"] + w).alias("s"), (a["n"] + 1).alias("n")),
        lambda a: 1 / (1 + F.exp(-(F.lit(bias) + a["s"] / F.sqrt(F.greatest(a["n"], F.lit(1)))))),
    )
    best: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0], r[1] != "block"))
    if ordered:
        listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0].translate(str.maketrans(UPPER, UPPER.lower()))).alias("h"), F.lit("".join(r.partition("/")[1:])).alias("p")) for r, v in ordered])
        fits = F.filter(listed, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
        best = bound(fits, lambda f: F.when(F.size(f) > 0, F.element_at(f, 1)))
    found = unused([*keep, own], "__r")
    judged = out.select(*[F.col(f"`{c}`") for c in keep], own, best.alias(found), score.alias("score"))
    verdict = F.coalesce(F.col(found)["verdict"], F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return judged.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), F.col(found)["rule"].alias("rule"), verdict.alias("verdict"), "score")
