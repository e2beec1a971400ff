"""Queries over texts, pages, conversations and labels: evidence, spans, samples, evaluation, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.taken import Taken
from ..functions.text import OccurrenceFinder, context, tokens
from ..operators import samples, scores, spans
from .registry import query
from .star import read


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block, start, end, line): the lines of each text that hold more than spaces, with their offsets."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    return placed.where(F.trim("line") != "").select("doc_id", F.col("pos").alias("block"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("line")).cast("long").alias("end"), "line")


_BLOCKS = """b AS (SELECT doc_id, pos - 1 AS block, line, start, start + length(line) AS "end" FROM (
  SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE trim(line, ' ') <> '')"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    needles = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return spans.passages(docs, needles)


_FOUND = "f AS (SELECT doc_id, item_id, d.text, strpos(d.text, b.text) - 1 AS start, strpos(d.text, b.text) - 1 + length(b.text) AS \"end\" FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


@query(f"""WITH {_FOUND} SELECT doc_id, item_id, start, "end", nullif(substr(text, greatest(start - 32, 0) + 1, least(start, 32)), '') AS prefix, nullif(substr(text, "end" + 1, 32), '') AS suffix FROM f""")
def q2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of passages: position and quotation selectors, with optional text before and after."""
    found = _passages(spark, sf_dir).withColumn("c", context(F.col("text"), F.col("start"), F.col("end")))
    return found.select("doc_id", F.col("needle_id").alias("item_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "c.prefix", "c.suffix").orderBy("doc_id", "item_id")


@query(f"""WITH {_FOUND} SELECT doc_id, item_id, substr(text, greatest(start - 45, 0) + 1, least(start, 45)) || '[' || substr(text, start + 1, "end" - start) || ']' || substr(text, "end" + 1, 45) AS quoted FROM f""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span with 45 characters around it."""
    found = _passages(spark, sf_dir).withColumn("c", context(F.col("text"), F.col("start"), F.col("end"), 45))
    whole = F.concat(F.coalesce("c.prefix", F.lit("")), F.lit("["), F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")), F.lit("]"), F.coalesce("c.suffix", F.lit("")))
    return found.select("doc_id", F.col("needle_id").alias("item_id"), whole.alias("quoted"))


@query(f"""WITH {_FOUND}, {_BLOCKS} SELECT f.doc_id, item_id, f.start AS position, b.block, b.start AS block_start FROM f LEFT JOIN b ON b.doc_id = f.doc_id AND f.start >= b.start AND f.start < b."end" """)
def asof_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block in which each passage starts."""
    points = _passages(spark, sf_dir).select("doc_id", F.col("needle_id").alias("item_id"), F.col("start").cast("long").alias("position"))
    found = spans.segment_at(points, blocks(spark, sf_dir).select("doc_id", "block", "start", "end"), ["doc_id"], "position", 4096)
    return found.select("doc_id", "item_id", "position", F.col("s_block").cast("long").alias("block"), F.col("s_start").alias("block_start"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS token, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+'), 1) AS pos FROM documents)
SELECT doc_id, pos::BIGINT AS position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM t WHERE lower(token) = 'the') WHERE n = 3""")
def nth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the third 'the' among each text's words."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).where(F.lower("token") == "the")
    nth = words.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("n = 3")
    return nth.select("doc_id", (F.col("pos") + 1).cast("long").alias("position"))


@query("""WITH n AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS total FROM documents),
k AS (SELECT DISTINCT round_even(i * ((SELECT max(total) FROM n) - 1) / 9.0, 0)::BIGINT + 1 AS rn FROM range(10) r(i))
SELECT doc_id, n_chars, rn FROM n JOIN k USING (rn)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents at even distances in order of length."""
    return samples.evenly_spaced(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 10).select("doc_id", "n_chars", "rn")


@query("""WITH v AS (SELECT list(n_chars ORDER BY n_chars) AS l, count(*) AS n FROM documents)
SELECT doc_id, n_chars, 1 + (n_chars > l[n // 4 + 1])::INT + (n_chars > l[n * 2 // 4 + 1])::INT + (n_chars > l[n * 3 // 4 + 1])::INT AS bin FROM documents, v""")
def quartile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of length by cuts at exact ranks."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return samples.binned(docs, "n_chars", samples.quartile_cuts(docs, "n_chars"))


@query("SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS rn FROM documents) WHERE (rn - 1) % 25 = 0")
def every_25th(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 25th document in order of source and id."""
    return samples.every_nth(read(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], 25).select("doc_id", "rn")


@query("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 10")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents, one language after the other."""
    return samples.in_turn(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 10).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return joined.where("toxic = 1").select("doc_id", "lang"), joined.where("n_chars < 1000").select("doc_id", "lang")


_PRF = """WITH j AS (SELECT doc_id, lang, toxic, (n_chars < 1000)::INT AS guess FROM labels JOIN documents USING (doc_id)),
c AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, sum(toxic)::BIGINT AS gold, sum(guess)::BIGINT AS predicted, sum(toxic * guess)::BIGINT AS common
  FROM j WHERE toxic = 1 OR guess = 1 GROUP BY ROLLUP (lang)),
r AS (SELECT *, coalesce(common / nullif(predicted, 0), 0)::DOUBLE AS p, coalesce(common / nullif(gold, 0), 0)::DOUBLE AS r FROM c)"""


@query(_PRF + " SELECT lang, gold, predicted, common, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM r")
def prf_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by language and in all."""
    gold, guessed = _gold(spark, sf_dir)
    out = scores.prf(scores.multiset_matches(gold, guessed, ["doc_id", "lang"], "lang"), "lang")
    return out.select("lang", "gold", "predicted", "common", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH j AS (SELECT lang, CASE WHEN toxic = 1 AND n_chars < 1000 THEN 'hit' WHEN toxic = 1 THEN 'missed' WHEN n_chars < 1000 THEN 'spurious' ELSE 'none' END AS category FROM labels JOIN documents USING (doc_id))
SELECT coalesce(lang, 'all') AS lang, coalesce(category, 'all') AS category, count(*)::BIGINT AS n FROM j GROUP BY CUBE (lang, category)""")
def error_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by language, by class, by both and in all."""
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    guess = F.col("n_chars") < 1000
    category = F.when((F.col("toxic") == 1) & guess, "hit").when(F.col("toxic") == 1, "missed").when(guess, "spurious").otherwise("none")
    cubed = joined.withColumn("category", category).cube("lang", "category").agg(F.count(F.lit(1)).alias("n"))
    return cubed.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("category", F.lit("all")).alias("category"), "n")


@query(r"""SELECT lang, count(*)::BIGINT AS docs, count(*) FILTER (contains(text, chr(10)))::BIGINT AS multi, count(*) FILTER (regexp_matches(text, '[0-9]'))::BIGINT AS digits,
  count(*) FILTER (n_chars < 150)::BIGINT AS short FROM documents GROUP BY lang""")
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of structure, as conditional sums in one pass."""
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.contains("text", F.lit("\n"))).alias("multi"), F.count_if(F.col("text").rlike("[0-9]")).alias("digits"), F.count_if(F.col("n_chars") < 150).alias("short"))


_TERMS = {"PER": ["the", "of", "und"], "LOC": ["die", "que", "re"], "ORG": ["les", "th"]}


@query()
def glossary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of glossary terms in the blocks of texts, and of those that overlap the best: (doc_id, block, start, end, kind)."""
    return glossary_matches(blocks(spark, sf_dir).select("doc_id", "block", F.col("line").alias("text")), _TERMS)


def glossary_matches(texts: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """Non-overlapping occurrences in texts (doc_id, block, text): longest first, then by start and kind; a block is one task's own work."""
    import pandas as pd

    def run(batches):  # noqa: ANN001, ANN202
        finder = OccurrenceFinder(terms)
        for batch in batches:
            rows = []
            for doc, block, text in zip(batch["doc_id"], batch["block"], batch["text"], strict=True):
                taken = Taken()
                found = sorted(finder.find(text or ""), key=lambda x: (x[0] - x[1], x[0], x[2]))
                rows += [(doc, block, a, b, kind) for a, b, kind in found if taken.take(a, b)]
            yield pd.DataFrame(rows, columns=["doc_id", "block", "start", "end", "kind"])

    return texts.mapInPandas(run, "doc_id long, block int, start int, end int, kind string")


@query(r"""SELECT kind, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM (
  SELECT doc_id, CASE WHEN t IN ('the', 'of', 'und') THEN 'PER' WHEN t IN ('die', 'que', 're') THEN 'LOC' WHEN t IN ('les', 'th') THEN 'ORG' END AS kind
  FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS t FROM documents)) WHERE kind IS NOT NULL GROUP BY kind""")
def glossary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a glossary, counted among the words of texts."""
    listed = [(t, k) for k, group in _TERMS.items() for t in group]
    kind = F.coalesce(*[F.when(F.col("t") == t, k) for t, k in listed])
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(tokens(F.col("text")), lambda w: F.lower(w))).alias("t"))
    return words.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(r"""SELECT page_id, n::BIGINT AS position, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS n FROM pages)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, in order."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return pages.select("page_id", (F.col("pos") + 1).cast("long").alias("position"), "href")


@query("""SELECT l.doc_id, d.lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN toxic = 1 THEN 'rejected' ELSE 'open' END AS decision, (d.doc_id IS NOT NULL) AS bound
FROM labels l LEFT JOIN documents d USING (doc_id)""")
def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions joined to what they decide on."""
    decision = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("toxic") == 1, "rejected").otherwise("open")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(True).alias("found"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id", "left").select("doc_id", "lang", decision.alias("decision"), F.coalesce("found", F.lit(False)).alias("bound"))


@query("""SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, coalesce(lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), -1)::INT AS next_length FROM conversations""")
def conversation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who answers whom."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(order).alias("next_role"), F.coalesce(F.lead(F.length("text")).over(order), F.lit(-1)).alias("next_length"))


@query("SELECT source, count(*)::BIGINT AS n, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each source's texts in order; only 64 characters a text are brought together."""
    hashed = read(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"]), "")
    return hashed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sha2(listed.cast("binary"), 256).alias("digest"))
