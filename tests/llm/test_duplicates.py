"""Substring removal, SimHash groups, nearest neighbours and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import ann, nearcopies, queries, simhash, substring

SF = "/root/testdata/sf0.001"


# -- substrings -------------------------------------------------------------------------------------------------------------------


def plain_removal(rows, window):
    """Kept words of (id, text) rows by comparing all windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice("ab cd ef gh ij kl mn op qr é😀".split())
    passages = [" ".join(word() + str(r.randrange(50)) for _ in range(r.randrange(8, 40))) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = [" ".join(word() + str(r.randrange(50)) for _ in range(r.randrange(0, 12)))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passages), " ".join(word() for _ in range(r.randrange(0, 5)))]
        rows.append((k, r.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(3, rows[4][1]), (7, rows[7][1]), (100, rows[5][1]), (101, "a b " * 40), (102, "a b " * 40), (103, None), (104, ""), (None, passages[0]), (-5, passages[1])]
    return rows


@pytest.mark.parametrize(("seed", "hot", "spans"), [(1, 2000, 10**6), (2, 2000, 0), (3, 1, 10**6), (4, 1, 0)])
def test_substrings(spark, monkeypatch, seed, hot, spans):
    monkeypatch.setattr(substring, "HOT_STRINGS", hot)
    monkeypatch.setattr(substring, "MOST_SPANS", spans)
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, a int")
    got = substring.remove_repeats(df, window=12, passed=["a"])
    assert got.columns == ["doc_id", "a", "n_words", "n_removed", "kept"]
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()], key=str) == plain_removal(rows, 12)


def test_layout_stays_where_nothing_goes(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"begin\n\n  {passage}\nend of one"), (2, f"other  start\n{passage}\n\nother   end\n"), (3, " a\n b ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(df, layout=True).collect()}
    assert got == {1: rows[0][1], 2: "other  start\nother   end", 3: " a\n b "}
    assert substring.remove_repeats(df.where("false")).count() == 0


def test_equal_windows_have_equal_minimisers():
    cache = substring._Hashes()
    words = [f"w{k}".encode() for k in range(200)]
    low = lambda w: substring.minimisers(np.array([cache[x] for x in w], "u8"), 50, 8)
    assert low(words)[30:40].tolist() == low([b"x"] * 5 + words[30:89] + [b"y"])[5:15].tolist()
    for a, n, m in substring.super_kmers(words, cache, 50):
        assert set(low(words)[a : a + n].view("i8").tolist()) == {m}


# -- SimHash ----------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, threshold):
    """Smallest index of each value's component."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= threshold and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One Two", "A b C", "É A b c d É", "x y z " * 30, "\xa0 a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_codes():
    small, large = simhash.extended_bch(6, 10), simhash.extended_bch(5, 16)
    assert (len(small), len(large)) == (1024, 65536)
    assert min(int(x).bit_count() for x in small[1:]) == 28
    assert min(int(x).bit_count() for x in large[1:]) == 8
    assert len(simhash.extended_bch(6, 16)) == 65536


def near(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        v = r.getrandbits(64)
        out.append(v)
        for _ in range(r.randrange(4)):
            for _ in range(r.randrange(5)):
                v ^= 1 << r.randrange(64)
            out.append(v)
    return out


@pytest.mark.parametrize("blocks", [[simhash.extended_bch(6, 10)], [simhash.extended_bch(5, 16)] * 2], ids=["one", "two"])
def test_covering_finds_every_link(blocks):
    values = np.array(near(5, 40), "u8")
    rows, anchors, homes = simhash.cover(values, blocks, 3)
    at = {}
    for r, a, h in zip(rows.tolist(), anchors.tolist(), homes.tolist(), strict=True):
        at.setdefault(a, ([], []))
        at[a][1].append(r)
        if h:
            at[a][0].append(r)
    found = {tuple(sorted((i, j))) for hs, rs in at.values() for i in hs for j in rs if i != j and int(values[i] ^ values[j]).bit_count() <= 3}
    assert found == {(j, i) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert sum(homes) == len(values)


@pytest.mark.parametrize("block", [4096, 2])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "HOME_BLOCK", block)
    monkeypatch.setattr(simhash, "REPLICA_BLOCK", 2 * block)
    values = sorted(set(near(7, 60)))
    df = spark.createDataFrame([(int(np.uint64(v).astype("i8")),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(values))).collect()}
    signed = [int(np.uint64(v).astype("i8")) for v in values]
    groups = {}
    for v, g in zip(signed, plain_groups(values, 3), strict=True):
        groups.setdefault(g, []).append(v)
    want = {v: min(m) for m in groups.values() for v in m}
    assert {v: roots.get(v, v) for v in signed} == want


def test_simhash_edges(spark):
    rows = [(5, "a b c d e"), (3, "A B c d e"), (9, None), (2, " "), (7, "x y"), (7, "x y"), (None, "a b c d e"), (None, "q r s t")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    by = {(i, f): c for i, f, c in got}
    assert by[(5, f"{plain_fingerprint('a b c d e'):016x}")] == 3
    assert by[(9, "0" * 16)] == by[(2, "0" * 16)] == 2
    assert by[(None, f"{plain_fingerprint('a b c d e'):016x}")] == 3
    assert by[(None, f"{plain_fingerprint('q r s t'):016x}")] is None
    assert simhash.near_duplicates(df.where("false")).count() == 0
    kept = sorted(((r["doc_id"], r["text"]) for r in nearcopies.keep_first(df).collect()), key=str)
    assert kept == sorted([(3, "A B c d e"), (2, " "), (7, "x y"), (None, "a b c d e"), (None, "q r s t")], key=str)


def test_simhash_on_a_table(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    values = [plain_fingerprint(t) for _, t in docs]
    want = {i: (f"{v:016x}", docs[g][0]) for (i, _), v, g in zip(docs, values, plain_groups(values, 3), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()} == want


# -- nearest neighbours -------------------------------------------------------------------------------------------------------------


def plain_nearest(ids, vectors, query, k=10):
    d = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(axis=1))
    other = np.flatnonzero(ids != query)
    return [(int(ids[j]), d[j]) for j in other[np.lexsort((ids[other], d[other]))][:k]]


def test_recall_on_a_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], "f8")
    got = {}
    for r in queries.op9_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        want = plain_nearest(ids, vectors, q)
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
        assert all(abs(s - np.sqrt(((vectors[ids == i][0] - vectors[ids == q][0]) ** 2).sum())) < 1e-12 for _, i, s in found)
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_edges(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in r.normal(size=4)]) for k in range(8)] + [(100, [1.0, 0.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0]), (150, [1.0, 0.0, 0.0, 0.0])]
    bad = [(300, None), (400, [0.0] * 4), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan"), 1.0, 0.0, 0.0]), (700, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (800, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, 1) for x in rows + bad], "vec_id long, embedding array<double>, id int")
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert got == {q: plain_nearest(ids, vectors, q) for q in (0, 100, 200)}
    assert ann.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0


def test_hot_vector_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    r = np.random.default_rng(4)
    vectors = r.normal(size=(900, 8))
    vectors[:400] = vectors[0]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert [i for _, i in sorted(got[100])] == list(range(10))
    hits = sum(len({i for i, _ in plain_nearest(np.arange(900), vectors, q)} & {i for _, i in found}) for q, found in got.items())
    assert hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("chunk", [4096, 128])
def test_ids_that_repeat(spark, monkeypatch, chunk):
    """Two rows an id, and one id with a third of all rows, near the queries: each query still gets the nearest distinct ids."""
    monkeypatch.setattr(ann, "CHUNK", chunk)
    r = np.random.default_rng(6)
    vectors = r.normal(size=(160, 8))
    rows = [(k, v) for k, v in enumerate(vectors)] + [(k, v + r.normal(size=8) / 100) for k, v in enumerate(vectors)]
    rows += [(7, vectors[100 * (k % 2)] + r.normal(size=8) / 1000) for k in range(160)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    asked = {q: min(v.tolist() for i, v in rows if i == q) for q in (0, 100)}
    for q, vector in asked.items():
        least = {}
        for i, v in rows:
            if i != q:
                least[i] = min(least.get(i, np.inf), np.sqrt(((v - vector) ** 2).sum()))
        want = sorted(least, key=lambda i: (least[i], i))[:10]
        assert want[0] == 7
        found = [i for _, i in sorted(got[q])]
        assert found == want


def test_recall_where_few_lists_do_not_do(spark, monkeypatch):
    """Vectors without structure, each in one list: the neighbours are in far more lists than the floor."""
    monkeypatch.setattr(ann, "CLOSURE", 1.0)
    r = np.random.default_rng(8)
    vectors = r.normal(size=(10_000, 128))
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    hits = sum(len({i for i, _ in plain_nearest(np.arange(10_000), vectors, q)} & found) for q, found in got.items())
    assert len(got) == 100
    assert hits >= 0.95 * 10 * len(got)


def plain_copies(docs):
    """(ids that aren't their group's smallest, the others): groups of texts with similar sets of five-word shingles, all pairs compared."""
    rows = sorted(docs.items())
    sets = [set(simhash.shingles((t or "").encode(), 5)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if len(x & y) >= 0.8 * len(x | y) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0] for i in range(len(rows)) if find(i) != i}, {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_near_copies(spark):
    r = random.Random(9)
    docs = {}
    for k in range(40):
        words = [f"w{r.randrange(900)}" for _ in range(r.randrange(30, 200))]
        for _ in range(r.randrange(1, 5)):
            docs[len(docs)] = " ".join(words)
            words = list(words)
            words[r.randrange(len(words))] = f"x{r.randrange(900)}"
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(df).collect()}
    gone, stay = plain_copies(docs)
    found = {i for i, c in got.items() if i != c}
    assert found == gone
    assert nearcopies.similarity(b"a b c d e f", b"A  b c d e\nf") == 1.0


def test_rows_that_share_an_id_are_texts_of_their_own(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(1, texts[0], 5), (1, texts[1], 6), (1, texts[1], 7), (2, texts[1] + " more", 8), (3, texts[2], 9), (3, texts[0].upper(), 10), (None, texts[0], 11), (None, None, 12), (4, None, 13), (5, " ", 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row int")
    kept = nearcopies.keep_first(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, texts[0]), (1, texts[1]), (3, texts[2]), (None, texts[0]), (None, None), (4, None)], key=str)
    strings = df.selectExpr("cast(doc_id AS string) AS doc_id", "text")
    assert nearcopies.keep_first(strings).count() == 6
    assert nearcopies.keep_first(df.where("false")).count() == 0


def grouped(spark, docs):
    """(ids that near_copies puts under a smaller one, those that a comparison of all pairs does)."""
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(df).collect()}
    return {i for i, c in got.items() if i != c}, plain_copies(docs)[0]


@pytest.mark.parametrize(("leaders", "wanted"), [(64, 10**6), (2, 0)])
def test_near_copies_in_chains(spark, monkeypatch, leaders, wanted):
    """Revisions one word apart, in the order of ids and not, and the words of a text in other orders, with an outlier as smallest id."""
    monkeypatch.setattr(nearcopies, "MOST_WANTED", wanted)
    monkeypatch.setattr(nearcopies, "LEADERS", leaders, raising=False)
    monkeypatch.setattr(nearcopies, "LEADER_BLOCK", 8, raising=False)
    r = random.Random(21)
    docs = {}
    for chain in range(3):
        words, texts = [f"w{r.randrange(5000)}" for _ in range(200)], []
        for k in range(61):
            texts.append(" ".join(words))
            words[r.randrange(200)] = f"x{chain}_{k}"
        if chain:
            r.shuffle(texts)
        docs.update(enumerate(texts, len(docs)))
    words = [f"v{k}" for k in range(120)]
    for _ in range(4):
        r.shuffle(words)
        docs[len(docs)] = " ".join(words)
    for k in range(40):
        docs[len(docs)] = " ".join([*words[:60], f"y{k}", *words[61:]])
    found, gone = grouped(spark, docs)
    assert len(gone) > 200
    assert found == gone


def test_near_copies_with_blocks(spark):
    """Words appended, put before or cut in one block, with a footer that most texts have, so that similarity is 0.8 or a little more."""
    r = random.Random(22)
    words = lambda n: [f"w{int(r.paretovariate(0.6)) % 30000}" for _ in range(n)]
    footer = words(40)
    docs = {}
    for k in range(150):
        text = words(300)
        if k % 3:
            text += footer
        n = len(text)
        block = r.randrange(n // 25, n // 4)
        at = r.randrange(n - block)
        docs[2 * k] = " ".join(text)
        docs[2 * k + 1] = " ".join([text + words(block), words(block) + text, text[:at] + text[at + block :], text[: n - n // 5]][k % 4])
    found, gone = grouped(spark, docs)
    assert len(gone) > 80
    assert found == gone


# -- pipeline -----------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(corpus_pipeline.materialize(stage(spark, states[-1], SF), name))
        if name != names[-1]:
            assert states[-1].columns == columns
    before = lambda k: {r["doc_id"]: r["text"] for r in states[k].collect()}
    kept = {r["doc_id"] for r in queries.op8_quality_rules(spark, SF).collect() if r["kept"]}
    assert set(before(1)) == kept
    assert set(before(2)) <= kept
    gone, stay = plain_copies(before(2))
    assert set(before(3)) == set(before(2)) - gone
    removed = {i: k for i, _, _, k in plain_removal(sorted(before(3).items()), 50)}
    assert {i: " ".join(t.split()) for i, t in before(4).items()} == {i: " ".join(k.split()) for i, k in removed.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in states[4].collect())
    assert {r["doc_id"] for r in states[5].collect()} == set(removed)
    assert corpus_pipeline.run(spark, SF).count() == states[5].count()


def test_pipeline_stages_take_nulls_and_other_columns(spark):
    long = "This is a clean text of more than ten words about a river and a hill."
    rows = [(1, long, None, 0), (None, long + " Also this.", "s", 1), (2, None, "s", 2), (3, long + " And so on, in other words and other things said here.", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4
