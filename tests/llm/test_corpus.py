"""Operators over a corpus: dedup, joins, mixing, search, outliers; and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridfold.llm import components, jaccard_join, line_dedup, mixing, quality, queries, shingles, topk
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> dict[int, str | None]:
    """Groups of exact and near copies, small sets, a passage that many share, repeated lines, blanks."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n\t", 3: "One", 4: "one", 5: "a b c d", 6: "A B C D"}
    passage = " ".join(word() for _ in range(60))
    for _ in range(30):
        base = [word() for _ in range(rng.choice((6, 9, 12, 20, 40, 150)))]
        for _ in range(rng.choice((1, 1, 2, 5))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                copy[rng.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy) + (f"\n{passage.upper()}\n" if rng.random() < 0.4 else "\nshort")
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(("en", None)), rng.choice(("s0", "s0", "s1", None)), len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("least_hot", [200, 1])
def test_line_dedup(docs, texts, least_hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_HOT", least_hot)
    want = brute.dedup_lines(texts)
    clash = docs.withColumns({"n_lines": F.lit("x"), "key": F.lit(1), "doc": F.lit(2)})
    rows = line_dedup.dedup_lines(clash).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.text or "", r.n_lines, r.n_dropped) == want[r.doc_id]
    assert line_dedup.dedup_lines(docs.filter("false")).count() == 0


def test_line_dedup_of_repeated_and_null_ids(spark):
    rows = [(1, "the same long line\nx"), (1, "the same long line\nx"), (None, "the same long line\ny"), (2, "The Same Long Line \nz\nthe same long line")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "the same long line\nx"), (1, "the same long line\nx"), (2, "z"), (None, "y")], key=str)


def test_line_dedup_tells_a_null_id_from_the_largest(spark):
    rows = [(2**63 - 1, "the same long line\nx"), (None, "the same long line\ny"), (None, "the same long line\ny"), (0, "z")]
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(2**63 - 1, "the same long line\nx", 0), (None, "y", 1), (None, "y", 1), (0, "z", 0)], key=str)


@pytest.mark.parametrize(("boundary", "tight"), [(None, False), (0, False), (60, False), (30, True)])
def test_jaccard_join(docs, texts, boundary, tight, monkeypatch):
    """With `tight`, nothing is broadcast and a box holds a few sets, so that all paths for large tables are taken."""
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "_boundary", lambda sketch, percent: boundary)
    if tight:
        monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
        monkeypatch.setattr(jaccard_join, "BOX", 300)
    want, n = brute.components(texts), {i: len(brute.shingles(t)) for i, t in texts.items()}
    clash = docs.withColumns({"doc": F.lit("x"), "key": F.lit(1), "component": F.lit(2), "id": F.lit(None)})
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_join.join(clash).collect()}
    assert got == {i: (n[i], want[i]) for i in texts}


def test_jaccard_join_of_repeated_and_null_ids_and_nothing(spark):
    top = 2**63 - 1
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "k"), (2, "z"), (2, "A b c d e f"), (None, "q"), (None, None), (None, "p"), (5, "q"), (top, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc, r.n_shingles, r.component) for r in jaccard_join.join(df).collect()), key=str)
    want = [(1, 2, 1), (1, 2, 1), (1, 1, 1), (2, 1, 2), (2, 2, 1), (None, 1, 5), (None, 0, None), (None, 1, top), (5, 1, 5), (top, 1, top)]
    assert got == sorted(want, key=str)
    assert jaccard_join.join(df.filter("false")).count() == 0
    kept = jaccard_join.keep_one(df)
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(1, "a b c d e f"), (1, "k"), (2, "z"), (5, "q"), (top, "p")]


def test_jaccard_join_tells_constructed_words_apart(spark):
    """Words that every polynomial hash modulo 2 ** 64 takes for equal: a Thue-Morse word and its complement."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, "w " + word), (2, "w " + word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {(r.doc, r.component) for r in jaccard_join.join(df).collect()} == {(1, 1), (2, 2)}


def test_jaccard_join_of_a_passage_that_many_unlike_documents_hold(spark):
    """Half of each text is one of three passages; a few are near copies over and above that."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passages = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = [(i, " ".join(word() for _ in range(30)) + " " + passages[i % 3]) for i in range(3000)]
    rows += [(10_000 + i, rows[i][1] + " tail") for i in range(20)]
    got = {r.doc: r.component for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}


def test_jaccard_join_of_texts_over_a_chunk(spark):
    rng = random.Random(6)
    words = [str(rng.randrange(10**6)) for _ in range(200_000)]
    near = [*words[:1000], "x", *words[1001:]]
    far = words[:100_000] + [str(rng.randrange(10**6)) for _ in range(100_000)]
    rows = [(3, " ".join(words)), (4, "\n".join(near)), (5, " ".join(far))]
    assert len(rows[0][1]) > shingles.CHUNK
    got = {(r.doc, r.n_shingles, r.component) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, len(brute.shingles(t)), 5 if i == 5 else 3) for i, t in rows}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    random.Random(3).shuffle(path)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_hashes_follow_the_words():
    for text in corpus().values():
        assert len(shingles.shingle_set(text)) == len(brute.shingles(text))
    a, b = shingles.shingle_set("x A b\tc d e"), shingles.shingle_set("  X a B c D e\n")
    assert (a == b).all()


def targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        room, w = total - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * room / w > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * room / w for s in order}
        full |= over


def test_mixing(docs, texts, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    sizes: dict = {}
    for r in rows:
        assert r.size == len(brute.WORD.findall(texts[r.doc] or "")) and 0 <= r.copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        largest = max(r.size for r in own)
        assert abs(sum(r.copies * r.size for r in own) - want[s]) <= 3 * largest
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.filter("false")).count() == 0
    assert mixing.repeat_rows(docs).count() == sum(r.copies for r in rows)


def exact_topk(rows, k=20):
    vectors = {i: np.floor(64.0 * np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in vectors:
        if q % 20 == 0:
            best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best[:k], 1)}
    return want


@pytest.mark.parametrize("small", [False, True])
def test_topk(spark, small, monkeypatch):
    """With `small`, a cell holds a few vectors, so that there are several cells each way."""
    if small:
        for name, value in (("CANDIDATE_BLOCK", 7), ("QUERY_BLOCK", 2), ("CELL_CANDIDATES", 30), ("CELL_QUERIES", 4), ("LEAST_CELL", 20)):
            monkeypatch.setattr(topk, name, value)
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(90)]
    rows += [(i, [0.5] * 8) for i in range(90, 130)] + [(200, None), (220, [1.0, None]), (240, [float("nan")] * 8), (260, [1.0, 2.0]), (None, [0.1] * 8), (261, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumns({"id": F.lit("x"), "v": F.lit(0), "score": F.lit(1)})
    got = {(r.query_id, r.rank, r.id, r.score) for r in topk.search(df).collect()}
    assert got == exact_topk(rows)
    assert topk.search(df.filter("false")).count() == 0
    assert {(r.query_id, r.rank, r.id, r.score) for r in topk.search(df.filter("vec_id in (0, 1, 2)")).collect()} == exact_topk(rows[:3])


@pytest.mark.parametrize("size", [1e6, 2.0**31, 2.0**40])
def test_topk_of_large_components(spark, size):
    """Products over what doubles hold, and at last components whose greatest product a long doesn't hold though the scores fit."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(10**3)) * (size / 1000) if size < 2**35 or i % 20 else float(rng.randrange(9)), float(rng.randrange(9))]) for i in range(60)]
    if size > 2**35:
        rows += [(1000 + i, [size, 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = set()
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best[:20], 1)}
    if any(s >= 2**63 for *_, s in want):
        with pytest.raises(Exception, match="too large"):
            topk.search(df).collect()
    else:
        assert {(r.query_id, r.rank, r.id, r.score) for r in topk.search(df).collect()} == want


def test_topk_of_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])]
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(20, 1, 4, 32 * 128), (20, 2, 3, 32 * 64), (20, 3, 3, 32 * 64)]


def test_quality_keeps_clean_and_rejects_junk(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(300)]
    junk = [" ".join(word() + "###" for _ in range(100)) for _ in range(20)]
    rows = [(i, t, "en", "s0", 0) for i, t in enumerate(clean + junk)] + [(900, None, None, None, 0), (901, "x " * 80, "en", "s0", 0), (902, " ".join(word() for _ in range(70)), None, "rare", 0)]
    got = {r.doc: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 320))
    assert got[900].base_failed and got[901].base_failed and got[902].kept
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality.chi2_cdf(quality.chi2_quantile(0.975, 5), 5) == pytest.approx(0.975) and quality.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))


def test_small_groups_are_drawn_toward_their_language_and_the_corpus(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = lambda: " ".join(word() for _ in range(rng.randint(60, 300)))
    junk = lambda: " ".join(word() + "###" for _ in range(100))
    rows = [(clean(), "en", "s0") for _ in range(200)] + [(clean(), "xx", "s0"), (clean(), None, None)]
    bad = [(junk(), "en", "s1") for _ in range(20)] + [(junk(), "xx", "s1"), (junk(), None, None)]
    df = spark.createDataFrame([(i, *x, 0) for i, x in enumerate(rows + bad)], SCHEMA).repartition(3)
    got = {r.doc: r for r in quality.judge(df).collect()}
    assert all(r.distance is not None for r in got.values())
    assert {i for i in got if got[i].kept} == set(range(len(rows)))
    few = {r.doc: r for r in quality.judge(df.filter("doc_id < 30")).collect()}
    assert all(r.kept and r.distance is not None for r in few.values())


@pytest.mark.parametrize("percent, copies", [(34, False), (45, False), (34, True), (45, True)])
def test_heavy_contamination_is_rejected(spark, percent, copies):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(200)]
    n = 200 * percent // (100 - percent)
    junk = [" ".join(word() + "#" * rng.randint(0, 5) + "xy" * rng.randint(0, 3) for _ in range(rng.randint(60, 900))) for _ in range(n)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(clean + ([junk[0]] * n if copies else junk))]
    got = {r.doc: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {i for i in got if got[i]} == set(range(200))


def least_determinant(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number taken, centre and covariance of distinct vectors: concentration steps from each start until the determinant falls no further."""
    least, d, n = np.array([s for _, s in quality.VECTOR], float), x.shape[1], len(x)
    quantile = lambda q: 10 * np.sort(np.floor(x / 10), axis=0)[math.ceil(q * n) - 1] + 5
    factor = quality.SUBSET / quality.chi2_cdf(quality.chi2_quantile(quality.SUBSET, d), d + 2)
    found = []
    for s, q in enumerate(quality.STARTS):
        centre, cov, before = quantile(q), np.diag(((quantile(0.75) - quantile(0.25)) / 1.349) ** 2 + least**2), math.inf
        while True:
            far = np.einsum("ij,ij->i", x - centre, np.linalg.solve(cov, (x - centre).T).T)
            bins = np.floor(100 * np.log1p(far)).astype(int)
            near = x[bins <= np.sort(bins)[math.ceil(quality.SUBSET * n) - 1]]
            centre, cov = near.mean(0), factor * np.cov(near.T, bias=True).reshape(d, d) + np.diag(least**2)
            now = np.linalg.slogdet(cov)[1]
            if now >= before:
                break
            before = now
        found.append((now + (quality.TIE if s else 0), s, len(near), centre, cov))
    return min(found, key=lambda f: f[:2])[2:]


def test_verdicts_against_numpy(spark):
    """Every distance and verdict by the whole method restated: groups of 1 to 200 vectors, null names, copies."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda p: " ".join(word() + ("#" if rng.random() < p else "") for _ in range(rng.randint(60, 400)))
    names = [("en", "s")] * 150 + [("en", "t")] * 60 + [("de", "s")] * 30 + [("de", None), (None, "s"), (None, "null"), ("null", "s")]
    rows = [(i, text(rng.choice((0.0, 0.02, 0.9))), *name, 0) for i, name in enumerate(names)]
    rows += [(len(rows) + k, rows[0][1], "en", "s", 0) for k in range(40)] + [(1000, "few words", "en", "s", 0), (1001, None, None, None, 0)]
    got = {r.doc: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    group = {i: (lang, source) for i, _, lang, source, _ in rows}
    vectors = {i: tuple(r[n] for n in quality.NAMES) for i, r in got.items() if not r.base_failed}
    fit = lambda of: (lambda x: least_determinant(np.array(sorted(x), float)))({v for i, v in vectors.items() if of(group[i])})
    drawn = lambda own, up: [(own[0] * a + quality.SHRINK * b) / (own[0] + quality.SHRINK) for a, b in zip(own[1:], up, strict=True)]
    corpus = fit(lambda g: True)[1:]
    language = {lang: drawn(fit(lambda g, lang=lang: g[0] == lang), corpus) for lang in {group[i][0] for i in vectors}}
    final = {g: drawn(fit(lambda x, g=g: x == g), language[g[0]]) for g in {group[i] for i in vectors}}
    limit = quality.chi2_quantile(quality.PASS, len(quality.NAMES))
    assert got[1000].base_failed and got[1001].base_failed and got[1000].distance is None
    for i, v in vectors.items():
        centre, cov = final[group[i]]
        far = float((np.array(v) - centre) @ np.linalg.solve(cov, np.array(v) - centre))
        assert got[i].distance == pytest.approx(far, rel=1e-6, abs=1e-6) and got[i].kept == (far <= limit)
    assert {got[i].kept for i in vectors} == {True, False}


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF)
    kept = {r.doc for r in quality.judge(docs).filter("kept").select("doc").collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == kept
    lined = stages["line_dedup"](spark, good, SF)
    assert lined.columns == docs.columns
    want = brute.dedup_lines({r.doc_id: r.text for r in good.collect()})
    texts = {r.doc_id: r.text for r in lined.collect()}
    assert texts == {i: t for i, (t, _, _) in want.items()}
    unique = stages["jaccard_join"](spark, lined, SF)
    roots = brute.components(texts)
    assert {r.doc_id for r in unique.collect()} == {i for i in texts if roots[i] == i}
    mixed = stages["source_mixing"](spark, unique, SF)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {r.doc: r.copies for r in mixing.mix(unique).collect() if r.copies}
    for r in stages["byte_bpe"](spark, mixed, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)


def test_pipeline_keeps_rows_of_repeated_and_null_ids(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(100)) for _ in range(80)]
    ids = [None] * 5 + [7] * 5 + list(range(100, 170))
    rows = list(zip(ids, clean, strict=True)) + [(None, "x " * 80), (7, "x " * 80)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    pairs = lambda d: sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in d.collect())
    want = sorted((-1 if i is None else i, t) for i, t in rows[:80])
    good = quality.keep_good(df)
    assert pairs(good) == want and good.columns == df.columns
    unique = jaccard_join.keep_one(good.union(good))
    assert pairs(unique) == want and unique.columns == df.columns
    mixed = pairs(mixing.repeat_rows(unique))
    assert set(mixed) == set(want) and max(mixed.count(x) for x in want) <= 2
    assert len(mixed) == 120  # 150 percent of equal sizes


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))
