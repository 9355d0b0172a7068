"""The Kneser-Ney model against plain dictionaries of n-grams."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridfold.llm import hash_arrays, kneser_ney
from tests.llm.brute import WORD, lower


def tokens(text):
    return [*WORD.findall(lower(text or "")), None]


def discounts(counts):
    of = Counter(counts.values())
    n = [of[k] for k in (1, 2, 3, 4)]
    if min(n[:3]) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        if min(d[1:]) > 0 and all(x <= k for k, x in enumerate(d)):
            return d
    return [0, 0.5, 1, 1.5]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.raw = Counter(t for text in texts for t in tokens(text))
        top = Counter()
        for text in texts:
            line = [0] * (order - 1) + tokens(text)
            top.update(tuple(line[k - order + 1 : k + 1]) for k in range(order - 1, len(line)))
        self.levels = {order: top}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.discounts = {k: discounts(v) for k, v in self.levels.items()}
        self.after = {k: defaultdict(list) for k in self.levels}
        for k, v in self.levels.items():
            for g, n in v.items():
                self.after[k][g[:-1]].append(n)

    def p(self, gram):
        if not gram:
            return 1 / (len(self.raw) + 1)
        k, d = len(gram), self.discounts[len(gram)]
        lower_p, ns = self.p(gram[1:]), self.after[k].get(gram[:-1])
        if not ns:
            return lower_p
        n = self.levels[k][gram]
        return max(n - d[min(n, 3)], 0) / sum(ns) + sum(d[min(x, 3)] for x in ns) / sum(ns) * lower_p

    def score(self, text):
        own = tokens(text)
        line = [0] * (self.order - 1) + own
        total, v = sum(self.raw.values()), len(self.raw)
        base = sum(math.log10((self.raw[t] + 1) / (total + v + 1)) for t in own)
        return len(own), sum(self.raw[t] > 0 for t in own), total, base, sum(math.log10(self.p(tuple(line[k - self.order + 1 : k + 1]))) for k in range(self.order - 1, len(line)))


def texts(n=120):
    rng = random.Random(4)
    words = ["the", "The", "of", "a", "stone", "river", "runs", "low", "é", "x y", *(f"w{k}" for k in range(60))]
    line = lambda: rng.choice([" ", "\n", "\t "]).join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40)))
    return [None, "", "  \n", "once", "the " * 700, "Of The OF", *(line() for _ in range(n)), "copied text of four words"] + ["copied text of four words"] * 4


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_scores_against_dictionaries(spark, monkeypatch, order, small):
    """With few and with many ranges, files and windows; frequent contexts are cut by bounds."""
    if small:
        for name, value in (("WINDOW", 300), ("TOGETHER", 200), ("RANGE", 100), ("SAMPLE_PART", 1), ("BYTE", 3)):
            monkeypatch.setattr(kneser_ney, name, value)
    rows = list(enumerate(texts()))
    found = {r["doc"]: r for r in kneser_ney.score_held_out(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), order).collect()}
    out = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2}
    plain = Plain([t for k, t in rows if k not in out], order)
    assert len(found) == len(rows) and out
    for k, text in rows:
        n, known, total, base, score = plain.score(text)
        r = found[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in out, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_bounds_cut_frequent_contexts(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "RANGE", 50)
    monkeypatch.setattr(kneser_ney, "SAMPLE_PART", 1)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts()], "text string"), 2)
    assert len(model.bounds[2][0]) > 5
    assert len(model.edges[2][0]) > 1  # contexts over several ranges
    model.delete()


def test_probabilities_sum_to_one(spark):
    """Over all known words and one unknown, after known and unknown contexts."""
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts()], "text string"), 3)
    words = sorted({t for text in texts() for t in tokens(text) if t})
    for before in ("of the", "never seen", "the"):
        first = kneser_ney.tokens_of(before)[:-1]
        lines = [np.concatenate([first, kneser_ney.tokens_of(w)[:1]]) for w in [*words, "unheard"]] + [np.append(first, kneser_ney.END)]
        total = sum(kneser_ney.probabilities(model, [x])[0][-1] for x in lines)
        assert total == pytest.approx(1, rel=1e-9)
    model.delete()


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rng = random.Random(2)
    after = {k: rng.sample(range(50), 3) for k in range(50)}

    def text():
        k, words = rng.randrange(50), []
        for _ in range(60):
            words.append(f"word{k}")
            k = rng.choice(after[k])
        return " ".join(words)

    rows = spark.createDataFrame([(k, text()) for k in range(300)], "doc_id long, text string")
    found = kneser_ney.score_held_out(rows).filter("held_out").collect()
    assert all(r["score"] > 0.6 * r["base_score"] for r in found) and len(found) > 20


def test_odd_tables(spark):
    """No rows; no rows to learn from; repeated and null ids; columns of the operator's names."""
    assert kneser_ney.score_held_out(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    alone = kneser_ney.score_held_out(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (alone["n_tokens"], alone["n_known"], alone["train_tokens"], alone["base_score"], alone["score"]) == (3, 0, 0, 0.0, 0.0)
    rows = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (4, "a b c", 3), (4, None, 4)], "doc_id long, text string, Score int")
    found = kneser_ney.score_held_out(rows)
    assert found.columns == ["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted(r["n_tokens"] for r in found.collect()) == [1, 3, 3, 4] and not found.filter("held_out").count()
    model = kneser_ney.train(rows, 2)
    assert kneser_ney.score(model, rows).columns == ["doc_id", "text", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    model.delete()


def test_arrays_in_files(tmp_path):
    path = str(tmp_path / "x")
    arrays = {"a": np.arange(5, dtype=np.uint8), "b": np.arange(3, dtype=np.uint64), "c": np.empty(0, np.int64), "d": np.arange(7, dtype=np.uint32)}
    hash_arrays.write_arrays(path, arrays)
    found = hash_arrays.map_arrays(path)
    assert all((found[k] == v).all() and len(found[k]) == len(v) and found[k].dtype == v.dtype for k, v in arrays.items())
    assert hash_arrays.map_arrays(str(tmp_path / "none")) == {}
    values = np.array([1, 3, 5, 5, 9, 2, 4])
    assert hash_arrays.within(values, np.array([0, 0, 5, 7]), np.array([5, 0, 7, 7]), np.array([5, 5, 3, 1])).tolist() == [2, 0, 6, 7]
