"""Alignment of two tokenizers against whole texts encoded by the libraries, and token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridfold.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "a ", " a ", "a  ", "  a   b  ", "a\n b", "a\n\n \n b \t c", "line one\nline two\r\n\r\nthree", "x  y　 z", "a\x1c b",
    "naïve café — “quoted” it's I'll", "日本語の テキスト と漢字", "a▁b", "▁", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00 nul", "é é", "🙂🙂 👩‍👩‍👧 flags", "0123456789 " * 5,
    "tabs\tand\x0bothers\x0c end", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "ab" * 3000, "word " * 2000, "\n", "\n ", " \n", "مرحبا بالعالم", "ﬁ ﬂ ½",
]


def own_tokens(text):
    """Bytes of the tokens of the whole text, by the libraries; None if they don't join to space + text."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = {c: b for c, b in alignment.byte_letters().items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    ids_b = b.encode(text)
    raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    return (ids_a, raw_a, ids_b, raw_b) if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode() else None


def brute(texts):
    """One row for each text, from all pairs of tokens whose ranges overlap."""
    made, docs = [], Counter()
    for text in texts:
        tokens = own_tokens(text) if text else None
        if tokens is None:
            made.append(None)
            continue
        ids_a, raw_a, ids_b, raw_b = tokens
        ends = lambda raw: [sum(map(len, raw[: k + 1])) for k in range(len(raw))]
        ends_a, ends_b = ends(raw_a), ends(raw_b)
        spans_a, spans_b = list(zip([0, *ends_a], ends_a)), list(zip([0, *ends_b], ends_b))
        links, low = [], 0
        for i, (s, e) in enumerate(spans_a):
            while spans_b[low][1] <= s:
                low += 1
            j = low
            while j < len(spans_b) and spans_b[j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        groups = []
        start = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            inside = lambda ids, spans: ",".join(str(t) for t, (s, e) in zip(ids, spans) if start <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{inside(ids_a, spans_a)}|{inside(ids_b, spans_b)}")
            start = end
        docs.update(set(links))
        made.append((len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if m is None else (m[0], m[1], len(m[2]), len(m[3]), sum(docs[p] == best[p[0]] for p in m[3]), sum(docs[p] for p in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest())
        for m in made
    ]


def texts():
    rng = random.Random(3)
    words = ["stone", "Stone", "unbelievable", "the", "of", "naïve", "x1y2", "état", "don't", "—", "3.14159", "https://a.b/c?d=e", "Привет"]
    return ODD + [rng.choice([" ", "  ", "\n", " \n "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(20)] + ["the same stone"] * 3


@pytest.mark.parametrize("known", [1 << 20, 5, 0])
def test_scores_against_brute_force(spark, monkeypatch, known):
    """With all, some and none of the pairs broadcast; the others are joined."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", known)
    own = texts()
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(own)], "doc_id long, text string, key string").repartition(3)
    found = {r["doc"]: tuple(r)[1:] for r in alignment.score(rows, A, B).collect()}
    expected = brute(own)
    for k, text in enumerate(own):
        assert found[k] == expected[k], repr(text)[:80]


def test_workers_hand_counts_on_and_forget_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "WINDOW", 50)
    monkeypatch.setattr(alignment, "CACHED", 10)
    monkeypatch.setattr(alignment, "TOGETHER", 100)
    own = texts()
    found = alignment.score(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1), A, B).collect()
    assert {r["doc"]: tuple(r)[1:] for r in found} == dict(enumerate(brute(own)))


def test_repeated_and_null_ids_and_nothing(spark):
    """Each row is a document of its own."""
    own = [(7, "the stone"), (7, "the stone"), (None, "the stone"), (None, None)]
    found = alignment.score(spark.createDataFrame(own, "doc_id long, text string"), A, B).collect()
    assert sorted(((r["doc"] is None, r["n_a"], r["count_sum"]) for r in found)) == [(False, 2, 6), (False, 2, 6), (True, 0, 0), (True, 2, 6)]
    empty = alignment.score(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert empty.count() == 0 and empty.columns[0] == "doc"


def test_links_groups_and_products(spark):
    """Columns of the operator's own names give way; a group's ids expand to their product."""
    rows = spark.createDataFrame([(1, "unbelievable 日本", 5), (2, None, 6)], "doc_id long, text string, Links int")
    found = {r["doc_id"]: r for r in alignment.align(rows, A, B).collect()}
    ids_a, raw_a, ids_b, _ = own_tokens("unbelievable 日本")
    assert found[1]["n_a"] == len(ids_a) and found[1]["n_b"] == len(ids_b)
    assert [x >> 32 for x in found[1]["links"]][0] == ids_a[0] and len(found[1]["links"]) >= max(len(ids_a), len(ids_b))
    assert (found[2]["n_a"], found[2]["groups"], found[2]["links"]) == (0, "", [])
    products = [(r["group"], r["a_id"], r["b_id"]) for r in alignment.group_products(alignment.align(rows, A, B)).collect()]
    expected = [(g, int(a), int(b)) for g, one in enumerate(found[1]["groups"].split(";")) for a in one.split("|")[0].split(",") for b in one.split("|")[1].split(",")]
    assert sorted(products) == sorted(expected)
