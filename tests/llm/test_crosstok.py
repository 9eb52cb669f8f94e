"""Operator 13 against a brute-force alignment: byte offsets where tokens of both end, all pairs
within a group, documents counted per id pair."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest

from quarry.llm import crosstok

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, pairs string, row int, links int, n_a string"
TEXTS = ["Plain words, don't you think?", "Plain words, don't you think?", "naïve café déjà", None, "",
         " ", "two  spaces   and\ttabs\n\nlines", "日本語 テキスト と English", "▁mark", "x" * 700,
         "☃" * 300 + "a   b", " " * 900, "<s> </s> <unk> <0x41> <|endoftext|>", "\x00\x01 ​",
         "word, " * 4000, "1234567 89.10 %%%", "é ﬁ ½"]


def brute(pair, text):
    """Groups of one text as lists of A ids and B ids."""
    a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = pair.b.encode(text) if text else []
    whole = (" " + (text or "")).encode()
    spell = [b"".join(names[i] for i in ids) for names, ids in (
        (pair.a_bytes, a), (pair.b_bytes, b))]
    if not text or spell != [whole, whole]:
        return []
    ends = []
    for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
        at = 0
        ends.append([at := at + len(names[i]) for i in ids])
    cuts = sorted(set(ends[0]) & set(ends[1]))
    found = [([], []) for _ in cuts]
    for side, (ids, at) in enumerate(((a, ends[0]), (b, ends[1]))):
        for i, e in zip(ids, at):
            found[bisect_left(cuts, e)][side].append(i)
    return found


def expected(pair, rows):
    groups = [brute(pair, r[1]) for r in rows]
    linked = [Counter((x, y) for u, v in g for x in u for y in v) for g in groups]
    held = Counter(p for c in linked for p in c)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for r, g, c in zip(rows, groups, linked):
        told = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g)
        out.append((r[0], sum(len(u) for u, _ in g), sum(len(v) for _, v in g), len(g),
                    sum(c.values()), sum(n for p, n in c.items() if held[p] == most[p[0]]),
                    sum(n * held[p] for p, n in c.items()),
                    hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return out


@pytest.fixture(scope="module")
def pair():
    return crosstok.Pair(A, B)


@pytest.fixture(scope="module")
def rows():
    ids = [None, 7, 7, *range(100, 100 + len(TEXTS) - 3)]
    got = [(i, t, "x", 1, 2, "y") for i, t in zip(ids, TEXTS)]
    return [*got, got[0], got[5]]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("max_broadcast", [crosstok.MAX_BROADCAST_PAIRS, 0])
def test_report_is_the_brute_force_one(spark, pair, rows, max_broadcast):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = crosstok.alignment_report(docs, A, B, max_broadcast)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(pair, rows), key=key)


def test_groups_of_the_tables_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = crosstok.alignment_report(docs, A, B).collect()
    want = expected(pair, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_groups for r in got) > 10_000 and sum(r.n_links > r.n_groups for r in got) > 100


def test_ranks_encode_as_the_merges_do():
    r = random.Random(4)
    pool = ["word", "don't", "naïve", "12", "3.4%", "!?", "'s", "é", "Ωμ", "日本", "\u200b", "x\x1cy", "\x85",
            "\u1680", "<|endoftext|>", "a\u00a0b", "\u00ad", "\n", "\t", "", "ſ", "\u0301", "º", "²", "¾"]
    assert crosstok.Pair(A, B).is_ranked()
    pair = crosstok.Pair(A, B, True)
    texts = ["".join(r.choice(pool) + r.choice([" ", " ", " ", "  ", "", "\n"])
                     for _ in range(r.randint(1, 40))) for _ in range(800)]
    texts += ["".join(chr(r.randrange(0x250)) for _ in range(60)) for _ in range(800)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(500)]
    texts += [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)} {chr(c)}{chr(c)}x" for c in range(0x250)]
    texts += ["x" * 5000, " " * 5000, "\n" * 5000]
    want = [e.ids for e in pair.a.encode_batch_fast([" " + t for t in texts],
                                                    add_special_tokens=False)]
    assert pair._encode_a(texts) == want
    word_level = public_tokenizers.path("word_bpe_49k.json")
    assert not crosstok.Pair(word_level, B).is_ranked()


def test_wide_groups_and_small_slices(pair, monkeypatch):
    """Groups with many links are joined by distinct ids; slices of any size give the same."""
    texts = [t for t in TEXTS for _ in range(2)]
    ids = pair.encode(texts)
    whole = crosstok.Coalesced(pair, ids)
    cut, pairs, links = whole.links()
    monkeypatch.setattr(crosstok, "WIDE", 2)
    for x, y in zip((cut, pairs, links), crosstok.Coalesced(pair, ids).links()):
        assert x.tolist() == y.tolist()
    for k, i in enumerate(ids):
        one = crosstok.Coalesced(pair, [i])
        assert one.digests() == whole.digests()[k:k + 1]
        assert one.links()[1].tolist() == pairs[cut[k]:cut[k + 1]].tolist()


def test_align_gives_the_groups(spark, pair, rows):
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    for r, row in zip(crosstok.align(docs, A, B).collect(), rows):
        want = brute(pair, row[1])
        assert [([i for i, g in zip(r.a_ids, r.a_group) if g == k],
                 [i for i, g in zip(r.b_ids, r.b_group) if g == k])
                for k in range(len(r.group_start))] == want
        at = 0
        for (u, _), start in zip(want, r.group_start):
            assert start == at
            at += sum(len(pair.a_bytes[i]) for i in u)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert crosstok.alignment_report(docs, A, B).count() == 0
    assert crosstok.align(docs, A, B).count() == 0
