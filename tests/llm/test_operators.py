"""Training-data operators against brute force on small fixtures that hold the awkward cases:
nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import (common, decontam, embeds, langid, licenses, minhash, mixing, quality,
                        spans, tokencount, tokenfile)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BPE = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def corpus(seed=3, n=60):
    """Random documents with near copies, exact copies, nulls, blanks and one very long text."""
    r = random.Random(seed)
    vocab = ["wörd%d" % i for i in range(30)] + ["Alpha", "beta.", "γάμμα", "the", "of"]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    rows = []
    for i in range(n):
        t = text(r.randint(1, 60))
        if i % 5 == 1:
            w = rows[-1][1].split(" ") if rows[-1][1] else ["x"]
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 11 == 2:
            t = rows[-1][1]
        rows.append((i, t, r.choice(["aa", "bb", None]), r.choice(["s1", "s2", None]), 0))
    rows += [(100, None, "aa", "s1", 0), (101, "", "aa", "s1", 0), (102, " \n\t", None, None, 0),
             (103, text(4000), "aa", "s2", 0), rows[3], rows[3], (104, "Ωmega", "bb", "s2", 0),
             (105, "one two three", "bb", "s2", 0), (106, "ONE two  three", "bb", "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


# ------------------------------------------------------------------ helpers


def test_word_hashes_follow_the_words():
    r = random.Random(1)
    for table, pattern in ((common.SPACED, SPACED), (common.ALNUM, ALNUM)):
        seen = {}
        for _ in range(300):
            s = "".join(r.choice("aBz09 .\n\tÉß漢$/") for _ in range(r.randint(0, 40)))
            want = pattern.findall(lower(s))
            h, a, b = common.words(s.encode(), table)
            raw = s.encode()
            assert [lower(raw[x:y].decode()) for x, y in zip(a, b)] == want
            for w, x in zip(want, h.tolist()):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("abc déf " * 500).encode()
    whole = common.words(text, common.SPACED)
    monkeypatch.setattr(common, "_SEGMENT", 101)
    for x, y in zip(whole, common.words(text, common.SPACED)):
        assert (x == y).all()


def test_connected_components(spark):
    r = random.Random(5)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(200, i) for i in
                                                                       range(100, 200)]
    got = {x.node: x.comp for x in common.connected_components(
        spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    ids = {i for a, b in links if a != b for i in (a, b)}
    want = components({i for x in links for i in x}, links)
    assert got == {i: want[i] for i in ids}


def test_sum_vectors_in_levels(spark):
    df = spark.range(50).repartition(7).selectExpr("id", "id % 2 as k").mapInPandas(
        lambda it: (p.assign(v=[np.full(3, i).tobytes() for i in p["id"]])[["k", "v"]]
                    for p in it), "k long, v binary")
    got = {r.k: np.frombuffer(r.v, np.int64).tolist()
           for r in common.sum_vectors(df, "k", "v", fan_in=4).collect()}
    assert got == {0: [600] * 3, 1: [625] * 3}


# ------------------------------------------------------------------ 1


def shingle_set(t, k=4):
    w = SPACED.findall(lower(t))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(docs):
    rows = corpus()
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = minhash.near_duplicates(docs.withColumn("node", F.lit(1)).withColumn(
        "kept", F.lit("x")), shingle_words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        (r[0], len(sets[r[0]]), want[r[0]], want[r[0]] == r[0]) for r in rows)
    kept = minhash.deduplicated(docs, shingle_words=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        i for i in sets if want[i] == i)


def test_near_duplicates_without_a_hub(spark):
    """A chain of texts, each near the next: the star links some, the blocks the rest."""
    words = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(words[3 * i: 3 * i + 100])) for i in range(60)]
    rows += [(None, rows[0][1]), (900, None)]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(
        rows, "doc_id long, text string"), shingle_words=4).collect()}
    assert {got[i].component_id for i in range(60)} == {0}
    assert got[None].component_id == 0 and got[900].component_id == 900


def test_min_max_estimate():
    r = np.random.default_rng(0)
    a, b = minhash._multipliers(200)
    x = r.integers(1, 2**63, 900, dtype=np.uint64)
    one, two = minhash.min_max(x[:800], a, b), minhash.min_max(x[100:], a, b)
    est = np.mean([np.mean(p == q) for p, q in zip(one, two)])
    assert abs(est - 700 / 900) < 0.08


# ------------------------------------------------------------------ 2


def test_near_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = base[i % 12] + r.normal(size=16) * r.choice([0.05, 0.3, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 17 else None))
    rows += [(300, rows[5][1], rows[5][2]), (301, None, 1), (302, [0.0] * 16, 1),
             (303, [float("nan")] * 16, 1), (304, [1.0, None], 1), (305, [1.0, 2.0], 1),
             (306, [2.0, 4.0], 1), (307, [], 1)]
    ok = {i: np.array(v) for i, v, label in rows if label is not None and v
          and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b]
             and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / np.sqrt(ok[a] @ ok[a]) / np.sqrt(ok[b] @ ok[b]) >= 0.93]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeds.near_vectors(df).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values()) / 2
    assert found <= len(links) and found >= 0.95 * len(links)
    want = components([x[0] for x in rows], links)
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.95
    assert got[305].n_links == 1 and got[301].n_links == 0 and got[300].n_links >= 1
    assert embeds.near_vectors(df.limit(0)).count() == 0


def planted(kind, n=300, d=64, seed=9):
    """Pairs at cosine 0.93 to 0.95 of one label in 64 dimensions."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.normal(size=(n, d))), unit(rng.normal(size=(n, d)))
    if kind == "common":            # all share a direction, as embeddings do
        mean = unit(rng.normal(size=(1, d)))
        a = unit(0.3 * a + 0.7 * mean)
    if kind == "clusters":          # tight groups of ten
        a = unit(np.repeat(a[:n // 10], 10, axis=0) + 0.3 * a)
    b = unit(b - np.einsum("ij,ij->i", a, b)[:, None] * a)
    c = rng.uniform(0.9301, 0.95, (n, 1))
    return np.concatenate((a, c * a + np.sqrt(1 - c * c) * b))


@pytest.mark.parametrize("kind", ["even", "common", "clusters", "hot"])
def test_recall_of_planted_links(spark, kind):
    x = planted(kind)
    label = np.zeros(len(x), int) if kind == "hot" else np.arange(len(x)) % (len(x) // 2) % 3
    rows = [(i, [float(c) for c in e], int(k)) for i, (e, k) in enumerate(zip(x, label))]
    if kind == "hot":               # and one vector of a third of all rows
        rows += [(1000 + i, rows[5][1], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (y @ y.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in embeds.near_vectors(df).collect()}
    n, found = int(link.sum()), sum(r.n_links for r in got.values())
    assert n >= 500 and 0.9 * n <= found <= n
    want = components(range(len(rows)), list(zip(*np.nonzero(link))))
    same = sum(got[r[0]].component_id == rows[want[i]][0] for i, r in enumerate(rows))
    assert same >= 0.9 * len(rows)
    if kind == "hot":
        assert got[5].n_links >= 300 and got[1007].component_id <= 5


def test_links_at_the_bound_and_small_blocks(spark, monkeypatch):
    """Counts don't depend on the blocks; a cosine of exactly the threshold links."""
    x = planted("clusters", 100)
    df = spark.createDataFrame([(i, [float(c) for c in e], 0) for i, e in enumerate(x)],
                               "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, embeds.near_vectors(df).collect()))
    monkeypatch.setattr(embeds, "BLOCK", 16)
    assert sorted(map(tuple, embeds.near_vectors(df).collect())) == whole
    two = spark.createDataFrame([(1, [24.0, 7.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)],
                                "vec_id long, embedding array<double>, label int")
    a, b = embeds.units(np.array([[24.0, 7.0], [1.0, 0.0]]))
    got = {r.vec_id: r.n_links for r in embeds.near_vectors(
        two, cosine=float(np.einsum("i,i", a, b)), shared=1).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


# ------------------------------------------------------------------ 3


def test_license_scan(spark):
    texts = ["Released under the MIT License.", "the license: mit\nLicense mit license, MIT license",
             None, "", "Licensed under CC BY-NC 4.0.\nall rights reserved", "cc by cc by",
             "x " * 3000 + "Apache License", "license apache", "cc. By"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(
        df.withColumn("labels", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        w = ALNUM.findall(lower(t))
        at = sorted((j, label) for p, label in licenses.PHRASES.items()
                    for j in range(len(w)) if w[j:j + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None,
            ",".join(sorted({x for _, x in at})))
        blocks = [ALNUM.findall(lower(b)) for b in re.split(r"\n|[.!?]+(?=\s)", t or "")]
        met = {label for tpl, label in licenses.TEMPLATES.items() for b in blocks
               if len(set(b) & set(ALNUM.findall(tpl))) >= 0.8 * len(set(ALNUM.findall(tpl)))}
        assert {b.label for b in r.blocks} == met
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert "cc-by-nc-4.0" in got[4].labels and "reserved" in got[4].labels


def test_license_notices_over_lines_and_side_by_side(spark):
    want = {
        "Redistribution and use in source and binary forms, with or without\nmodification, are "
        "permitted provided that": {"bsd-grant"},
        "# Redistribution and use in\r\n# source and binary forms,\n# with or without\n"
        "# modification, are permitted": {"bsd-grant"},
        "Permission is hereby granted, free of\ncharge, to any person obtaining\na copy":
            {"mit-grant"},
        "Redistribution and use in source and binary forms, with or without\n \nmodification, are "
        "permitted": set(),
        "Redistribution and use in source and binary forms, with or without.\nmodification, are "
        "permitted": set(),
        "All rights reserved, released under the MIT License": {"mit", "mit-notice", "reserved"},
        "All rights reserved\nReleased under the\nMIT License": {"mit", "mit-notice", "reserved"},
        "Licensed under CC BY-NC 4.0": {"cc-by", "cc-by-nc-4.0"},
        "Licensed under CC BY 4.0": {"cc-by", "cc-by-4.0"},
        "Licensed under CC BY-\nSA 4.0": {"cc-by", "cc-by-sa-4.0"},
        "Licensed under CC BY 4\nNC 0": {"cc-by", "cc-by-nc-4.0"},
        "Licensed under CC BY-NC 4.0, some files licensed under CC BY 4.0":
            {"cc-by", "cc-by-nc-4.0", "cc-by-4.0"},
        "Licensed under the Apache License, Version 2.0, or under the MIT License":
            {"apache", "apache-2.0", "mit", "mit-notice"},
        "komm mit\nLicensed under the Apache License, Version 2.0\n" * 2: {"apache", "apache-2.0"},
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, labels in enumerate(want.values()):
        assert got[i].labels == ",".join(sorted(labels)), i
        assert got[i].score == (1.0 if labels else 0.0), i


# ------------------------------------------------------------------ 4, 5


def test_language_id(spark, empty):
    r = random.Random(2)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "kléñß"}
    rows = []
    for i in range(400):
        lang = r.choice(sorted(kinds))
        rows.append((i, " ".join("".join(r.choice(kinds[lang]) for _ in range(5))
                                 for _ in range(r.randint(1, 30))), lang, "s", 0))
    rows += [(500, None, "aa", None, 0), (501, "123 $!", "aa", None, 0), (502, "", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x for x in langid.language_id(df).collect()}
    truth = {x[0]: x[2] for x in rows}
    held = [x for x in got.values() if x.held_out and x.doc_id < 400]
    assert held and all(x.lang_pred == truth[x.doc_id] for x in held)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got.values())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    kept = langid.identified(df.withColumn("score", F.lit("x")))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(400))
    assert langid.language_id(empty).count() == 0


def test_language_rows_in_blocks_are_those_of_each_text(monkeypatch):
    r = random.Random(5)
    texts = ["", None, "x", "!"] + ["".join(r.choice("abcé ß,1") for _ in range(r.randint(1, 300)))
                                    for _ in range(60)]
    whole = [langid.gram_counts(t) if t else np.zeros(langid.BUCKETS, np.int64) for t in texts]
    for block in (1, 40, 500, 1 << 16):     # every text by itself, some long, all in one block
        got = np.zeros((len(texts), langid.BUCKETS), np.int64)
        for numbers, starts, ids, counts in langid.sparse_rows(texts, block):
            at = np.repeat(numbers, np.diff(np.append(starts, len(ids))))
            np.add.at(got, (at, ids), 1 if counts is None else counts)
        assert (got == np.array(whole)).all()
    text = "".join(r.choice("abcé ß,1") for _ in range(350))
    norm = " " + langid._GAP.sub(" ", text.lower()) + " "
    assert langid.gram_counts(text).sum() == sum(len(norm) - j for j in range(3))
    once = langid.gram_counts(text)
    for size in (1, 2, 3, 50):
        monkeypatch.setattr(langid, "_SEGMENT", size)
        assert (langid.gram_counts(text) == once).all()


def test_language_model_against_brute_force():
    train = [("aa", "abc abd"), ("aa", "abb"), ("bb", "xyz xyy"), ("bb", None)]
    v = {}
    for lang, text in train:
        c = v.setdefault(lang, np.zeros(langid.BUCKETS + 1, np.int64))
        c[-1] += 1
        c[:-1] += langid.gram_counts(text) if text else 0
    model = langid.Model(sorted(v), np.array([v[x] for x in sorted(v)]))
    texts = ["abc", "xyz abc xyz", None, "12", "", "abc", "ab" * 50_000]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        if not text or not any(x.isalpha() for x in text):
            assert (lang, score) == ("und", 0.0)
            continue
        ll = [float(sum(n * lp for n, lp in zip(langid.gram_counts(text).tolist(),
                                                model.logp[i].tolist()) if n)) + model.prior[i]
              for i in range(2)]
        best = int(ll[1] > ll[0])
        assert lang == model.langs[best]
        assert abs(score - 1 / (1 + np.exp(min(ll) - max(ll)))) < 1e-9
    assert scores[0] == scores[5]           # equal texts score alike
    alone = [model.predict([t]) for t in texts]
    assert [x[0][0] for x in alone] == langs and [x[1][0] for x in alone] == scores


def test_mix_shards_are_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power of two"):
        mixing.shard_map(spark.range(1), shards=10)


def test_quality(spark, empty):
    r = random.Random(6)
    good = ["word%d" % i for i in range(40)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        rows.append((i, " ".join((r.choice(good) + (" %%%" if bad else ""))
                                 for _ in range(r.randint(5, 60))), None, None, 0))
        if i % 5:
            labels.append((i, 0 if bad else 1))
    rows += [(600, None, None, None, 0), (601, "", None, None, 0)]
    lab = spark.createDataFrame(labels + [labels[0]], "doc_id long, quality int")
    df = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x for x in quality.classify(df, lab).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 500]
    assert np.mean([x.predicted == (x.doc_id % 4 != 0) for x in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())
    assert got[600].score == got[601].score
    assert quality.classify(empty, lab).count() == 0
    assert quality.classify(df, lab.limit(0)).count() == len(rows)


# ------------------------------------------------------------------ 6


@pytest.mark.parametrize("block_words", [decontam.BLOCK_WORDS, 60])
def test_contamination(spark, docs, block_words):
    rows = corpus()
    items = [(1, rows[0][1]), (2, rows[103 - 100 + 60][1][:900] if rows[63][1] else ""),
             (3, "wörd1"), (4, None), (5, ""), (6, "no such words here at all in any text ok"),
             (1, "second text of item one"), (None, "wörd2 wörd3"), (7, "one two")]
    items = [(i, t) for i, t in items]
    wins = {(i if i is None else str(i), tuple(w[j:j + min(10, len(w))])) for i, t in items
            for w in [ALNUM.findall(lower(t))] if w
            for j in range(len(w) - min(10, len(w)) + 1)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(docs, bench, block_words=block_words).collect()
    assert len(got) == len(rows)
    by = {r[0]: ALNUM.findall(lower(r[1])) for r in rows}
    for r in got:
        w, hit, found = by[r.doc_id], set(), set()
        for item, x in wins:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j:j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    found.add(item)
        named = sorted(i for i in found if i is not None)
        assert (r.n_words, r.n_hit, r["items"], r.n_items) == (len(w), len(hit), named, len(found))
        assert sum(s.end - s.start for s in r.spans) == len(hit)
    clean = {r.doc_id for r in got if r.n_hit == 0}
    assert {r.doc_id for r in decontam.uncontaminated(docs, bench).collect()} == clean


# ------------------------------------------------------------------ 7


def test_spans(spark, empty):
    p = ("Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi. "
         "Rho sigma tau upsilon phi chi psi omega! One two three four five six seven eight nine.")
    rows = [(1, "Unique start here. " + p + " Unique end."), (2, "Other text.\n" + p),
            (3, p), (3, p), (4, None), (5, ""), (6, "Nothing in common with it. At all."),
            (7, "Alpha beta gamma delta epsilon zeta eta theta. But then it goes on otherwise."),
            (None, p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans.dedup_spans(df.withColumn("removed", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == 0 and by[1].text == rows[0][1]
    assert by[2].n_removed == 4 and by[2].text.startswith("Other text.")
    assert by[3].n_removed == by[3].n_sentences == 4 and by[None].n_removed == 4
    assert by[4].text is None and by[5].n_sentences == 0 and by[6].n_removed == 0
    assert by[7].n_removed == 0
    assert spans.dedup_spans(empty).count() == 0


# ------------------------------------------------------------------ 8


def all_runs(texts, min_sentences=2, min_words=24, long_words=50):
    """Covered sentences by brute force over every run, not only the shortest ones."""
    cut = [[re.findall(r"\w+", x) for x in t.split("\n")] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, parts in enumerate(cut):
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                k = sum(map(len, parts[i:j]))
                if (j - i >= min_sentences and k >= min_words) or (j == i + 1
                                                                   and k >= long_words):
                    run = tuple(tuple(x) for x in parts[i:j])
                    if run in seen:
                        gone[d].update(range(i, j))
                    seen.add(run)
    return [sorted(g) for g in gone]


def test_spans_cover_what_any_longer_run_covers(spark):
    r = random.Random(8)
    sentence = lambda k: " ".join("w%d" % r.randrange(10**6) for _ in range(k))
    texts = []
    for lengths in ([12, 15, 10, 8], [60, 5], [5, 60], [30, 3], [3, 30, 2, 2], [49, 1, 1],
                    [8, 8, 8], [23, 1], [70, 20], [20, 70], [1, 55, 1, 55, 1],
                    *([r.choice([1, 2, 5, 8, 12, 23, 30, 55]) for _ in range(r.randint(2, 9))]
                      for _ in range(20))):
        passage = [sentence(k) for k in lengths]
        texts += ["\n".join([sentence(9), *passage, sentence(7)]) for _ in range(2)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x for x in spans.dedup_spans(df).collect()}
    assert [got[d].removed for d in range(len(texts))] == all_runs(texts)
    assert got[1].removed == [1, 2, 3, 4] and got[3].removed == [1, 2]


def test_spans_take_texts_in_small_batches_and_write_few_files(spark, monkeypatch):
    """A worker gets a few MB of texts at a time, whatever a batch holds; of 64 shuffle partitions
    that adaptive execution leaves apart no table is written in more files than there are cores."""
    r = random.Random(9)
    passage = "\n".join(" ".join("p%d" % r.randrange(10**6) for _ in range(30)) for _ in range(3))
    texts = ["\n".join([" ".join("w%d" % r.randrange(10**6) for _ in range(3000)), passage,
                        "x%d" % i]) for i in range(500)]
    most = 2 * common.BATCH_BYTES
    assert sum(map(len, texts)) > most
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    files = {}

    def counted(df, name, stored=spans.stored):
        out = stored(df, name)
        files[name] = len(out.inputFiles())
        return out

    def watched(run):
        def checked(batches):
            def seen():
                for batch in batches:
                    assert batch.nbytes <= most, batch.nbytes
                    yield batch
            yield from run(seen())
        return checked
    make, remover = spans._run_rows, spans._remover
    monkeypatch.setattr(spans, "stored", counted)
    monkeypatch.setattr(spans, "_run_rows", lambda options: watched(make(options)))
    monkeypatch.setattr(spans, "_remover", watched(remover))
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for conf in ({"spark.sql.shuffle.partitions": "1"},
                 {"spark.sql.shuffle.partitions": "64", **off}):
        before = {c: spark.conf.get(c) for c in conf}
        try:
            for c, v in conf.items():
                spark.conf.set(c, v)
            out = counted(spans.dedup_spans(df), "result")
            got = {x.doc_id: x for x in out.collect()}
        finally:
            for c, v in before.items():
                spark.conf.set(c, v)
        assert len(got) == 500 and got[0].text == texts[0] and got[0].n_sentences == 5
        assert all(got[d].removed == [1, 2, 3] and got[d].n_removed == 3
                   and got[d].text == texts[d].replace(passage + "\n", "")
                   for d in range(1, 500))
        assert set(files) == {"spans-runs", "spans-firsts", "spans-cover", "result"}
        assert max(files.values()) <= spark.sparkContext.defaultParallelism


def test_mixing(spark, docs, empty):
    rows = corpus()
    got = mixing.taken(docs.withColumn("size", F.lit("x")).withColumn("place", F.lit(1))).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(SPACED.findall(r[1] or "")) for r in rows}
    src = {r[0]: r[3] for r in rows}
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight = dict(zip(names, [3, 1, 2]))
    want, free, budget = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * total[s]
            budget -= want[s]
            free.remove(s)
    want |= {s: level * weight[s] for s in free}
    for r in got:
        assert (r["size"], r.source_size) == (size[r.doc_id], total[src[r.doc_id]])
        assert r.target == pytest.approx(want[src[r.doc_id]])
        assert r.taken == r["size"] * len(r.shards) and len(r.shards) <= 2
    for s in names:
        took = sum(r.taken for r in got if src[r.doc_id] == s)
        most = max(size[r[0]] for r in rows if r[3] == s)
        assert abs(took - want[s]) <= most
    again = mixing.taken(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.shards) for r in again) == sorted((r.doc_id, r.shards) for r in got)
    assert mixing.mix(docs).select("doc.*").columns == docs.columns
    assert mixing.taken(empty).count() == 0


def test_shards_are_even_and_disjoint(spark):
    df = spark.range(4000).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text",
        "case when id % 3 = 0 then 'a' else concat('b', id % 5) end as source")
    rows = mixing.mix(df).select("doc.doc_id", "doc.source", "shard").collect()
    per = np.bincount([r.shard for r in rows], minlength=16)
    assert len(per) == 16 and per.min() > 0.5 * per.mean() and per.max() < 1.6 * per.mean()


# ------------------------------------------------------------------ 9


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    r = np.random.default_rng(bits)
    ids = r.integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = tokenfile.pack(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    assert (tokenfile.unpack(raw, bits, 0, 1000) == ids).all()
    assert (tokenfile.unpack(raw, bits, 313, 77) == ids[313:390]).all()


def test_encoder_equals_the_library():
    r = random.Random(9)
    tok = Tokenizer.from_file(BPE)
    pool = ["hello", "WORLD's", "é", "漢字", "\x01", "\x1c", " ", "!?", "12", "İ", "<|endoftext|>",
            "\t", "\n", " ", "  ", "á", "́", "x\x01y", "don't", "\r\n", "ﬁ"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(300)]
    enc = tokenfile.Encoder(BPE, max_words=50)
    assert enc.by_word
    for t, x in zip(texts, enc.encode(texts)):
        assert x.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, empty, tmp_path):
    rows = corpus()
    tok = Tokenizer.from_file(BPE)
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, path, BPE, block_ids=500, parts=3)
    got = sorted(tokenfile.token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    at, texts = 0, {r[0]: r[1] for r in rows}
    for r in got:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    some = tokenfile.read_tokens(spark, path, [7, 103]).collect()
    assert {r.doc_id: r["ids"] for r in some} == {
        i: tok.encode(texts[i], add_special_tokens=False).ids + [2] for i in (7, 103)}
    tokenfile.write_tokens(empty, path + "0", BPE)
    assert tokenfile.token_index(spark, path + "0").count() == 0


# ------------------------------------------------------------------ 10


def test_edits_keep_counts_exact():
    r = random.Random(8)
    count = tokencount.Counter(BYTES)
    full = lambda s: len(count.tok.encode(s, add_special_tokens=False).ids)
    pool = ["hello", " world", "'s", "  ", "\n", " \n ", "12", " 345", "!?", "é", "漢", "\t", "don't"]
    text = lambda k: "".join(r.choice(pool) for _ in range(k))
    for _ in range(120):
        s = text(r.choice([0, 1, 5, 80, 300]))
        tree = tokencount.Tree(count, s)
        assert tree.tokens == full(s)
        for _ in range(6):
            a = r.randint(0, len(s))
            b = min(len(s), a + r.choice([0, 0, 1, 3, 40]))
            new = text(r.choice([0, 1, 3, 40]))
            s = s[:a] + new + s[b:]
            tree.edit(a, b, new)
            assert tree.text() == s and tree.tokens == full(s) and tree.length == len(s)


def test_edits_touch_little():
    count = tokencount.Counter(BYTES)
    tree = tokencount.Tree(count, "some words here. " * 2000)
    before = count.encoded
    tree.edit(15000, 15004, "other")
    assert count.encoded - before < 5 * tokencount.LEAF


def test_token_counts_carry_on(spark, docs, empty):
    tok = tokencount.Counter(BYTES).tok
    full = lambda s: len(tok.encode(s or "", add_special_tokens=False).ids)
    first = tokencount.apply_edits(tokencount.with_cleaning_edits(docs), BYTES)
    rows = first.collect()
    texts = {r[0]: r[1] for r in corpus()}
    assert len(rows) == len(corpus())
    for r in rows:
        assert r.n_tokens == full(texts[r.doc_id]) and r.n_tokens_after == full(r.text)
    later = tokencount.apply_edits(first.select(
        "doc_id", "text", "leaf_chars", "leaf_tokens",
        F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("X ").alias("new")),
                F.struct(F.lit(1).alias("start"), F.lit(9).alias("end"), F.lit(None).cast("string")
                         .alias("new"))).alias("edits")), BYTES).collect()
    for r in later:
        assert r.n_tokens_after == full(r.text) and r.n_edits == 2
    assert tokencount.apply_edits(tokencount.with_cleaning_edits(empty), BYTES).count() == 0


def test_word_cache_that_forgets_gives_the_same_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.zipf(1.3, 40) % 5000) for _ in range(1500)]
    texts += ["", None, " \n ", "w1"]
    small, whole = tokenfile.Encoder(path, max_words=2000), tokenfile.Encoder(path)
    shrunk = []
    forget = small._shrink
    small._shrink = lambda: (forget(), shrunk.append(len(small.words)))
    for text, a, b in zip(texts, small.encode(texts), whole.encode(texts)):
        want = whole.tok.encode(text or "", add_special_tokens=False).ids
        assert a.tolist() == want and b.tolist() == want
    assert any(0 < n <= 1500 for n in shrunk)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_put_together_encode_as_the_library_does(name):
    path = public_tokenizers.path(name)
    tok, r = Tokenizer.from_file(path), random.Random(11)
    stems = ["Thing", "ONE", "l'été", "naïve", "e\u0301te", "cafe", "İstanbul", "ΣΑΣ", "ß", "don't",
             "ab12", "日本", "a\u00d7b", "<|endoftext|>", "<|ENDOFTEXT|>", "\u01c5x", ""]
    tails = ["", ",", ".", "...", ",%%%", "'", "'s", "'S", "\u0301", "\u0301,", "!?", "\u00bb", "-", "</w>",
             "\x01", "\u200d.", "_"]
    words = [a + b for a in stems for b in tails]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(300)] + words
    enc = tokenfile.Encoder(path, max_words=100)
    for t, x in zip(texts, enc.encode(texts)):
        assert x.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_new_latin_words_skip_the_whole_tokenizer():
    """Letters go to the tokenizer's model alone, tails are encoded once, and every other word by
    the whole tokenizer: op9's time is spent on words that are met for the first time."""
    tok, r = Tokenizer.from_file(BPE), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüßéñçøłÄÖÜÉŁ\u01c5\u0280"
    new = ["".join(r.choice(letters) for _ in range(r.randint(2, 12))) + r.choice(["", ".", ",", "!?"])
           for _ in range(3000)]
    odd = ["J\u030cab", "I\u0307", "\u0130x", "\u212aab", "a1", "don't", "x" * 5000 + ".", "ΣΑΣ,", "日本",
           "\u0345a", "ab\u0301", "a\u00d7b", "<|endoftext|>", "a<|endoftext|>.", "\x01", "--", ""]
    texts = [" ".join(new[at:at + 30]) for at in range(0, 3000, 30)]
    enc = tokenfile.Encoder(BPE)
    asked, whole = [], enc._encode_all
    enc._encode_all = lambda some: (asked.extend(" ".join(some).split()), whole(some))[1]
    got = list(enc.encode(texts))
    assert len(asked) < 20
    texts += odd + [f"{a}{b} {b}{a}" for a in odd for b in odd] + [None, "", " \n "]
    got += list(enc.encode(texts[len(got):]))
    assert len(got) == len(texts)
    for t, x in zip(texts, got):
        assert x.tolist() == tok.encode(t or "", add_special_tokens=False).ids, t
