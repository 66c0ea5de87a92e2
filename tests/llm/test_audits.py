"""Reversed search, source mixing and source divergence against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import divergence, mixing, reverse_search, terms

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "rank score item part term n size target taken words key chunk block kept lang_n held first weight cap low".split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=5, n=120):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdeÀß日İ3") for _ in range(r.randint(1, 4))) for _ in range(60)]
    text = lambda k: "".join(r.choice(plain) + r.choice(" .\t-\n!") for _ in range(k))
    rows = [(i, text(r.choice([0, 1, 5, 40, 90])), r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "é", None, "", "z"])) for i in range(n)]
    rows += rows[:6] + [(None, text(30), "en", "a"), (None, text(30), "en", "a"), (7, text(9), "de", "b"), (n, None, "fr", "only"), (n + 1, " ", "xx", "p"), (n + 2, "?", "xx", "q")]
    return rows + [(n + 3, text(3000), "en", "b")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("?") for c in CLASHING}).repartition(5)


def ranked_plainly(rows, items, k):
    docs = [(d, ALNUM.findall(lower(t))) for d, t, *_ in rows]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = collections.Counter(x for _, w in docs for x in set(w))
    out = []
    for item, text in items:
        found = []
        for d, w in docs:
            tf, m = collections.Counter(w), 75 + 25 * len(w) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in ALNUM.findall(lower(text)) if tf[x])
            found += [(-s, d is None, d or 0)] if s > 0 else []
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return out


def null_first(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("postings,near", [(1_000_000, 32), (40, 1)])
def test_reversed_search_equals_plain_ranking(spark, monkeypatch, postings, near):
    monkeypatch.setattr(reverse_search, "NEIGHBOURS", near)
    rows, r = corpus(), random.Random(2)
    items = [(i, " ".join(r.choice(rows[:120])[1][:60] for _ in range(2))) for i in range(25)]
    items += [(100, None), (101, "..."), (102, "nowhere1"), (None, rows[3][1] + " ab ab AB")]
    asked = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumns({c: F.lit("?") for c in CLASHING})
    got = [tuple(x) for x in reverse_search.search(frame(spark, rows), asked, 20, postings).collect()]
    assert null_first(got) == null_first(ranked_plainly(rows, items, 20))


def test_reversed_search_of_nothing(spark):
    none, item = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert reverse_search.search(none, item).collect() == []
    assert reverse_search.search(frame(spark, corpus()), item.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert reverse_search.search(frame(spark, corpus()), item.where("false")).collect() == []


def test_terms_of_long_texts_are_split_in_slices(monkeypatch):
    monkeypatch.setattr(terms, "SLICE", 64)
    text = " ".join(["ab", "Ünder", "x" * 200, "日本", "9z"] * 40) + "."
    for kept, pattern in ((terms.table(True), ALNUM), (terms.table(False), LETTERS)):
        assert [w.decode() for part in terms.split(text.encode(), kept) for w in part] == pattern.findall(lower(text))
        assert [w for part in terms.split(b"", kept) for w in part] == []


def water(sizes, weights, percent, most):
    """Targets by resharing the excess until none is above its cap."""
    left, open_, out = sum(sizes) * percent / 100, set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i], left = float(most * sizes[i]), left - most * sizes[i]
        open_ -= over
    return out


def test_mix_meets_its_targets(spark):
    rows = corpus(9, 300)
    got = mixing.mix(frame(spark, rows)).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    assert collections.Counter((x.doc_id, x.size, x.source) for x in got) == collections.Counter((d, size(t), s) for d, t, _, s in rows)
    by = collections.Counter()
    for _, t, _, s in rows:
        by[s] += size(t)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water([by[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 150, 2)))
    taken = collections.Counter()
    for x in got:
        assert x.source_size == by[x.source] and abs(x.target - want[x.source]) < 1e-6
        assert x.taken == x.passes * x.size + x.part_words and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in names)
    assert {x.passes for x in got} > {0} or len({x.passes for x in got}) > 1
    assert sum(0 < x.part_words < x.size for x in got) <= len(names)


def test_mix_is_the_same_again_however_the_rows_lie(spark):
    rows = corpus(4, 200)
    once = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows[::-1]).repartition(3)).collect()
    assert collections.Counter(map(tuple, once)) == collections.Counter(map(tuple, again))
    assert collections.Counter(map(tuple, once)) != collections.Counter(map(tuple, mixing.mix(frame(spark, rows), seed="other").collect()))


def test_mix_of_one_hot_source_equal_rows_and_nothing(spark):
    rows = [(None, "a b c", "en", "s")] * 500 + [(1, "d", "en", "t")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert sum(x.taken for x in got if x.source == "s") == math.floor(got[0].target if got[0].source == "s" else max(x.target for x in got))
    assert mixing.mix(frame(spark, rows[:0])).collect() == []
    empty = mixing.mix(frame(spark, [(1, None, "en", None), (2, " \t", "en", "x")])).collect()
    assert {(x.size, x.taken, x.target) for x in empty} == {(0, 0, 0.0)}


def test_targets_with_many_sources(spark):
    r = random.Random(1)
    sizes = [("s%03d" % i, r.choice([0, 1, 3, 50, 4000, 10**9])) for i in range(200)]
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"), (3, 1, 2), 150, 2).collect()}
    want = water([n for _, n in sizes], [(3, 1, 2)[i % 3] for i in range(200)], 150, 2)
    assert all(abs(got[s] - w) <= 1e-9 * max(1, w) for (s, _), w in zip(sizes, want))


def audited_plainly(rows, least, top):
    docs = [(lang or "", source or "", LETTERS.findall(lower(t))) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(x for _, _, w in own for x in set(w))
        kept = sorted(x for x, n in df.items() if n >= least)
        counts = {s: collections.Counter(x for _, s2, w in own if s2 == s for x in w if df[x] >= least) for s in {d[1] for d in own}}
        whole = sum(counts.values(), collections.Counter())
        share = lambda c, x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept))
        for s, c in counts.items():
            pairs = [(-sum((share(c, x) - share(o, x)) ** 2 // share(o, x) for x in kept), s2.encode(), s2) for s2, o in counts.items() if s2 != s]
            found = [(-((share(c, x) - share(whole, x)) ** 2 // share(whole, x)), x.encode(), x) for x in kept if c[x] and share(c, x) > share(whole, x)]
            out |= {(lang, s, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize("chunk,block,top", [(8192, 64, 200), (7, 2, 5)])
def test_divergence_equals_plain_audit(spark, monkeypatch, chunk, block, top):
    rows = corpus(3, 150)
    got = [tuple(x) for x in divergence.audit(frame(spark, rows), top=top, chunk=chunk, block=block).collect()]
    want = audited_plainly(rows, 3, top)
    assert len(got) == len(set(got)) and set(got) == want
    assert {x[:5] for x in got if x[0] == "xx"} == {("xx", "p", "pair", "q", 0), ("xx", "q", "pair", "p", 0)}


def test_divergence_flushes_and_handles_nothing(spark, monkeypatch):
    rows = corpus(8, 60)
    assert divergence.audit(frame(spark, rows[:0])).collect() == []
    parts = divergence.counted(frame(spark, rows)).where("term is not null").agg(F.sum("n"), F.sum("docs")).first()
    words = [LETTERS.findall(lower(t)) for _, t, *_ in rows]
    assert tuple(parts) == (sum(map(len, words)), sum(len(set(w)) for w in words))


def test_trees_share_nodes_and_price_each_pair_once():
    counts = np.array([[0, 0, 0, 0, 5, 1, 0], [0, 0, 0, 0, 5, 1, 0], [2, 0, 0, 0, 5, 1, 9]])
    roots, children, values = divergence.cons(counts)
    assert roots[0] == roots[1] != roots[2]
    x, y, times = divergence.met(roots[0], roots[2], children, values)
    assert sorted(zip(x.tolist(), y.tolist(), times.tolist())) == [(0, 0, 3), (0, 2, 1), (0, 9, 1), (1, 1, 1), (5, 5, 1)]
    big = np.array([10**12, 3, 0])
    assert divergence.shares(big, 10**12 + 4).tolist() == [1 + 10**9 * (c + 1) // (10**12 + 4) for c in big.tolist()]


def test_slices_bound_the_bytes_of_a_piece():
    import pyarrow as pa

    from barloom.llm.common import slices

    texts = [None, "", "x" * 10, "y" * 500, "é" * 3, "z" * 30, None, "w" * 40]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts})
    pieces = [p.to_pydict() for p in slices([batch, batch.slice(2, 4), batch.slice(0, 0)], limit=64)]
    assert [t for p in pieces for t in p["text"]] == texts + texts[2:6]
    assert all(len(p["text"]) == 1 or sum(len((t or "").encode()) for t in p["text"]) <= 64 for p in pieces)


@pytest.mark.parametrize("letters", ["abcdefgh ", "aé日 z🙂"])
def test_repeats_of_399_400_and_600_bytes(spark, letters):
    """A repeated passage goes if, and only if, it has 400 bytes; where it stands in its text or in a word makes no difference."""
    from barloom.llm import repeats

    r = random.Random(11)

    def noise(n):
        return "".join(r.choice(letters) + r.choice("0123456789") for _ in range(n))

    def passage(size):
        text = noise(size)
        while len(text.encode()) > size:
            text = text[:-1]
        return text + "_" * (size - len(text.encode()))

    rows, want = [], {}
    for i, size in enumerate((399, 400, 401, 600)):
        p = passage(size)
        for j, (before, after) in enumerate(((noise(120), noise(90)), ("", noise(200)), (noise(50) + "x", "y" + noise(50)))):
            doc = 10 * i + j
            rows.append((doc, f"{before}[{p}]{after}" if j == 1 else f"{before}{p}{after}"))
            want[doc] = 0 if size < 400 else size
    fifty = " ".join(noise(2)[:5] for _ in range(51))  # over 50 words, yet fewer than 400 bytes
    rows += [(100 + j, noise(40) + fifty + noise(300)) for j in range(2)]
    want |= {100: 0, 101: 0}
    assert len(fifty.encode()) < 400 or "🙂" in letters
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()}
    for doc, size in want.items():
        if doc >= 100 and len(fifty.encode()) >= 400:
            continue
        assert got[doc] == (size, int(size > 0)), doc


def test_license_notices_in_dense_long_texts_take_linear_time():
    import time

    from barloom.llm import licenses

    scanner = licenses._scanner(tuple(sorted(licenses.TEMPLATES.items())), 0.8, 3)
    header = licenses.TEMPLATES["MPL-2.0-header"]
    times = []
    for n in (60, 480):
        text = (header + "\n") * n
        began = time.process_time()
        found = scanner.scan(text)
        times.append(time.process_time() - began)
        assert [(x[0], x[1] - x[0], x[2], x[7]) for x in found] == [(i * (len(header) + 1), len(header.rstrip("./")), "MPL-2.0-header", []) for i in range(n)]
    assert times[1] < 8 * times[0] * 2.5
    every = "\n".join(licenses.TEMPLATES.values())
    names = sorted(x[2] for x in scanner.scan("\n".join([every] * 12)))
    assert names == sorted(list(licenses.TEMPLATES) * 12)
    assert scanner.scan("licensed" * 4000 + " " + header)[0][2] == "MPL-2.0-header"


def test_toxicity_scores_equal_votes_over_all_examples(spark):
    """Scores, predictions and evidence against cosines with every example; very long and empty texts included."""
    from barloom.llm import toxicity

    r = random.Random(21)
    plain = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(120)]
    bad = ["vilely", "idiotic", "scumlike", "filthy"]
    rows, labels = [], []
    for i in range(500):
        words = [r.choice(plain) for _ in range(r.randint(3, 40))]
        toxic = i % 4 == 0
        if toxic:
            words += [r.choice(bad) for _ in range(r.randint(1, 3))]
        rows.append((i, " ".join(r.sample(words, len(words)))))
        labels.append((i, int(toxic) if i % 50 else 1 - int(toxic)))
    rows += [(600, None), (601, ""), (602, "vilely idiotic"), (603, " ".join(r.choice(plain) for _ in range(60_000)) + " filthy"), (604, "VILELY " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs.where("doc_id < 500"), spark.createDataFrame(labels, "doc_id long, toxic int"), most_examples=300)
    vectors = np.zeros((len(index.ids), len(index.vocabulary)))
    for t, (entries, weights) in enumerate(index.postings):
        vectors[entries, t] = weights
    assert len(index.ids) > 20 and np.allclose(np.linalg.norm(vectors, axis=1), 1)
    for x in toxicity.score(docs, index).collect():
        counts = index.count(dict(rows)[x.doc_id] or "")
        if not counts:
            assert x.score == index.bare and x.evidence == []
            continue
        at, n = (np.array(c) for c in zip(*sorted(counts.items())))
        query = np.zeros(len(index.vocabulary))
        query[at] = index.vector(at, n.astype(float))
        cosine = vectors @ query
        top = sorted((-round(c, 9), i) for i, c in enumerate(cosine) if c > 0)[:15]
        votes = [max(0.0, min(1.0, cosine[i])) ** 4 for _, i in top]
        want = (sum(v * index.positive[i] for v, (_, i) in zip(votes, top)) + 0.25 * index.rate) / (sum(v * index.total[i] for v, (_, i) in zip(votes, top)) + 0.25)
        assert abs(x.score - want) < 1e-9 and x.predicted == int(x.score >= 0.7), x.doc_id
        assert x.evidence == [int(index.ids[i]) for _, i in top[:3]]


def test_repeats_keep_a_users_columns_and_rows_without_an_id(spark):
    from barloom.llm import repeats

    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    shared = text(450)
    rows = [(None, text(300) + shared + text(200), f"b{i}", i) for i in range(30)] + [(1, text(900), "x", 30), (2, "short", None, 31)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n long").repartition(3)
    got = {x.n: x for x in repeats.remove_repeats(df, block_bytes=2000).collect()}
    assert len(got) == len(rows)
    for d, t, b, n in rows:
        x = got[n]
        assert (x.doc_id, x.block, x.n_bytes) == (d, b, len(t))
        assert 450 <= x.n_removed <= 460 if n < 30 else x.n_removed == 0  # letters beside the passage may agree by chance
    dotted = repeats.without_repeats(df.withColumn("a.b", F.col("n")))
    assert dotted.columns == [*df.columns, "a.b"] and dotted.count() == len(rows)
