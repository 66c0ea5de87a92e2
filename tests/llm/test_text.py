"""Text operators against plain versions: tokens, scores, notices, packing, similar groups, repeats."""

import collections
import difflib
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, jaccard, licenses, lm, packing, repeats, toxicity

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra=True):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("ids", "block", "kept", "n", "score", "length", "root")}) if extra else df


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def null_first(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


# byte-level BPE


@pytest.mark.parametrize("chunk,overlap", [(100, 20), (64, 8)])
def test_bpe_equals_the_library(spark, chunk, overlap):
    r = random.Random(3)
    letters = "ab c  \n\n\t'srelvd1,.é日🙂"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 900)))) for i in range(60)]
    rows += [(200, "a" * 500), (201, " " * 700), (201, " " * 700), (None, None), (203, "x" * 90 + " " * 300 + "y" * 100), (204, "")] + rows[:5]
    library = bpe._encoder(RANKS, PATTERN)
    got = [(r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(frame(spark, rows), RANKS, PATTERN, chunk, overlap), RANKS, PATTERN).collect()]
    want = [(d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows]
    assert null_first(got) == null_first(want)


def test_bpe_of_nothing(spark):
    assert bpe.decode(bpe.encode(frame(spark, []), RANKS, PATTERN), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(frame(spark, []), RANKS, PATTERN, 100, 60)


# packing


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(r.choice([0, 1, 3, 20, 60, 200])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "abc def"), (7, rows[7][1]), (502, "a <|endoftext|>b<|endoftext|>")]
    got = packing.pack_documents(frame(spark, rows), RANKS, PATTERN, {"<|endoftext|>": 50_256}, 2, 64).collect()
    pieces = collections.Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        starts = [0, *range(first, len(ids), 64)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            pieces[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == pieces
    by = collections.defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    gaps = []  # one after the other, longest first, each into the smallest gap that takes it
    for n in sorted((x.length for x in got), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((64 if fit is None else fit) - n)
    assert len(by) <= 1.02 * len(gaps) + 1


def test_packing_of_nothing_and_of_equals(spark):
    assert packing.pack_documents(frame(spark, []), RANKS, PATTERN, {}, 2).count() == 0
    pieces = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(3).cast("long").alias("length"))
    assert packing.pack(pieces, 10).select("sequence_id").distinct().count() == 334


def test_sweep_takes_nearest_gaps_and_loses_nothing():
    left, gaps = np.zeros(65, np.int64), np.zeros(65, np.int64)
    left[[10, 12]] = 5, 3
    gaps[[11, 12, 40]] = 1, 2, 1
    matches, openings = packing.sweep(left, gaps, range(12, 9, -1), 64, False)
    assert matches == [(12, 2, 1, 12, 0, 2), (12, 1, 3, 40, 0, 1), (10, 1, 1, 11, 0, 1)] and openings == [(10, 4, 6)] and not left.any()


# toxicity


def test_toxicity_finds_planted_words_and_leaves_the_rest(spark):
    r = random.Random(5)
    plain = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if i % 5 == 0:
            words[r.randrange(len(words))] = r.choice(["idiotic", "vile"])
        docs.append((i, " ".join(words)))
        labels += [(i, int(i % 5 == 0))] * (2 if i % 50 == 0 else 1)
    docs += [(1000, None), (1001, ""), (1001, ""), (None, "vile w1")]
    labels += [(5, None), (6, 7), (None, 1)]
    df, known = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.held_out(F.col("doc_id"))
    examples = toxicity.fit(df.where(~out), known.where(~out))
    got = {x.doc_id: x for x in toxicity.score(df, examples).collect()}
    assert len(got) == 603 and all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(600))
    assert got[None].predicted == 1 and got[1000].score == got[1001].score < 0.5
    assert toxicity.score(df, examples).count() == len(docs)
    clean = toxicity.clean_only(df, examples)
    assert clean.columns == df.columns and clean.count() == 480 + 3
    assert toxicity.score(frame(spark, []), examples).count() == 0
    nothing = toxicity.fit(df, known.where("false"))
    assert toxicity.score(df, nothing).agg(F.max("score")).first()[0] == 0


def test_block_maxima_give_the_exact_nearest():
    r = np.random.default_rng(2)
    vocabulary = {f"t{i}": (i, 1.0 + i % 5) for i in range(40)}
    rows = [(d, d % 2, 1, np.sort(r.choice(40, r.integers(1, 8), replace=False)), r.integers(1, 5, 8).astype(float)) for d in range(700)]
    rows = [(d, p, t, at, n[: len(at)]) for d, p, t, at, n in rows]
    index = toxicity.build(rows, vocabulary, 0.5, block=16)
    dense = np.zeros((len(index.ids), 40))
    for i, (entries, weights) in enumerate(index.postings):
        dense[entries, i] = weights
    for _ in range(60):
        at = np.sort(r.choice(40, r.integers(1, 8), replace=False))
        w = index.vector(at, r.integers(1, 5, len(at)).astype(float))
        top, cosine = index.nearest(at, w, 15)
        want = np.sort(dense[:, at] @ w)[::-1][:15]
        assert np.allclose(cosine, want[want > 0])


# language model


def test_lm_base_is_exact_and_the_model_is_a_distribution(spark):
    r = random.Random(6)
    groups = [[f"{p}{i}" for i in range(80)] for p in ("Ab", "co", "zé")]
    rows = [(i, " ".join(r.choice(groups[i % 3]) for _ in range(r.randint(0, 150))) + r.choice(["", "\n", " \t"])) for i in range(150)]
    rows += [(900, None), (901, ""), (901, ""), (902, "never seen " * 200), (None, "Ab1")]
    training = ~toxicity.held_out(F.col("doc_id"), 5, 1)
    got = lm.score(frame(spark, rows), training, RANKS, PATTERN, sample=80, block_rows=32).collect()
    learns = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
    counts, ends = collections.Counter(), 0
    for d, t in rows:
        if learns(d):
            counts.update(WORD.findall(ascii_lower(t)))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for d, t in rows:
        w = WORD.findall(ascii_lower(t))
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in [*(counts[x] for x in w), ends])
        want.append((d, learns(d), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(base, 6)))
    assert null_first((x.doc_id, x.training, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == null_first(want)
    long = [x for x in got if x.n_tokens > 40 and x.doc_id != 902]
    assert sum(x.score for x in long) > sum(x.base_score for x in long)
    assert lm.score(frame(spark, []), training, RANKS, PATTERN).count() == 0


def test_lm_learns_from_every_training_text(spark):
    """The texts that tell how words follow each other are those a sample of 1,500 by hash of the id would leave out."""
    r = random.Random(3)
    hashed = sorted((x.h, x.id) for x in spark.range(2600).where("crc32(cast(id as string)) % 5 != 1").select("id", F.xxhash64("id").alias("h")).collect())
    plain = {i for _, i in hashed[:1500]}
    text = lambda i: " ".join(["only"] * 8 if i in plain else [w for _ in range(30) for w in (r.choice(("red", "blue")), r.choice(("dog", "cat")))])
    got = lm.score(frame(spark, [(i, text(i)) for i in range(2600)]), ~toxicity.held_out(F.col("doc_id"), 5, 1), RANKS, PATTERN).collect()
    told = [x for x in got if not x.training]
    assert len(told) > 400 and sum(x.score > x.base_score for x in told) / len(told) > 0.95
    assert sum(x.score - x.base_score for x in told) / sum(x.n_tokens for x in told) > 0.2


def test_lm_unseen_words_keep_their_counted_probability(spark):
    rows = [(i, "one two three " * 20) for i in range(60)] + [(i, "xq zv " * 40) for i in range(60, 120)]
    got = lm.score(frame(spark, rows), F.col("doc_id") < 60, RANKS, PATTERN).where("not training").collect()
    end = [x.score - x.base_score for x in got]
    assert len(got) == 60 and all(x.n_known == 1 for x in got) and max(end) - min(end) < 1e-6 and min(end) > -4  # the end alone is judged


def test_lm_scores_texts_without_words(spark):
    for known in (True, False):
        got = lm.score(frame(spark, [(1, None), (2, " \t"), (None, "")]), F.lit(known), RANKS, PATTERN).collect()
        assert [(x.n_tokens, x.n_known, x.train_tokens) for x in got] == [(1, int(known), 3 * known)] * 3 and all(math.isfinite(x.score) for x in got)


def test_lm_words_have_all_their_subwords():
    tokens = [b"internationalisation", b"a", "straße".encode(), b"xqzvkjw", "\u00a0x".encode()]
    ids, sizes = lm.subwords(tokens, RANKS, PATTERN)
    encoder, ends = bpe._encoder(RANKS, PATTERN), np.cumsum(sizes)
    assert [encoder.decode_bytes(ids[e - n : e].tolist()) for n, e in zip(sizes, ends)] == [b" " + t for t in tokens] and max(sizes) > 2


def test_attention_is_causal_and_its_gradient_is_right():
    r = np.random.default_rng(1)
    model = lm.Attention(20, 6)
    model.p = {n: x.astype(np.float64) for n, x in model.p.items()}
    a, b = r.integers(0, 21, (3, lm.WINDOW)), r.integers(0, 21, (3, lm.WINDOW))
    y, _ = model.forward(a, b)
    assert np.allclose(np.exp(y).sum(-1), 1)
    changed = a.copy()
    changed[:, 30:] = (changed[:, 30:] + 1) % 21
    assert np.allclose(model.forward(changed, b)[0][:, :30], y[:, :30])
    target, weight = r.integers(0, 6, a.shape), np.ones(a.shape)
    loss = lambda: -np.take_along_axis(model.forward(a, b)[0], target[..., None], 2).mean()
    before = loss()
    for _ in range(30):
        model.step(a, b, target, weight, 0.01)
    assert loss() < before - 0.1


def test_windows_score_every_token_once():
    lengths = np.array([1, 5, 64, 65, 200, 16, 1000])
    places, there, scored = lm.windows(lengths)
    assert np.array_equal(np.bincount(places[scored], minlength=lengths.sum()), np.ones(lengths.sum()))


# notices


def test_notices_and_their_wording(spark):
    mit, short = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-short"]
    rows = [
        (1, "Some prose here.\n" + short), (2, short.replace("version 3", "version 2")), (3, "no notice, no rights"), (4, None), (5, ""), (6, mit.replace("Software", "Program")),
        (7, ("word " * 30_000) + short + (" word" * 30_000)), (8, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (8, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (9, "under the license"), (None, short),
    ]
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted((x.doc_id or 0, x.license) for x in got) == [(0, "GPL-3.0-short"), (1, "GPL-3.0-short"), (2, "GPL-3.0-short"), (6, "MIT"), (7, "GPL-3.0-short"), *[(8, "CC-BY-NC-4.0-short"), (8, "MIT-short")] * 2][:5] + sorted([(8, "CC-BY-NC-4.0-short"), (8, "MIT-short")] * 2)
    by = {x.doc_id: x for x in got}
    assert by[2].differences == ["-3 +2"] and by[1].differences == [] and by[6].n_missing == 5
    text = dict((d, t) for d, t in rows if d is not None)
    assert text[7][by[7].start : by[7].stop] == short.rstrip(".")
    assert licenses.scan(frame(spark, [])).count() == 0


def test_notices_equal_brute_force(spark):
    """Every line against every template by word alignment alone."""
    r = random.Random(8)
    names = [n for n, t in licenses.TEMPLATES.items() if len(t) > 35]
    rows = []
    for i in range(80):
        words = licenses.TEMPLATES[r.choice(names)].split()
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            words[r.randrange(len(words))] = r.choice(["other", "thing", "else"])
        rows.append((i, "Prose of no concern stands here.\n\n\n" + " ".join(words)))

    def best(text):
        scored = []
        for name, own in licenses.TEMPLATES.items():
            a, b = licenses.WORD.findall(own.lower()), licenses.WORD.findall(text.lower())
            same = sum(p.size for p in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            scored.append((same / len(a), name))
        return {n for s, n in scored if s >= 0.8}

    got = {x.doc_id: x.license for x in licenses.scan(frame(spark, rows)).collect()}
    for d, t in rows:
        assert (got.get(d) in best(t.split("\n")[-1])) if best(t.split("\n")[-1]) else d not in got


def test_short_notices_inside_long_lines(spark):
    """Long templates save more bytes on prose than the notice that stands there."""
    prose = (
        "Permission is granted to any person obtaining a copy of this software and associated files, without restriction and subject to the following conditions, to deal in it and to use it. "
        "The source code is distributed in binary forms with or without changes, provided that the following conditions are met and the above copyright notice is kept in the documentation. "
        "The program is free to share and you can pass it on or change it under the terms that the foundation publishes, either as it stands or in any later form. "
        "Unless required by law or agreed in writing it comes without warranties of any kind, either express or implied, and you may not use this file except as told here. "
    )
    texts = [f"{prose}{licenses.TEMPLATES[n]} {prose}" for n in sorted(licenses.TEMPLATES) if n.endswith("short")]
    got = {x.doc_id: (x.license, x.differences) for x in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: (n, []) for i, n in enumerate(n for n in sorted(licenses.TEMPLATES) if n.endswith("short"))}


def test_notices_over_line_ends(spark):
    rows, want = [], {}
    for n, t in licenses.TEMPLATES.items():
        words = t.split()
        for cut in range(1, len(words)):
            want[len(rows)] = n, []
            rows.append((len(rows), f"Prose of no concern stands here.\n{' '.join(words[:cut])}\n{' '.join(words[cut:])}\nSo it ends."))
    want[len(rows)] = "Apache-2.0-short", ["-under +beneath"]
    rows.append((len(rows), "Prose under the line\nabout the version.\nLicensed beneath\nthe Apache License,\nVersion 2.0.\nUnder the text."))
    assert {x.doc_id: (x.license, x.differences) for x in licenses.scan(frame(spark, rows)).collect()} == want


# similar groups


def shingle_set(text, width=5):
    w = WORD.findall(ascii_lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def groups(rows, percent=80):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def test_similar_groups_equal_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(40)]
    rows = []
    for _ in range(18):
        base = [r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 7, 9, 12, 20, 60, 120, 300]))]
        for _ in range(r.choice([1, 2, 5, 15])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            copy = copy[: int(len(copy) * r.uniform(0.75, 1))] if r.random() < 0.3 else copy
            rows.append((len(rows), " ".join(copy + passage if r.random() < 0.3 else copy)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One Two Three four five"), (5004, "one two three FOUR x five"), (5005, "one  two\tthree four five")]
    r.shuffle(rows)
    want = groups(rows)
    df = frame(spark, rows + [(None, "w1 w2 w3 w4 w5 w6"), rows[3]])
    got = [tuple(x) for x in jaccard.similar_groups(df).collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted(want + [x for x in want if x[0] == rows[3][0]])
    assert (None, 2, None) in got
    left = jaccard.one_of_each_group(df)
    assert left.columns == df.columns
    assert sorted(x.doc_id for x in left.collect() if x.doc_id is not None) == sorted({d for d, _, c in want if d == c})


def test_a_row_without_id_does_not_stand_for_its_class(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w99", "x99")
    df = frame(spark, [(None, text), (3, text), (4, near), (None, near), (5, text)]).coalesce(1)
    assert sorted((x.component_id for x in jaccard.similar_groups(df).collect() if x.doc_id is not None)) == [3, 3, 3]
    assert sorted(x.doc_id or 0 for x in jaccard.one_of_each_group(df).collect()) == [0, 0, 3]


def test_a_centre_that_repeats_does_not_end_the_search(spark):
    """All three share one key, 3 and 4 no other; document 1 is the centre in the first two rounds and is linked with neither."""
    middle = "w867 w821 w782 w64 w261 w120 w507"
    rows = [(1, f"x667 {middle}"), (3, f"w582 {middle}"), (4, f"w137 w582 {middle}")]
    assert sorted(tuple(x) for x in jaccard.similar_groups(frame(spark, rows)).collect()) == groups(rows) == [(1, 4, 1), (3, 4, 3), (4, 5, 3)]


def test_similar_groups_of_nothing(spark):
    assert jaccard.similar_groups(frame(spark, [])).count() == 0


def test_linked_sets_share_a_key():
    """The pigeonhole holds for every pair within the bound, whichever elements are common."""
    r = np.random.default_rng(3)
    common = r.random(jaccard.CELLS) < 0.3
    for _ in range(400):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        cut, add = int(r.integers(0, n // 9 + 1)), int(r.integers(0, n // 9 + 1))
        b = np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 63, add).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 80 * (len(a) + len(b) - same):
            assert np.intersect1d(jaccard.keys(a, common, 80), jaccard.keys(b, common, 80)).size
            bits = jaccard.parity_bits(a) ^ jaccard.parity_bits(b)
            assert np.bitwise_count(bits.view(np.uint64)).sum() <= len(a) + len(b) - 2 * same


# repeats


def cut(rows, length):
    seen = collections.Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((d, len(b), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length,k,block", [(40, 12, 3000), (60, 40, 1 << 20)])
def test_repeats_equal_brute_force(spark, length, k, block):
    r = random.Random(5)
    words = ["".join(r.choice("abéc") for _ in range(r.randint(1, 4))) for _ in range(30)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 120))) for _ in range(25)]
    rows = []
    for i in range(120):
        t = r.choice(base)
        if r.random() < 0.6:
            p = r.randrange(len(t))
            t = t[:p] + r.choice("xyzé") + t[p + r.randint(0, 2) :]
        rows.append((i, t + r.choice(base)[: r.randint(0, 200)] if r.random() < 0.4 else t))
    rows += [(None, base[0]), (None, base[0]), (7, None), (8, ""), (9, "ab" * 500), (10, "a" * 1000), (11, "".join(r.choice("abcdefgh") for _ in range(3000)))]
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in repeats.remove_repeats(frame(spark, rows), length, k, block).collect()]
    assert null_first(got) == null_first(cut(rows, length))


def test_repeats_of_nothing_and_columns(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    passage = "".join(random.Random(1).choice("abcdefghij ") for _ in range(450))
    df = frame(spark, [(1, "xx " + passage + " yy"), (2, passage + "zz"), (3, "short")]).withColumn("n_chars", F.lit(0))
    left = repeats.without_repeats(df)
    assert left.columns == df.columns and {x.doc_id: (x.text, x.n_chars) for x in left.collect()} == {1: ("xx  yy", 6), 2: ("zz", 2), 3: ("short", 5)}


def test_passages_of_words_go_however_few_bytes_they_have(spark):
    r = random.Random(8)
    plain = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    words = lambda n: [r.choice(plain) for _ in range(n)]
    lines = [words(n) for n in (9, 10, 11, 30)]
    rows = [(i, words(r.randint(0, 40)) + lines[i % 4] + words(r.randint(0, 40))) for i in range(60)]
    rows += [(70, lines[2] + lines[3] + lines[2]), (71, lines[1]), (71, lines[1]), (None, lines[0]), (72, ["a"] * 25), (73, [])]
    seen = collections.Counter(tuple(w[i : i + 10]) for _, w in rows for i in range(len(w) - 9))
    space = [" ", "\n", "\t ", "  "]
    given, want = [], []
    for d, w in rows:
        gone = [any(seen[tuple(w[j : j + 10])] > 1 for j in range(max(0, i - 9), i + 1) if j + 10 <= len(w)) for i in range(len(w))]
        text, left = "", ""
        for i, x in enumerate(w):
            gap = r.choice(space) if i else r.choice(["", " "])
            text += gap + x
            left += ("" if i and gone[i] and gone[i - 1] else gap) + ("" if gone[i] else x)
        given.append((d, text))
        want.append((d, left))
    got = repeats.without_repeats(frame(spark, given), 400, words=10, block_bytes=3000).collect()
    assert null_first((x.doc_id, x.text) for x in got) == null_first(want)
    plain_only = repeats.without_repeats(frame(spark, given), 400).collect()
    assert null_first((x.doc_id, x.text) for x in plain_only) == null_first(given)


def test_loser_tree_merges_sorted_runs():
    r = random.Random(2)
    runs = [sorted("".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(r.randint(0, 30))) for _ in range(9)]
    coded = [repeats.front_decode(repeats.front_code([(s, b"", 0, 0, i) for i, s in enumerate(run)])) for run in runs]
    got = [(lcp, entry[0]) for lcp, _, entry in repeats.merge(coded)]
    assert [s for _, s in got] == sorted(s for run in runs for s in run)
    assert all(lcp == repeats.shared(a, b) for (_, a), (lcp, b) in zip(got, got[1:]))


def test_digest_columns(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2(cast('' as binary), 256)").first()[0]
