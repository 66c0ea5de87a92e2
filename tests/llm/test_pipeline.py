"""The pipeline against its stages done plainly, one after the other, and the registration of the corpus queries."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_text import cut, groups


def corpus(path, spark):
    r = random.Random(12)
    plain = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(plain) for _ in range(n))
    passage = text(90)
    rows = [(i, text(r.choice([1, 4, 12, 60, 200, 900]))) for i in range(260)]
    rows += [(300 + i, f"{text(30)} {r.choice(['vilely', 'idiotic'])} {text(20)}") for i in range(60)]
    rows += [(400 + i, rows[i * 3][1]) for i in range(30)]
    rows += [(500 + i, rows[i][1] + " " + r.choice(plain)) for i in range(40)]
    rows += [(600 + i, f"{text(20 + i)} {passage} {text(15)}") for i in range(8)]
    rows += [(700, ""), (701, None)]
    labels = [(i, 0, int(300 <= i < 360)) for i, _ in rows if i < 400]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_pipeline_equals_its_stages_done_plainly(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus(tmp_path, spark)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [(d, t) for d, t in rows if not re.search("vilely|idiotic", t or "")]
    kept = {d for d, _, c in groups(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in kept]
    rows = [(d, left.decode("utf-8", "ignore")) for d, *_, left in cut(rows, 400)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want


def test_stages_keep_the_columns(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
