"""The registered corpus queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import bpe, divergence, hnsw, jaccard, licenses, lm, mixing, onebit, packing, repeats, reverse_search, sharding, toxicity
from barloom.llm.common import read

SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document, with their wording differences."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again; digests of both."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; every third document by crc32 of its id is held out from learning."""
    docs, out = read(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    examples = toxicity.fit(docs.where(~out), read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~out))
    return toxicity.score(docs, examples).select("doc_id", out.alias("held_out"), "score", "predicted", "evidence")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 tokens, each document ended by id 2."""
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50_256}, 2)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document; every fifth document by crc32 of its id is held out from learning."""
    out = toxicity.held_out(F.col("doc_id"), 5, 1)
    rows = lm.score(read(spark, sf_dir, "documents"), ~out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles."""
    return jaccard.similar_groups(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of equal label linked by a cosine of 0.93 or more."""
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document among 128."""
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product with every vector whose id is divisible by 20."""
    return onebit.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that also start elsewhere."""
    rows = repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_reverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    return reverse_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of every document, sources weighing 3, 1, 2 in turn."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "part_words")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the term counts of a language's sources stand apart, and the terms that mark each source."""
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_byte_bpe, op3_toxicity, op4_packing, op5_lm_scoring, op6_ngram_jaccard, op7_embedding_dedup, op8_sharding, op9_nearest_vectors, op10_suffix_dedup, op11_reverse_search, op12_source_mix, op13_source_divergence)}

_REACH = """r(id, root) as (select id, id from n union select r.id, k.b from r join (select a, b from l union all select b, a from l) k on k.a = r.root)"""

SQL: dict[str, str] = {
    "op6_ngram_jaccard": f"""with recursive
      d as (select doc_id as id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
      g as (select id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from d),
      n as (select id, len(g) as n from g),
      e as (select id, unnest(g) as h from g),
      p as (select x.id as a, y.id as b, count(*) as c from e x join e y on x.h = y.h and x.id < y.id group by all),
      l as (select p.a, p.b from p join n x on x.id = p.a join n y on y.id = p.b where 100 * c >= 80 * (x.n + y.n - c)),
      {_REACH}
      select n.id as doc_id, n.n as n_shingles, c.root as component_id from n join (select id, min(root) as root from r group by id) c using (id)""",
    "op7_embedding_dedup": f"""with recursive
      v as (select vec_id as id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
      l as (select x.id as a, y.id as b from v x join v y on x.label = y.label and x.id < y.id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.93),
      n as (select vec_id as id from embeddings),
      {_REACH}
      select n.id as vec_id, (select count(*) from l where l.a = n.id or l.b = n.id) as n_links, c.root as component_id, n.id = c.root as kept from n join (select id, min(root) as root from r group by id) c using (id)""",
    "op11_reverse_search": """with
      d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
      i as (select item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) as term from benchmark),
      q as (select item_id, term, count(*) as reps from i group by all),
      s as (select count(*) as n_docs, sum(len(w)) as n_terms from d where len(w) > 0),
      o as (select r, any_value(doc_id) as doc_id, any_value(len) as len, term, count(*) as tf from (select r, doc_id, len(w) as len, unnest(w) as term from d) group by r, term),
      f as (select term, count(*) as df from o where term in (select term from q) group by term),
      p as (select o.r, o.doc_id, o.term, cast(floor(1000 * ln((2.0::double * n_docs + 2) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n_docs) // n_terms))) as v from o join f using (term), s),
      t as (select q.item_id, p.r, any_value(p.doc_id) as doc_id, cast(sum(p.v * q.reps) as bigint) as score from p join q using (term) group by q.item_id, p.r),
      k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from t where score > 0)
      select * from k where rank <= 20""",
    "op12_source_mix": """with
      d as (select doc_id, source, cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as key from documents),
      z as (select source, cast(sum(size) as bigint) as source_size from d group by source),
      c as (select *, 2 * source_size as cap, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from z),
      a as (select sum(source_size) as total, sum(weight) as weights from c),
      l as (select *, coalesce(sum(cap) over w, 0) as caps, coalesce(sum(weight) over w, 0) as used from c window w as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
      v as (select (total * 150 / 100.0::double - caps) / (weights - used) as level from l, a where (total * 150 / 100.0::double - caps) * weight <= cap * (weights - used) order by cap::double / weight, caps limit 1),
      t as (select source, source_size, least(cap::double, (select level from v) * weight) as target from c),
      g as (select *, cast(floor(target) as bigint) as budget from t),
      h as (select *, case when source_size > 0 then budget // source_size else 0 end as passes from g),
      x as (select d.doc_id, d.size, d.source, h.source_size, h.target, h.passes, h.budget - h.passes * h.source_size - coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as open from d join h on d.source is not distinct from h.source)
      select doc_id, size, source_size, target, cast(passes * size + greatest(0, least(size, open)) as bigint) as taken, source, passes, cast(greatest(0, least(size, open)) as bigint) as part_words from x""",
    "op13_source_divergence": """with
      d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
      o as (select r, lang, source, term, count(*) as n from (select r, lang, source, unnest(w) as term from d) group by all),
      k as (select lang, term, sum(n) as n from o group by lang, term having count(*) >= 3),
      s as (select lang, count(*) as v, sum(n) as n from k group by lang),
      g as (select distinct lang, source from d),
      c as (select g.lang, g.source, k.term, coalesce(y.n, 0) as n from g join k on k.lang = g.lang left join (select lang, source, term, sum(n) as n from o group by all) y on y.lang = g.lang and y.source = g.source and y.term = k.term),
      m as (select lang, source, sum(n) as n from c group by all),
      p as (select c.lang, c.source, c.term, c.n, cast(1 + (1000000000 * (c.n + 1)::hugeint) // (m.n + s.v) as hugeint) as p from c join m on m.lang = c.lang and m.source = c.source join s on s.lang = c.lang),
      b as (select k.lang, k.term, cast(1 + (1000000000 * (k.n + 1)::hugeint) // (s.n + s.v) as hugeint) as q from k join s on s.lang = k.lang),
      x as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
        union all select x.lang, x.source, 'pair', y.source, 0 from g x join g y on x.lang = y.lang and x.source <> y.source where x.lang not in (select lang from k)
        union all select p.lang, p.source, 'term', p.term, (p.p - b.q) * (p.p - b.q) // b.q from p join b on b.lang = p.lang and b.term = p.term where p.n > 0 and p.p > b.q),
      y as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from x)
      select * from y where part = 'pair' or rank <= 200""",
}
