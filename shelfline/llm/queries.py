"""One query per operator, applied to its whole table with production
parameters, and the equivalent SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.exact_dedup import exact_dedup
from shelfline.llm.jaccard_join import near_duplicates
from shelfline.llm.lsh_forest import forest_duplicates
from shelfline.llm.mixing import mix_sources
from shelfline.llm.packing import pack_documents
from shelfline.llm.quality_model import fold, scorer, train_on_labels
from shelfline.llm.quality_rules import quality_rules
from shelfline.llm.spelling import corpus_words, group_variants
from shelfline.llm.substring_dedup import remove_repeats
from shelfline.llm.token_counts import count_tokens
from shelfline.llm.token_files import read_tokens, write_tokens
from shelfline.llm.vector_codes import compress
from shelfline.llm.warc import read_warc, write_warc
from shelfline.plans.registry import register
from shelfline.session import scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
b AS (
  SELECT doc_id, t, lines, ws, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
  FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 3),
k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS c
  FROM p),
r AS (
  SELECT doc_id, count(DISTINCT pos) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM k WHERE c > 1) GROUP BY doc_id),
f AS (
  SELECT b.*, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed
  FROM b LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 100 * n_symbols > 10 * word_chars
            OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * len(lines))
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * length(regexp_replace(t, '[^!?]+', '', 'g')) > 15 * word_chars
            OR 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 50 * word_chars
            OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 60 * n_words) AS kept
FROM f
"""


@register("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality-rule cascade over all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH z AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM z GROUP BY source),
w AS (
  SELECT *, ([5, 2, 1])[(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget
  FROM s),
l AS (
  SELECT *, (budget - CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank
                                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level,
         cap::DOUBLE / weight AS r
  FROM w),
o AS (SELECT min_by(level, (r, rank)) AS level FROM l WHERE level * weight < cap),
t AS (
  SELECT l.source, rank, source_size,
         CASE WHEN l.level * weight >= cap THEN CAST(cap AS DOUBLE) ELSE o.level * weight END AS target
  FROM l LEFT JOIN o ON true),
q AS (
  SELECT z.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY k, z.doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - before))
            + greatest(0, least(size, floor(target) - before - source_size)) AS BIGINT) AS taken
FROM q
"""


@register("op5_mix_sources", OP5_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fair queueing of all documents to their sources' targets."""
    return mix_sources(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM k
"""


@register("op6_exact_dedup", OP6_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents on an extendible-hash index."""
    return exact_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op4_pack_documents")
def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Simple-8b token files and read back."""
    out = scratch_dir(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, out)


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@register("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    out = scratch_dir(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM w),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM c WHERE n > 1),
a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
k AS (
  SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) AS kept, count(*) AS n
  FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.p = r.p WHERE r.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@register("op3_substring_dedup", OP3_SQL)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under repeated 35-word windows removed from all documents."""
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op7_quality_model")
def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by naive Bayes support vectors."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(train_on_labels(docs, _table(spark, sf_dir, "labels")))
    return docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), score(F.col("text")).alias("score")
                       ).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)
  UNION ALL
  SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) IN (1, 2)),
n AS (SELECT d.doc_id, count(s.shingle) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
r AS (
  SELECT doc_id AS x, doc_id AS root FROM d
  UNION
  SELECT l.y, r.root FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) l ON r.x = l.x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM n JOIN r ON n.doc_id = r.x GROUP BY n.doc_id, n.n
"""


# The same with op13's threshold and its mark of the document that stays.
OP13_SQL = (OP10_SQL.replace("100 * k >= 90 *", "100 * k >= 85 *")
            .replace("AS component_id", "AS component_id, min(r.root) = n.doc_id AS kept"))


@register("op10_jaccard_join", OP10_SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that link at a Jaccard similarity of 0.9
    or more on 3-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _op11_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds; distances from inner products of whole numbers."""
    out = [r"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x
  FROM kept CROSS JOIN range(4) t(p)),
c0 AS MATERIALIZED (
  SELECT p, entry, x AS c
  FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry FROM parts) WHERE entry < 256)"""]
    for k in range(rounds + 1):
        out.append(f"""
d{k} AS MATERIALIZED (
  SELECT vec_id, p, min((far, entry)) AS best
  FROM (SELECT vec_id, p, entry, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c)
                                      + list_inner_product(c, c) AS BIGINT) AS far
        FROM parts JOIN c{k} USING (p)) GROUP BY vec_id, p),
a{k} AS MATERIALIZED (SELECT vec_id, p, best[1] AS far, best[2] AS entry FROM d{k})""")
        if k < rounds:
            out.append(f"""
m{k} AS (
  SELECT p, entry, list(mean ORDER BY i) AS c
  FROM (SELECT p, entry, i, floor(sum(x[i]) / count(*)) AS mean
        FROM (SELECT p, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{k} JOIN parts USING (vec_id, p))
        GROUP BY p, entry, i) GROUP BY p, entry),
c{k + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, entry))""")
    out.append(f"""
s AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, i)) AS sha
  FROM (SELECT p, entry, unnest(c) AS x, unnest(range(len(c))) AS i FROM c{rounds})),
r AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha AS codebooks_sha256
FROM r JOIN kept USING (vec_id) CROSS JOIN s
""")
    return ",".join(out)


@register("op11_vector_codes", _op11_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings after four active-entry Lloyd rounds."""
    coded, books = compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(b))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
held AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (
  SELECT run, k, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
        CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)]
             ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END))),
      lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h
  FROM held CROSS JOIN tab),
words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                       ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS MATERIALIZED (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN words w ON cut.rest = w.word
  UNION SELECT w.word, cut.word FROM cut JOIN words w ON cut.rest = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, max(m.n) AS most, arg_min(near.near, (-m.n, near.near)) AS form
  FROM near JOIN words m ON near.near = m.word GROUP BY near.word),
forms AS (
  SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN most >= 10 * n THEN form END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON chain.next = forms.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE next IS NULL
"""


@register("op12_spelling_variants", OP12_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return group_variants(corpus_words(_table(spark, sf_dir, "documents"))).select(
        "word", "form", "root", "n", "n_near", "form_n")


@register("op13_lsh_forest", OP13_SQL)
def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that link at a Jaccard similarity of 0.85
    or more on 3-word shingles, found by an LSH forest."""
    return forest_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
