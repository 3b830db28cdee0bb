"""The queries of the operators and the SQL that some of them can be held against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, importance, language_id, licenses, lm_scoring, mixing, near_dedup, packing, periods, pieces, quality, topk, toxicity
from .shared import crc_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


def planted(ids: list, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a document begins to repeat and its period: of those whose crc32(id) is divisible by 10."""
    h = crc_of(ids)
    g = h // 10
    begin = g % np.maximum(n_words, 1)
    return begin, np.where((h % 10 == 0) & (n_words > 0), 1 + (n_words - begin) // (3 + g % 8), 0)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_table(spark, sf_dir, "documents"), remake=planted)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length = -F.col("best.shorter")
    exponent = F.floor(1000 * length / F.col("best.period"))
    return found.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, ids, text = batch.columns
        sizes, flat = ids.value_lengths(), ids.flatten().to_numpy().astype("<u4", copy=False)
        ends = np.cumsum(sizes.to_numpy())
        of_ids = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends - sizes.to_numpy(), ends, strict=True)]
        of_text = [hashlib.sha256(t.encode()).hexdigest() for t in text.to_pylist()]
        return pa.RecordBatch.from_arrays([doc, sizes.cast(pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    encoded = pieces.encode(_table(spark, sf_dir, "documents"), model_path)
    return pieces.decode(encoded, model_path, then=digest, schema="doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_quality, op3_near_dedup, op4_toxicity, op5_top_k, op6_packing, op7_language_id, op8_license_scan, op9_nearest_neighbours, op10_lm_scoring, op11_periodic_runs, op12_importance_resampling, op13_sentencepiece)}

#: The table of crc32 by its polynomial, as a list; and the crc32 of a text by it, byte by byte.
_CRC_TABLE = """
e AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT range AS i FROM range(256))),
tab AS (SELECT list(v ORDER BY i) AS tab FROM e)"""


def _crc(text: str) -> str:
    """SQL for the crc32 of a text, where ``tab`` is at hand."""
    data = f"list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295)"


#: Operators that DuckDB can express.
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20250824:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS lim FROM s),
r AS (SELECT *, lim / weight AS ratio FROM w),
l AS (
  SELECT *,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM r),
f AS (SELECT *, ratio <= level AS is_full, max(CASE WHEN ratio <= level THEN NULL ELSE level END) OVER () AS settled FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN lim ELSE settled * weight END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
""",
    "op3_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS s FROM d),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT rep, n, unnest(s) AS shingle FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS n_a, b.n AS n_b, count(*) AS shared FROM u a JOIN u b USING (shingle)
  WHERE a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (n_a + n_b - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(m.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s AND len(s.s) > 0 LEFT JOIN m ON m.node = c.rep
""",
    "op5_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM u q JOIN u c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_periodic_runs": r"""
WITH """
    + _CRC_TABLE.strip()
    + r""",
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, """
    + _crc("coalesce(doc_id::VARCHAR, '')")
    + r""" AS h FROM documents, tab),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM d),
b AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
x AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN p IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END]) AS w FROM b),
u AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM x),
q AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM u l JOIN u r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
f AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM o GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
s AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.doc_id = f.doc_id AND y.q < f.q AND y.start <= f.start AND y.start + y.length >= f.start + f.length)),
t AS (SELECT doc_id, count(*) AS n_runs, min((-length, start, q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = u.doc_id AND u.i >= s.start + s.q AND u.i < s.start + s.length) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, 1000 * -best[1] // best[3] AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op12_importance_resampling": r"""
WITH """
    + _CRC_TABLE.strip()
    + r""",
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
m AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
u AS (SELECT doc_id, unnest(w) AS word FROM d),
k AS (SELECT word, """
    + _crc("word")
    + r""" % 10000 AS bucket FROM (SELECT word FROM u UNION SELECT word FROM m), tab),
s AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM m JOIN k USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM u) AS all_s, (SELECT count(*) FROM m) AS all_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM u JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN x USING (doc_id)),
p AS (SELECT *, n_features >= 20 AS may, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND nth <= 10 * n // 100 THEN nth END AS rank FROM p
""",
}
