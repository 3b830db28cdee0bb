"""More queries over the driver's tables: sources written and read back, answers, boxes, labels, joins and metrics, with DuckDB SQL."""

from __future__ import annotations

import json
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry, json_tools, numbers, text
from .operators import align, budget, facts, keyed, metrics, mixture
from .plans import nodes, specs
from .queries import _folders, op, query, table
from .session import shared_folder
from .sources import cache_build as caches
from .sources import files, pictures, shards, teacher
from .sources.archive import ZipSource
from .streaming import feed, incremental, reservoir

# --- sources: what a query writes, it reads back


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _one_document(rows: DataFrame, body: Column, path: str) -> None:
    """One JSON document made of all rows, as a file of one line."""
    rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", body.alias("_text")))), lambda x: x["_text"]), ","), F.lit("]")).alias("value")).write.text(path)


@query("SELECT event_id, user_id, event_type, CASE WHEN value > 50 THEN value END AS high FROM events")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines and back, nulls included."""
    path = _new_path(spark, "lines")
    files.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("high")), path)
    return files.read_jsonl(spark, path, "event_id long, user_id long, event_type string, high double")


@query("""SELECT 'c' || c_custkey AS record_id, '{"args":[{"ref":"f' || (c_nationkey + 1) || '"}],"op":"lookup"}' AS plan, 't' || (c_custkey % 3) AS teacher FROM customer""")
def plan_cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan cache, written sorted, read with the last line of an id."""
    path = _new_path(spark, "plans")
    plan = F.concat(F.lit('{"op": "lookup", "args": [{"ref": "f'), (F.col("c_nationkey") + 1).cast("string"), F.lit('"}]}'))
    files.write_plans(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), plan.alias("plan"), F.concat(F.lit("t"), (F.col("c_custkey") % 3).cast("string")).alias("teacher")), path)
    return files.read_plans(spark, path)


@query("""SELECT (row_number() OVER (ORDER BY human DESC, p_partkey) - 1)::BIGINT AS row, CASE WHEN human THEN 'human' ELSE 'machine' END AS question_kind, p_partkey || '.png' AS imgname, 'What is ' || p_name || '?' AS query, p_size::VARCHAR AS label
FROM (SELECT *, p_partkey % 3 = 0 AS human FROM part)""")
def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two question files, human questions first, rows numbered over both."""
    path, rows = _new_path(spark, "questions"), table(spark, sf_dir, "part").withColumn("_order", F.col("p_partkey"))
    body = F.to_json(F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("imgname"), F.concat(F.lit("What is "), F.col("p_name"), F.lit("?")).alias("query"), F.col("p_size").cast("string").alias("label")))
    _one_document(rows.where("p_partkey % 3 = 0"), body, f"{path}/val_human.json")
    _one_document(rows.where("p_partkey % 3 <> 0"), body, f"{path}/val_augmented.json")
    return files.question_rows(spark, path, "val")


MANIFEST_SQL = """WITH m AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS i, p_partkey, 'L' || (p_size % 4 + 1) AS level, ['vbar', 'pie'][(p_partkey % 2 + 1)::INT] AS chart_type, p_size % 5 = 0 AS holdout FROM part)
"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, i = _new_path(spark, "manifest"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").withColumn("_order", i)
    example = F.to_json(F.struct(F.concat(F.lit("e"), i.cast("string")).alias("example_id"), F.concat(F.lit("png/"), i.cast("string"), F.lit(".png")).alias("image"), F.concat(F.lit("L"), (F.col("p_size") % 4 + 1).cast("string")).alias("level"), F.get(F.array(F.lit("vbar"), F.lit("pie")), (i % 2).cast("int")).alias("chart_type"), (F.col("p_size") % 5 == 0).alias("holdout")))
    _one_document(rows, example, f"{path}/list")
    spark.read.text(f"{path}/list").select(F.concat(F.lit('{"examples":'), F.col("value"), F.lit("}"))).write.text(f"{path}/manifest.json")
    return files.read_manifest(spark, f"{path}/manifest.json", "/pictures")


@query(MANIFEST_SQL + "SELECT i AS source_row_index, 'e' || p_partkey AS example_id, level, chart_type, '/pictures/png/' || p_partkey || '.png' AS image_path FROM m WHERE NOT holdout")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of a manifest that aren't held out, numbered among all."""
    return _manifest(spark, sf_dir).select("source_row_index", "example_id", "level", "chart_type", "image_path")


@query(MANIFEST_SQL + "SELECT name, value, count(*) AS n FROM (SELECT unnest(['level', 'chart_type']) AS name, unnest([level, chart_type]) AS value FROM m WHERE NOT holdout) GROUP BY ALL")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of each level and chart type."""
    return files.manifest_summary(_manifest(spark, sf_dir))


@query("SELECT (doc_id * 7 % 1000003)::INT AS position, doc_id::VARCHAR AS record_id FROM documents")
def mixture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture's ids and composition as tables of one folder."""
    path, d = _new_path(spark, "mixture"), table(spark, sf_dir, "documents")
    ids = d.select((F.col("doc_id") * 7 % 1000003).cast("int").alias("position"), F.col("doc_id").cast("string").alias("record_id"))
    files.write_mixture(ids, mixture.composition(d.select("lang"), ["lang"]), path)
    return files.read_mixture_ids(spark, path)


@query("SELECT position, d.doc_id, d.lang FROM (SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS position, item_id * 2 AS id FROM benchmark) JOIN documents d ON d.doc_id = id")
def id_list_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids in a file, and its records in the list's order."""
    path = _new_path(spark, "ids")
    _one_document(table(spark, sf_dir, "benchmark").withColumn("_order", F.col("item_id")), F.concat(F.lit('"'), (F.col("item_id") * 2).cast("string"), F.lit('"')), f"{path}/list")
    spark.read.text(f"{path}/list").select(F.concat(F.lit('{"record_ids":'), F.col("value"), F.lit("}"))).write.text(f"{path}/ids.json")
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "lang")
    found = keyed.slice_in_order(records, files.read_id_list(spark, f"{path}/ids.json")).where("_found")
    return found.select("position", F.col("record_id").cast("long").alias("doc_id"), "lang")


@query("SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // 25)::BIGINT AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY doc_id, lang HAVING false UNION ALL SELECT b, count(*), min(doc_id), max(doc_id) FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 25)::BIGINT AS b FROM documents) GROUP BY b")
def mining_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request files of 25 records each, one folder a batch."""
    path = _new_path(spark, "mining")
    files.mining_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", path, 25)
    return spark.read.schema("doc_id long, batch long").json(path).groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT doc_id AS record_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a log (here the labels) doesn't have yet."""
    return files.remaining(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id")))


@query("SELECT 'p' || p_partkey AS record_id, 'answer to ' || p_name AS reply FROM part")
def teacher_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teacher's replies through a transport, its thoughts cut off."""
    requests = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("record_id"), F.col("p_name").alias("prompt"))
    return teacher.replies(requests, lambda prompt: f"<think>{prompt}\n?</think>\n answer to {prompt} ")


@query("SELECT 'p' || p_partkey AS record_id, NULL::VARCHAR AS reply FROM part")
def teacher_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is asked after the deadline."""
    requests = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("record_id"), F.col("p_name").alias("prompt"))
    return teacher.replies(requests, lambda prompt: prompt, deadline=1.0)


@query("""SELECT 'nations/' || n_nationkey || '.csv' AS name, n_name AS label, n_name || ' "' || n_regionkey || '", ' || n_nationkey AS comment, 2 AS n_rows FROM nation""")
def zip_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as members of an archive: quoted cells, blank lines."""
    path = _new_path(spark, "archive").removeprefix("file://") + ".zip"
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    with zipfile.ZipFile(path, "w") as z:
        for r in table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", """n_name || ' "' || n_regionkey || '", ' || n_nationkey""").collect():  # 25 rows by definition
            z.writestr(f"nations/{r[0]}.csv", f"name,comment\n\n{quoted(r[1])},{quoted(r[2])}\n,\n\nlast,\n")
        z.writestr("other.txt", "no")
    spark.dataSource.register(ZipSource)
    rows = spark.read.format("zip_members").option("path", path).option("prefix", "nations/").option("members_per_task", 5).load()
    parsed = rows.select("name", files.parse_table(files.member_text(F.col("content"))).alias("t"))
    return parsed.select("name", F.get(F.get("t.rows", 0), 0).alias("label"), F.get(F.get("t.rows", 0), 1).alias("comment"), F.size("t.rows").alias("n_rows"))


@query("""SELECT p_partkey, '/d/png/' || p_partkey || '.v1.png' AS image, '/d/tables/' || p_partkey || '.v1.csv' AS csv, '/d/annotations/' || p_partkey || '.v1.json' AS annotation,
  lpad(p_partkey::VARCHAR, 6, '0') || '_' || substr(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 80) || '.png' AS safe FROM part""")
def record_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a record's files lie, and a file name made of any id."""
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".v1.png"))
    return table(spark, sf_dir, "part").select("p_partkey", files.image_path("/d", name).alias("image"), files.table_path("/d", name).alias("csv"), files.annotation_path("/d", name).alias("annotation"), text.safe_file_name(F.col("p_partkey"), F.concat_ws("/", "p_name", "p_brand")).alias("safe"))


@query("""SELECT split, outcome, count(*) AS n FROM (
  SELECT ['train', 'validation', 'validation', 'test'][(p_partkey % 4 + 1)::INT] AS split,
    CASE WHEN p_size % 7 = 0 THEN 'missing_image' WHEN p_size % 5 = 0 THEN 'malformed' WHEN p_size % 3 = 0 THEN 'no_usable_box' WHEN p_size % 2 = 0 THEN 'held_out_image' ELSE 'accepted' END AS outcome FROM part) GROUP BY ALL""")
def row_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of splits, and what becomes of source rows."""
    split = files.upstream_split(F.get(F.array(*[F.lit(x) for x in ("train", "val", "dev", "test")]), (F.col("p_partkey") % 4).cast("int")))
    n = F.col("p_size")
    outcome = files.row_outcome(n % 7 != 0, n % 5 != 0, n % 3 != 0, n % 2 == 0)
    return table(spark, sf_dir, "part").groupBy(split.alias("split"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT 'lang' AS name, coalesce(CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE CASE WHEN lang IS NOT NULL THEN 'other' END END, 'null') AS value, count(*) AS n FROM documents GROUP BY ALL
UNION ALL SELECT 'quality', coalesce(quality::VARCHAR, 'null'), count(*) FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY ALL""")
def manifest_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a manifest, whose summary one job counts."""
    path = _new_path(spark, "manifest")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    files.write_manifest(rows, path, 20250824, {"lang": ("en", "fr", "de"), "quality": (0, 1)})
    return files.manifest_histograms(spark, path)


@query("SELECT epoch.range::INT AS step, count(*) AS n, avg(o_totalprice) AS loss FROM orders, range(3) epoch WHERE o_orderkey % 3 <= epoch.range GROUP BY ALL")
def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of three evaluations, logged a step each, the last one twice."""
    path, orders = _new_path(spark, "metrics"), table(spark, sf_dir, "orders")
    for step in (0, 1, 2, 2):
        files.log_metrics(orders.where(F.col("o_orderkey") % 3 <= step).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("loss")), path, step)
    return files.read_metrics(spark, path, "n long, loss double")


def _pinned(rows: DataFrame, order: str, path: str, n: int = 6) -> DataFrame:
    """Rows written as shards in the order of a column, and their pins, read from their file."""
    rows.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(f"{path}/shards")
    shards.write_pins(shards.pin(rows.sparkSession, f"{path}/shards"), f"{path}/pins")
    return shards.read_pins(rows.sparkSession, f"{path}/pins")


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS source_row_index FROM documents")
def pinned_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pinned shards, with a file beside them that isn't; rows counted through all shards."""
    path = _new_path(spark, "shards")
    pins = _pinned(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", path)
    spark.range(3).selectExpr("-id AS doc_id", "'no' AS lang").write.mode("append").parquet(f"{path}/shards")
    return shards.read_pinned(spark, f"{path}/shards", pins)


CACHE_SQL = """
WITH l AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id),
s AS (
  SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) - 1 AS source_row_index, CASE WHEN n_chars % 13 <> 0 THEN sha256(text) END AS hash,
    CASE quality WHEN 1 THEN 'human' WHEN 0 THEN 'machine' ELSE CASE WHEN lang = 'en' THEN 'pot' END END AS kind,
    CASE WHEN toxic = 1 THEN 0 ELSE d.doc_id % 3 + 1 END AS raw, d.doc_id % 17 = 0 AND toxic IS DISTINCT FROM 1 AS bad,
    list_transform(range(CASE WHEN toxic = 1 THEN 0 ELSE d.doc_id % 3 + 1 END), lambda k: d.doc_id * 37 % 900 + k * 10) AS x, n_chars % 50 AS w, n_chars % 300 AS y
  FROM documents d LEFT JOIN l USING (doc_id) WHERE d.doc_id % 10 < 9),
b AS (SELECT *, list_filter(list_transform(x, lambda a: [least(1000.0, 1000.0 * a / 800), least(1000.0, 1000.0 * (a + w) / 800)]::DOUBLE[]), lambda p: p[2] > p[1]) AS boxes FROM s),
o AS (
  SELECT *, CASE WHEN hash IS NULL THEN 'missing_image' WHEN kind IS NULL OR bad THEN 'malformed' WHEN len(boxes) = 0 THEN 'no_usable_box'
    WHEN hash IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 9) THEN 'held_out_image' ELSE 'accepted' END AS outcome FROM b)
"""


def _built_cache(spark: SparkSession, sf_dir: str) -> str:
    """Documents as rows of a grounded set, cached from shards in batches of two; a second run finds nothing to do."""
    path, i, n = _new_path(spark, "cache"), F.col("doc_id"), F.col("n_chars")
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    width = F.when(i % 17 == 0, F.lit(-1.0)).otherwise((n % 50).cast("double"))
    box = lambda k: F.struct((i * 37 % 900 + k * 10).cast("double").alias("x"), (n % 300).cast("double").alias("y"), width.alias("w"), F.lit(20.0).alias("h"))
    rows = docs.where(i % 10 < 9).join(labels, "doc_id", "left").select(
        i.alias("id"), F.when(n % 13 != 0, F.sha2("text", 256)).alias("image_hash"), F.lit(800).alias("width"), F.lit(400).alias("height"),
        F.concat(F.lit("What does  "), i.cast("string"), F.lit(" say?")).alias("query"), F.col("lang").alias("label"),
        F.when(F.col("quality") == 1, "Human").when(F.col("quality") == 0, "MACHINE").when(F.col("lang") == "en", "pot").otherwise("chart").alias("type"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 0, F.transform(F.sequence(F.lit(0).cast("long"), i % 3), box)).alias("grounding_bboxes"), F.lit(None).cast("string").alias("response"),
    )
    pins = _pinned(rows, "id", path)
    held_out = docs.where(i % 10 == 9).select(F.sha2("text", 256).alias("image_hash"))
    for _ in range(2):
        caches.build(shards.stream_pinned(spark, f"{path}/shards", pins, 2), held_out, f"{path}/cache")
    return f"{path}/cache"


@query(CACHE_SQL + """SELECT source_row_index, doc_id::VARCHAR AS source_id, kind AS question_kind, len(boxes)::INT AS n_boxes, (raw - len(boxes))::INT AS dropped, boxes[1][1] AS x1, boxes[1][2] AS x2,
  'grounded_train_' || substr(sha256('grounded|train|' || source_row_index || '|' || hash || '|what does ' || doc_id || ' say'), 1, 16) AS record_id FROM o WHERE outcome = 'accepted'""")
def cache_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a cache."""
    first = F.element_at("boxes", 1)
    rows = caches.records(spark, _built_cache(spark, sf_dir))
    return rows.select("source_row_index", "source_id", "question_kind", F.size("evidence").alias("n_boxes"), F.col("meta.boxes_dropped_outside_image").alias("dropped"), first[0].alias("x1"), first[2].alias("x2"), "record_id")


@query(CACHE_SQL + "SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def cache_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the rows of a cache."""
    return caches.outcomes(spark, _built_cache(spark, sf_dir))


@query(f"""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents),
k AS (SELECT e.range AS epoch, r.range AS r, sha256('11|' || e.range || '|' || r.range) AS h FROM range(3) e, range({feed.ROUNDS}) r),
kk AS (SELECT epoch, r, ('0x' || substr(h, 1, 15))::BIGINT % n AS middle, ('0x' || substr(h, 16, 7))::BIGINT AS a, ('0x' || substr(h, 23, 7))::BIGINT AS b FROM k, n),
p AS (SELECT unnest(range(3 * (n // 2 + 1))) AS place, n FROM n),
w AS (
  SELECT place, n, place // n AS epoch, place % n AS x, 0 AS r FROM p
  UNION ALL
  SELECT place, n, epoch, CASE WHEN (c * c + b) % 2147483647 // 1024 % 2 = 1 THEN m ELSE x END, r + 1
  FROM (SELECT *, (greatest(x, m) + a) % 2147483647 AS c FROM (SELECT w.*, a, b, (middle + n - x) % n AS m FROM w JOIN kk USING (epoch, r))))
SELECT doc_id, place, epoch, place % n AS position, (row_number() OVER (ORDER BY place) - 1) // 16 AS number FROM w JOIN d ON d.row = w.x WHERE r = {feed.ROUNDS} AND doc_id % 7 <> 0""")
def endless_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of half an epoch each, the last two by a second run; usable documents in numbered training batches."""
    path = _new_path(spark, "feed")
    docs = keyed.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").withColumnRenamed("_place", "row")
    size = docs.count() // 2 + 1
    for until in (1, 3):
        feed.run(docs, F.col("doc_id") % 7 != 0, path, size, until, 11)
    fed = feed.training_batches(spark, path, 16)
    return fed.where("batch < 3").select("doc_id", "place", "epoch", "position", "number")


@query("SELECT doc_id, lang, (SELECT count(*) FROM documents) AS seen FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('13|' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 25")
def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of each language's documents, which come as a stream of four files, two a run."""
    path, docs = _new_path(spark, "reservoir"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    for half in (0, 1):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half).repartition(2).write.mode("append").parquet(f"{path}/rows")
        ledger = reservoir.sample_stream(incremental.stream(spark, f"{path}/rows", docs.schema, 1), "lang", 25, 13, "doc_id", f"{path}/out")
    return reservoir.sample(spark, f"{path}/out").join(F.broadcast(ledger.totals().select(F.col("n").alias("seen"))))


ANNOTATION_SQL = """WITH m AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS k FROM nation)
"""


@query(ANNOTATION_SQL + """SELECT n_regionkey, 's' AS series, n_name AS label, n_nationkey::VARCHAR AS value, CASE WHEN k = 1 THEN NULL ELSE 'c' || k END AS colour,
  array_to_string([k * 100.0 * 1000 / 800, 0.0, least(1000.0, (k * 100.0 + 50) * 1000 / 800), (n_nationkey + 1) * 1000.0 / 400], ',') AS box FROM m WHERE n_regionkey % 2 = 0 AND k <> 2
UNION ALL SELECT n_regionkey, NULL, n_name, n_nationkey::VARCHAR, NULL, array_to_string([0.0, 0.0, 10.0 * 1000 / 800, (k + 1) * 1000.0 / 400], ',') FROM m WHERE n_regionkey % 2 = 1 AND k <> 3""")
def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and wedges of annotations, unknown colours and boxes of no area."""
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")) - 1
    rows = table(spark, sf_dir, "nation").withColumn("k", k)
    box = lambda x, w, h: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("k", x.alias("v")))), lambda s: s["v"])
    bars = F.struct(F.lit("s").alias("name"), listed(F.col("n_name")).alias("x"), listed(F.col("n_nationkey").cast("string")).alias("y"), listed(box(F.col("k") * 100, F.when(F.col("k") == 2, 0).otherwise(50), F.col("n_nationkey") + 1)).alias("bboxes"), listed(F.when(F.col("k") == 1, "unk").otherwise(F.concat(F.lit("c"), F.col("k").cast("string")))).alias("colors"))
    wedge = F.struct(F.when(F.col("k") != 3, F.col("n_name")).alias("text_label"), F.col("n_nationkey").cast("string").alias("value"), box(F.lit(0), F.lit(10), F.col("k") + 1).alias("bbox"), F.lit("unk").alias("color"))
    made = rows.groupBy("n_regionkey").agg(F.to_json(F.struct(F.lit("v_bar").alias("type"), F.array(bars).alias("models"))).alias("bar"), F.to_json(F.struct(F.lit("pie").alias("type"), listed(wedge).alias("models"))).alias("pie"))
    elements = files.annotation_elements(F.when(F.col("n_regionkey") % 2 == 0, F.col("bar")).otherwise(F.col("pie")), F.lit(800), F.lit(400))
    out = made.select("n_regionkey", F.explode(elements).alias("e"))
    return out.select("n_regionkey", "e.series", "e.label", "e.value", "e.colour", F.array_join(F.col("e.bbox").cast("array<string>"), ",").alias("box"))


# --- answers, units, labels


@query("""SELECT p_partkey, ['vbar', 'hbar', 'unknown', 'line'][(p_partkey % 4 + 1)::INT] AS kind, CASE p_partkey % 3 WHEN 0 THEN '%' WHEN 1 THEN '$' END AS unit, 'kg' AS declared FROM part""")
def chart_types_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of chart types; units declared or read off a value."""
    raw = F.get(F.array(*[F.lit(x) for x in ("v_bar", "h_bar", "", "line")]), (F.col("p_partkey") % 4).cast("int"))
    shown = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("% "))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("$"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.chart_type(raw).alias("kind"), text.unit_of(shown, F.lit("")).alias("unit"), text.unit_of(shown, F.lit("kg")).alias("declared"))


@query("SELECT p_partkey, 'Which ' || p_name || '?' AS question FROM part")
def prompt_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt filled from a template, and its question read back."""
    prompt = text.fill_template("Table of {brand}\nQUESTION: {question}  \nQUESTION: another", brand=F.col("p_brand"), question=F.concat(F.lit("Which "), F.col("p_name"), F.lit("?")))
    return table(spark, sf_dir, "part").select("p_partkey", text.question_of(prompt).alias("question"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(x - round(x)) < 1e-9 THEN round(x)::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.2f', x), '0'), '.') END AS shown,
  CASE l_linenumber % 3 WHEN 0 THEN (CASE WHEN l_tax > 0.04 THEN 'Yes' ELSE 'No' END) WHEN 1 THEN (l_quantity::BIGINT)::VARCHAR ELSE l_returnflag END AS answer FROM (SELECT *, l_quantity / 4 AS x FROM lineitem)""")
def answers_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as answers: at most two decimals; Yes or No, whole numbers, text."""
    form, of = F.col("l_linenumber") % 3, lambda k, x: F.when(F.col("l_linenumber") % 3 == k, x)
    answer = numbers.as_answer(of(1, F.col("l_quantity").cast("double")), of(2, F.col("l_returnflag")), F.when(form == 0, F.col("l_tax") > 0.04))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.format_answer(F.col("l_quantity") / 4).alias("shown"), answer.alias("answer"))


@query("SELECT p_partkey, '<box>' || p_size || ',1,' || (p_size + 9) || ',7</box><box>1,2,3,4</box><grounding-sep>' || p_brand AS shown FROM part")
def predictions_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and answer in the scorer's notation."""
    boxes = F.array(F.array(F.col("p_size").cast("int"), F.lit(1), (F.col("p_size") + 9).cast("int"), F.lit(7)), F.array(*[F.lit(i) for i in (1, 2, 3, 4)]))
    return table(spark, sf_dir, "part").select("p_partkey", text.format_prediction(boxes, F.col("p_brand")).alias("shown"))


@query("""WITH n AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, 'name | size' || chr(10) || list_reduce(list_transform(l[1:3], lambda x: x || ' | ' || len(x)), lambda a, x: a || chr(10) || x) || chr(10) || '… and ' || (len(l) - 3) || ' further rows' AS shown,
  ' among ' || list_reduce(l[1:4], lambda a, x: a || ', ' || x) || ', and ' || l[5] AS scope FROM n""")
def tables_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's header and first rows, and labels as a phrase."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    cells = F.transform("l", lambda x: F.array(x, F.length(x).cast("string")))
    return rows.select("n_regionkey", text.render_table(F.array(F.lit("name"), F.lit("size")), cells, 3).alias("shown"), text.scope_phrase(F.col("l")).alias("scope"))


@query("""SELECT p_partkey, ['year', 'quarter', 'month', 'age group', 'category'][(p_partkey % 5 + 1)::INT] AS noun,
  CASE p_size % 7 WHEN 0 THEN 'first' WHEN 6 THEN 'last' WHEN 1 THEN 'second' WHEN 2 THEN 'third' ELSE 'number ' || (p_size % 7 + 1) END AS place,
  CASE WHEN p_size % 7 = 3 THEN NULL WHEN p_size % 7 = 5 THEN NULL ELSE 'the ' || ['red', 'blue', 'teal', 'x', 'pink', 'x', 'grey'][(p_size % 7 + 1)::INT] || ' one' END AS colour FROM part""")
def label_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels name, and elements by place and by colour."""
    kinds = (("2001", "2002"), ("Q1 2020", "q2"), ("Jan", "March"), ("10-19", "20 to 29"), ("a", "b"))
    labels = F.get(F.array(*[F.array(*[F.lit(x) for x in k]) for k in kinds]), (F.col("p_partkey") % 5).cast("int"))
    i = (F.col("p_size") % 7).cast("int")
    colours = F.array(*[F.lit(c) for c in ("red", "blue", "teal", "x", "pink", "x", "grey")])
    return table(spark, sf_dir, "part").select("p_partkey", text.entity_noun(labels).alias("noun"), text.position_reference(i, F.lit(7)).alias("place"), text.colour_reference(colours, i).alias("colour"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' of old' WHEN 1 THEN p_name ELSE p_name || ' of old, cut' END AS wanted,
  CASE WHEN p_partkey % 3 = 0 THEN 'other' WHEN p_partkey % 3 = 1 THEN p_name ELSE p_name || ' of old' END AS renamed, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS series, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' · x' END AS category
FROM part WHERE length(p_name) >= 8 AND p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, p_name || ' of old', p_name || ' of old', CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' · x' END FROM part WHERE length(p_name) >= 8 AND p_partkey % 3 = 0""")
def truncated_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operands that a fact's name was cut from, and the parts of qualified labels."""
    name = F.concat(F.col("p_name"), F.lit(" of old"))
    operand = F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(name, F.lit(", cut")))
    names = F.when(F.col("p_partkey") % 3 == 1, F.array(F.col("p_name"), name)).otherwise(F.array(name, F.lit("short")))
    parts = text.label_parts(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_brand"), F.lit(" · "), F.col("p_name"), F.lit(" · x"))).otherwise(F.concat(F.lit(" · "), F.col("p_name"))))
    rows = table(spark, sf_dir, "part").where(F.length("p_name") >= 8)
    return rows.select("p_partkey", operand.alias("wanted"), text.rename_truncated(operand, names).alias("renamed"), parts["series"].alias("series"), parts["category"].alias("category"))


# --- boxes

_BOX_SQL = """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 40) * 30.0 AS x, (l_suppkey % 20) * 60.0 AS y, (l_quantity % 7) * 40.0 AS w, (l_linenumber % 3) * 100.0 AS h FROM lineitem)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", ((F.col("l_partkey") % 40) * 30.0).alias("x"), ((F.col("l_suppkey") % 20) * 60.0).alias("y"), ((F.col("l_quantity") % 7) * 40.0).cast("double").alias("w"), ((F.col("l_linenumber") % 3) * 100.0).alias("h"))


def _listed(box: Column) -> Column:
    return F.array_join(F.transform(box, lambda v: F.format_string("%.3f", v.cast("double"))), ",")


@query(_BOX_SQL + """, c AS (SELECT *, least(1000.0, x * 1000 / 1000) AS x1, least(1000.0, y * 1000 / 800) AS y1, least(1000.0, (x + w) * 1000 / 1000) AS x2, least(1000.0, (y + h) * 1000 / 800) AS y2 FROM b),
d AS (SELECT *, x2 > x1 AND y2 > y1 AS big FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN big THEN printf('%.3f,%.3f,%.3f,%.3f', x1, y1, x2, y2) END AS box, CASE WHEN big THEN printf('%.3f,%.3f,%.3f,%.3f', round_even(least(999.0, x1), 0), round_even(least(999.0, y1), 0), round_even(least(999.0, x2), 0), round_even(least(999.0, y2), 0)) END AS clamped,
  printf('%.3f,%.3f,%.3f,%.3f', x * 1000 / 500, y * 1000 / 250, (x + w) * 1000 / 500, (y + h) * 1000 / 250) AS scaled, big::INT AS n_boxes FROM d""")
def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel boxes as corners on the canvas, without those of no area, scaled and clamped."""
    x, y, w, h = (F.col(c) for c in "xywh")
    box = geometry.xywh_to_box(x, y, w, h, F.lit(1000), F.lit(800))
    good = geometry.box_or_null(box)
    scaled = geometry.pixels_to_box(F.array(x, y, x + w, y + h), F.lit(500), F.lit(250))
    rows = _lines(spark, sf_dir).withColumns({"good": good, "scaled": scaled, "n_boxes": F.size(geometry.boxes_with_area(F.array(box)))})
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("good").isNotNull(), _listed(F.col("good"))).alias("box"), F.when(F.col("good").isNotNull(), _listed(geometry.clamp_box(F.col("good")))).alias("clamped"), _listed(F.col("scaled")).alias("scaled"), "n_boxes")


@query(_BOX_SQL + """SELECT l_orderkey, l_linenumber, printf('%.3f,%.3f,%.3f,%.3f', least(1000, greatest(0, x - w * 0.35)), least(1000, greatest(0, y - h * 0.35)), least(1000, greatest(0, x + w + w * 0.35)), least(1000, greatest(0, y + h + h * 0.35))) AS larger,
  w < 80 OR h < 80 AS thin FROM b""")
def box_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with room around them, clipped; and those too thin to show."""
    x, y, w, h = (F.col(c) for c in "xywh")
    box = F.array(x, y, x + w, y + h)
    return _lines(spark, sf_dir).withColumn("box", box).select("l_orderkey", "l_linenumber", _listed(geometry.expand(F.col("box"))).alias("larger"), geometry.is_degenerate(F.col("box"), 80.0).alias("thin"))


@query("""WITH s AS (SELECT o_orderkey, (o_orderkey % 37 + 1) * 60 AS w, (o_custkey % 29 + 1) * 45 AS h FROM orders),
r AS (SELECT *, greatest(28, round_even(w / 28.0, 0) * 28) AS rw, greatest(28, round_even(h / 28.0, 0) * 28) AS rh, sqrt(w::DOUBLE * h / 1003520.0) AS shrink, sqrt(3136.0 / (w * h)) AS grow FROM s)
SELECT o_orderkey, (CASE WHEN rw * rh > 1003520 THEN greatest(28, floor(w / shrink / 28) * 28) WHEN rw * rh < 3136 THEN ceil(w * grow / 28) * 28 ELSE rw END)::INT AS width,
  (CASE WHEN rw * rh > 1003520 THEN greatest(28, floor(h / shrink / 28) * 28) WHEN rw * rh < 3136 THEN ceil(h * grow / 28) * 28 ELSE rh END)::INT AS height FROM r""")
def picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture sizes as multiples of a patch within a budget of pixels."""
    size = geometry.smart_size(((F.col("o_orderkey") % 37 + 1) * 60).cast("double"), ((F.col("o_custkey") % 29 + 1) * 45).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", size.alias("s")).select("o_orderkey", "s.width", "s.height")


@query("""WITH e AS (SELECT l_orderkey, 'f' || l_linenumber AS id, (l_partkey % 40)::DOUBLE AS x, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS nth FROM lineitem)
SELECT l_orderkey, count(*) AS n, sum(x) AS total FROM e WHERE nth = 1 AND id IN ('f1', 'f3') AND x <> 7 GROUP BY l_orderkey""")
def evidence_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of cited facts; malformed ones don't count."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # noqa: E741
    x = (F.col("l_partkey") % 40).cast("double")
    fact = F.struct("l_partkey", "l_suppkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("id"), F.when(x == 7, F.array(x, x)).otherwise(F.array(x, F.lit(0.0), F.lit(99.0), F.lit(9.0))).alias("bbox"))
    cited = geometry.cited_boxes(F.array(F.lit("f1"), F.lit("f3"), F.lit("f99")), F.col("facts"))
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(fact)).alias("facts")).select("l_orderkey", F.explode(cited).alias("b"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.get("b", 0)).alias("total"))


# --- agreement of answers


@query("""SELECT l_linenumber, count(*) AS n, sum(CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 1 END)::BIGINT AS agree,
  sum(CASE WHEN l_linenumber % 3 = 0 THEN (0.06 * x <= 0.05 * greatest(x, 1.06 * x))::INT WHEN l_linenumber % 3 = 1 THEN (0.04 * x <= 0.05 * 1.04 * x)::INT ELSE 1 END)::BIGINT AS answers
FROM (SELECT *, l_quantity::BIGINT AS x FROM lineitem) GROUP BY l_linenumber""")
def value_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table values against annotations (near, far, a hundredth, unreadable), and answers within 5 % either way or equal as text."""
    x, k = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    other = F.when(k % 4 == 0, (x * 1.01).cast("string")).when(k % 4 == 1, (x * 1.5).cast("string")).when(k % 4 == 2, F.concat((x * 100).cast("string"), F.lit("%"))).otherwise(F.lit("n/a"))
    shown = F.when(k % 3 == 0, (x * 1.06).cast("string")).when(k % 3 == 1, F.concat(F.lit("$"), (x * 1.04).cast("string"))).otherwise(F.lit(" Yes"))
    said = F.when(k % 3 == 2, F.lit("yes ")).otherwise(x.cast("string"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(numbers.values_agree(x.cast("string"), other)).alias("agree"), F.count_if(numbers.answers_agree(said, shown)).alias("answers"))


@query("""SELECT p_partkey, round(CASE WHEN s < 50 THEN (s + 1) / 50.0 ELSE greatest(0, 0.5 * (1 + cos(pi() * least(1.0, (s - 50) / 450.0)))) END, 9) AS cosine, round(CASE WHEN s < 50 THEN (s + 1) / 50.0 ELSE greatest(0, 1 - least(1.0, (s - 50) / 450.0)) END, 9) AS linear
FROM (SELECT p_partkey, p_partkey % 600 AS s FROM part)""")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up and decay of a learning rate by step."""
    step = F.col("p_partkey") % 600
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.warmup_decay(step, 500, 50), 9).alias("cosine"), F.round(numbers.warmup_decay(step, 500, 50, "linear"), 9).alias("linear"))


@query("SELECT event_id, event_id % 4 < 2 AS finite FROM events")
def finite_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON whose numbers are all finite."""
    form = F.col("event_id") % 4
    shown = F.when(form == 0, F.col("props")).when(form == 1, F.lit('{"a": [1.5e3, "NaN", null]}')).when(form == 2, F.lit('{"a": [1, NaN]}')).otherwise(F.lit('{"a": 1'))
    return table(spark, sf_dir, "events").select("event_id", json_tools.is_finite_json(shown).alias("finite"))


@query("""WITH v AS (SELECT c_nationkey, c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY ALL),
s AS (SELECT c_nationkey, list(n ORDER BY c_mktsegment) AS v, sum(n) AS t FROM v GROUP BY c_nationkey),
c AS (SELECT *, list_transform(v, lambda x: floor(x / t * 10000)) AS c FROM s),
p AS (SELECT *, list_position(c, list_max(c)) AS top, 10000 - list_sum(c) AS rest FROM c)
SELECT c_nationkey, array_to_string(list_transform(c, lambda x, i: printf('%.2f', (CASE WHEN i = top THEN x + rest ELSE x END) / 100)), ',') AS shares, 0.0::DOUBLE AS low, list_max(v) * 1.1 AS high FROM p""")
def shares_and_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that add up to a hundred, and an axis with room above."""
    v = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("double").alias("n"))
    rows = v.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n"))), lambda x: x["n"]).alias("v"))
    shares = F.transform(numbers.normalised_percentages(F.col("v")), lambda x: F.format_string("%.2f", x))
    return rows.select("c_nationkey", F.array_join(shares, ",").alias("shares"), numbers.axis_limits(F.col("v")).alias("a")).select("c_nationkey", "shares", "a.low", "a.high")


# --- replies


@query("""SELECT batch, 'r' || k AS record_id, CASE WHEN k % 3 = 0 THEN 'op' ELSE 'refused' END AS kind FROM (SELECT DISTINCT p_partkey // 10 AS batch FROM part), (SELECT unnest(range(4)) AS k) WHERE k <> 2""")
def batched_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of several records in one reply: the last block that has any, known ids, one outcome each."""
    reply = 'First:\n```json\n{"outcomes": {"r0": {"refused": "x"}}}\n```\nThen\n```json\n{"outcomes": {"r0": {"op": "sum"}, "r1": {"refused": "y"}, "r2": {"op": "sum", "refused": "z"}, "r3": {"op": "lookup"}, "r9": {"op": "sum"}}}\n```\n'
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).cast("long").alias("batch")).distinct()
    found = json_tools.batched_outcomes(F.lit(reply), F.array(*[F.lit(f"r{i}") for i in range(4)]))
    out = rows.select("batch", F.explode(found).alias("record_id", "v"))
    return out.select("batch", "record_id", F.when(F.try_variant_get("v", "$.op", "string").isNotNull(), "op").otherwise("refused").alias("kind"))


@query("""SELECT CASE f WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected:does_not_reproduce_the_answer' WHEN 3 THEN 'teacher_refused' WHEN 4 THEN 'malformed_response' WHEN 5 THEN 'missing_response' ELSE 'accepted' END AS outcome,
  CASE f WHEN 1 THEN 'shortcut' WHEN 6 THEN 'untrainable' END AS set_aside, count(*) AS n, count(CASE WHEN f = 0 THEN 1 END) AS kept FROM (SELECT p_partkey % 7 AS f FROM part) GROUP BY ALL""")
def mining_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies scored, accepted plans built and distrusted, the rest kept."""
    from .plans import mining

    form = F.col("p_partkey") % 7
    lookup = json.dumps(op("lookup", [{"ref": "f1"}]))
    reply = F.when(form == 3, F.lit('{"refused": "unclear"}')).when(form == 4, F.lit("no")).when(form == 5, F.lit(" ")).otherwise(F.lit(lookup))
    box = F.array(*[F.lit(float(x)) for x in (1, 1, 9, 9)])
    element = lambda label, num: F.struct(label.alias("label"), num.cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("string").alias("unit"), box.alias("bbox"))
    # two elements of one name can't be told apart in a target
    elements = F.array(element(F.lit("a"), F.col("p_size")), element(F.when(form == 6, "a").otherwise("b"), F.lit(3)))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("record_id"), F.when(form == 1, "What is the highest value?").otherwise("What is a?").alias("question"), reply.alias("reply"),
        F.when(form == 2, (F.col("p_size") + 7).cast("string")).otherwise(F.col("p_size").cast("string")).alias("answer"), elements.alias("elements"), F.array(F.lit(0)).alias("evidence"),
    )
    kept = F.sum(F.when(F.col("plan").isNotNull(), F.col("n")).otherwise(0))
    return mining.scored(mining.counted(rows)).groupBy("outcome", "set_aside").agg(F.sum("n").alias("n"), kept.alias("kept"))


@query("""SELECT p_partkey, p_partkey % 3 <> 0 AS compositional, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 3.0 ELSE p_size * 1.0 / (p_size + 3) END AS num FROM part""")
def plans_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that name facts by their labels, folds that list none, and which plans are more than a lookup."""
    form = F.col("p_partkey") % 3
    plan = F.when(form == 0, F.lit(json.dumps(op("lookup", ["a"])))).when(form == 1, F.lit(json.dumps(op("sum")))).otherwise(F.lit(json.dumps(op("ratio", ["a"], [op("sum")]))))
    fact = lambda i, label, num: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), num.cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("string").alias("unit"))
    rows = table(spark, sf_dir, "part").withColumn("plan", nodes.read(plan)).withColumn("facts", F.array(fact("f1", "a", F.col("p_size")), fact("f2", "b", F.lit(3))))
    result = nodes.evaluate(F.col("plan"), F.col("facts"), 2, by_label=True)
    return rows.select("p_partkey", nodes.is_compositional(F.col("plan")).alias("compositional"), result["num"].alias("num"))


AWKWARD_SQL = """
WITH v AS (SELECT n_regionkey AS r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation),
f AS (SELECT r, k, CASE WHEN k = 1 THEN 'S · ' || n_name ELSE n_name END AS label, CASE WHEN r = 1 AND k = 3 THEN NULL WHEN r = 2 AND k = 2 THEN NULL WHEN r = 4 AND k = 2 THEN 1200.0 WHEN r = 0 AND k >= 4 THEN 50.0 ELSE k * 10.0 + r END::DOUBLE AS x, CASE WHEN r = 3 AND k = 5 THEN 'EUR' ELSE 'USD' END AS unit FROM v),
g AS (SELECT r, list(x ORDER BY k) AS n, list(label ORDER BY k) AS l, count(DISTINCT unit) > 1 AS mixed, count(*) > count(x) AS bad, max(x) AS top FROM f GROUP BY r)
"""


@query(AWKWARD_SQL + """, e AS (SELECT *, CASE WHEN mixed THEN 'units differ' WHEN bad THEN 'not a number' END AS err FROM g)
SELECT r, 'sum' AS plan, CASE WHEN err IS NULL THEN 0.0::DOUBLE + n[1] + n[2] + n[3] + n[4] + n[5] END AS num, NULL AS str, err FROM e
UNION ALL SELECT r, 'argmax', NULL, CASE WHEN err IS NULL AND len(list_filter(n, lambda x: x = top)) = 1 THEN l[list_position(n, top)] END, coalesce(err, CASE WHEN len(list_filter(n, lambda x: x = top)) > 1 THEN 'tie' END) FROM e
UNION ALL SELECT r, 'difference', n[1] - n[2], NULL, CASE WHEN n[1] IS NULL OR n[2] IS NULL THEN 'not a number' END FROM e
UNION ALL SELECT r, 'category_of', NULL, substr(l[1], 5), NULL FROM e
UNION ALL SELECT r, 'count', 5.0, NULL, NULL FROM e""")
def plan_awkward_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five operators where facts are texts, missing, tied, of several units or have a separator in their label."""
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), "n_name", k.alias("k"))
    r, k = F.col("r"), F.col("k")
    gone = ((r == 1) & (k == 3)) | ((r == 2) & (k == 2)) | ((r == 4) & (k == 2))
    num = F.when(~gone, F.when((r == 0) & (k >= 4), 50.0).otherwise(k * 10.0 + r))
    said = F.when((r == 1) & (k == 3), "n/a").when((r == 4) & (k == 2), " $1,200 ")
    fact = F.struct(k.alias("k"), F.struct(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.when(k == 1, F.concat(F.lit("S · "), F.col("n_name"))).otherwise(F.col("n_name")).alias("label"), num.alias("num"), said.alias("str"), F.when((r == 3) & (k == 5), "EUR").otherwise("USD").alias("unit")).alias("f"))
    charts = rows.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(fact)), lambda x: x["f"]).alias("facts"))
    every, two = [{"ref": f"f{i}"} for i in range(1, 6)], [{"ref": "f1"}, {"ref": "f2"}]
    plans = {"sum": op("sum", every), "argmax": op("argmax", every), "difference": op("difference", two), "category_of": op("category_of", [op("label_of", [{"ref": "f1"}])]), "count": op("count", every)}
    listed = F.array(*[F.struct(F.lit(name).alias("plan"), F.lit(json.dumps(plan)).alias("text")) for name, plan in plans.items()])
    asked = charts.select("r", "facts", F.explode(listed).alias("p")).withColumn("v", nodes.evaluate(nodes.read(F.col("p.text")), F.col("facts"), 2))
    return asked.select("r", "p.plan", "v.num", "v.str", "v.err")


#: Charts of five customers each; by its number a chart has tied values, a text, a gap, two units, a number written out, or one below and one at zero.
EVERY_SQL = """
WITH v AS (SELECT c_custkey // 5 AS c, c_custkey % 5 + 1 AS k, c_name FROM customer),
f AS (
  SELECT c, k, CASE WHEN k = 1 THEN 'S · ' || c_name ELSE c_name END AS label, CASE WHEN c % 6 = 3 AND k = 5 THEN 'EUR' ELSE 'USD' END AS unit,
    CASE WHEN c % 6 = 1 AND k = 3 THEN 'n/a' WHEN c % 6 = 4 AND k = 2 THEN ' $1,200 ' END AS said,
    CASE WHEN c % 6 = 1 AND k = 3 OR c % 6 = 2 AND k = 2 THEN NULL WHEN c % 6 = 4 AND k = 2 THEN 1200.0 WHEN c % 6 = 0 AND k >= 4 THEN 50.0 WHEN c % 6 = 5 AND k <= 2 THEN 5.0 * k - 10 ELSE k * 10.0 + c % 7 END::DOUBLE AS x FROM v),
g AS (
  SELECT c, list(x ORDER BY k) AS n, list(label ORDER BY k) AS l, list(said ORDER BY k) AS s, list_reverse_sort(list(x)) AS d,
    CASE WHEN count(DISTINCT unit) > 1 THEN 'units differ' WHEN count(*) > count(x) THEN 'not a number' END AS five,
    CASE WHEN count(*) > count(x) THEN 'not a number' END AS each
  FROM f GROUP BY c HAVING count(*) = 5),
e AS (SELECT *, CASE WHEN n[1] IS NULL OR n[2] IS NULL THEN 'not a number' END AS two FROM g)
"""


def _where(least: float) -> str:
    return f"list_filter(n, lambda x: x > {least})"


_ONE_TOP = "len(list_filter(n, lambda x: x = {0})) = 1"
#: For each plan: the number, the text and the error as SQL; a result that isn't one stays null where there is an error.
_EVERY: dict[str, tuple[str, str, str]] = {
    "lookup": ("CASE WHEN s[2] IS NULL THEN n[2] END", "s[2]", "NULL"),
    "label_of": ("NULL", "l[1]", "NULL"),
    "difference": ("n[1] - n[2]", "NULL", "two"),
    "absolute_difference": ("abs(n[1] - n[2])", "NULL", "two"),
    "ratio": ("n[1] / nullif(n[2], 0)", "NULL", "coalesce(two, CASE WHEN n[2] = 0 THEN 'division by zero' END)"),
    "percentage": ("n[1] * 100 / nullif(n[2], 0)", "NULL", "coalesce(two, CASE WHEN n[2] = 0 THEN 'division by zero' END)"),
    "percent_change": ("(n[1] - n[2]) * 100 / nullif(n[2], 0)", "NULL", "coalesce(two, CASE WHEN n[2] = 0 THEN 'division by zero' END)"),
    "sum": ("0.0::DOUBLE + n[1] + n[2] + n[3] + n[4] + n[5]", "NULL", "five"),
    "mean": ("(0.0::DOUBLE + n[1] + n[2] + n[3] + n[4] + n[5]) / 5", "NULL", "five"),
    "median": ("d[3]", "NULL", "five"),
    "min": ("d[5]", "NULL", "five"),
    "max": ("d[1]", "NULL", "five"),
    "argmin": ("NULL", "l[list_position(n, d[5])]", f"coalesce(five, CASE WHEN NOT {_ONE_TOP.format('d[5]')} THEN 'tie' END)"),
    "argmax": ("NULL", "l[list_position(n, d[1])]", f"coalesce(five, CASE WHEN NOT {_ONE_TOP.format('d[1]')} THEN 'tie' END)"),
    "count": ("5", "NULL", "NULL"),
    "trend": ("NULL", "CASE WHEN n[1] < n[2] AND n[2] < n[3] AND n[3] < n[4] AND n[4] < n[5] THEN 'increasing' ELSE 'mixed' END", "five"),
    "compare": ("NULL", "CASE WHEN n[1] > n[2] THEN 'greater' WHEN n[1] < n[2] THEN 'less' ELSE 'equal' END", "two"),
    "greater_than": ("NULL", "CASE WHEN n[1] > n[2] THEN 'Yes' ELSE 'No' END", "two"),
    "less_than": ("NULL", "CASE WHEN n[1] < n[2] THEN 'Yes' ELSE 'No' END", "two"),
    "equal_to": ("NULL", "CASE WHEN n[1] = n[2] THEN 'Yes' ELSE 'No' END", "two"),
    "rank": ("NULL", "l[list_position(n, d[2])]", f"coalesce(five, CASE WHEN NOT {_ONE_TOP.format('d[2]')} THEN 'tie' END)"),
    "rank_value": ("CASE WHEN s[list_position(n, d[1])] IS NULL THEN d[1] END", "s[list_position(n, d[1])]", "five"),
    "count_where": (f"len({_where(25)})", "NULL", "each"),
    "sum_where": (f"list_sum({_where(25)})", "NULL", "five"),
    "mean_where": (f"list_sum({_where(1000)})", "NULL", f"coalesce(five, CASE WHEN len({_where(1000)}) = 0 THEN 'nothing passes' END)"),
    "label_where": ("NULL", f"l[list_position(n, {_where(45)}[1])]", f"coalesce(five, CASE WHEN len({_where(45)}) <> 1 THEN 'not exactly one passes' END)"),
    "category_of": ("NULL", "substr(l[1], 5)", "NULL"),
    "meets_threshold": ("NULL", "CASE WHEN n[1] >= 12 THEN 'Yes' ELSE 'No' END", "NULL"),
    "unanswerable": ("NULL", "NULL", "NULL"),
}


@query(EVERY_SQL + " UNION ALL ".join(f"SELECT c, '{name}' AS plan, CASE WHEN {err} IS NULL THEN {num} END::DOUBLE AS num, CASE WHEN {err} IS NULL THEN {text} END::VARCHAR AS str, {err} AS err FROM e" for name, (num, text, err) in _EVERY.items()))
def plan_every_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators over charts whose facts are tied, texts, missing, of several units, written out, negative or zero."""
    c, k = F.floor(F.col("c_custkey") / 5), F.col("c_custkey") % 5 + 1
    rows = table(spark, sf_dir, "customer").select(c.alias("c"), k.alias("k"), "c_name")
    c, k = F.col("c") % 6, F.col("k")
    said = F.when((c == 1) & (k == 3), "n/a").when((c == 4) & (k == 2), " $1,200 ")
    num = F.when(said.isNull() & ~((c == 2) & (k == 2)), F.when((c == 0) & (k >= 4), 50.0).when((c == 5) & (k <= 2), 5.0 * k - 10).otherwise(k * 10.0 + F.col("c") % 7))
    label = F.when(k == 1, F.concat(F.lit("S · "), F.col("c_name"))).otherwise(F.col("c_name"))
    fact = F.struct(k.alias("k"), F.struct(F.concat(F.lit("f"), k.cast("string")).alias("id"), label.alias("label"), num.alias("num"), said.alias("str"), F.when((c == 3) & (k == 5), "EUR").otherwise("USD").alias("unit")).alias("f"))
    charts = rows.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(fact)), lambda x: x["f"]).alias("facts")).where(F.size("facts") == 5)
    refs = [{"ref": f"f{i}"} for i in range(1, 6)]
    extra = {"rank": {"position": 2, "order": "descending"}, "rank_value": {"position": 1, "order": "descending"}, "meets_threshold": {"compare": "greater_or_equal", "threshold": 12}}
    extra |= {name: {"compare": "greater", "threshold": least} for name, least in (("count_where", 25), ("sum_where", 25), ("mean_where", 1000), ("label_where", 45))}
    own = {"lookup": [refs[1]], "category_of": [op("label_of", refs[:1])]}
    spec = specs.SPECS
    plans = {name: op(name, own.get(name, refs[: spec[name].most]), **extra.get(name, {})) for name in spec}
    listed = F.array(*[F.struct(F.lit(name).alias("plan"), F.lit(json.dumps(plan)).alias("text")) for name, plan in plans.items()])
    asked = charts.select("c", "facts", F.explode(listed).alias("p")).withColumn("v", nodes.evaluate(nodes.read(F.col("p.text")), F.col("facts"), 2))
    return asked.select("c", "p.plan", "v.num", "v.str", "v.err")


# --- records, pictures, context


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'theirs' END AS from_table, quality AS element FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")
def attached_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their aligned elements; their own table wins if it has rows."""
    made = lambda who, full: F.struct(F.array(F.lit(who)).alias("columns"), F.when(full, F.array(F.array(F.lit("x")))).otherwise(F.array().cast("array<array<string>>")).alias("rows"))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), made("own", F.col("doc_id") % 3 == 0).alias("table"))
    aligned = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), F.array("quality").alias("elements"), made("theirs", F.lit(True)).alias("table"), "quality")
    out = keyed.attach_elements(records, aligned, "quality")
    return out.select(F.col("record_id").alias("doc_id"), F.get("table.columns", 0).alias("from_table"), F.get("elements", 0).alias("element"))


@query("""WITH p AS (SELECT p_partkey, (p_size % 5 + 1)::INT AS w, (p_partkey % 3 + 1)::INT AS h FROM part)
SELECT p_partkey, w AS image_width, h AS image_height, NULL::VARCHAR AS image_error, sha256(encode(w || 'x' || h || ':') || unhex(list_aggregate([printf('%02x', (p_partkey * 7 + i * i) % 256) FOR i IN range(3 * w * h)], 'string_agg', ''))) AS image_sha256 FROM p""")
def picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and pixel hashes of small pictures, written with the five line filters in turn."""
    def drawn(batches):
        for batch in batches:
            found = []
            for key, w, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rgb = np.array([(key * 7 + i * i) % 256 for i in range(3 * w * h)], np.uint8).reshape(h, -1)
                found.append(pictures.as_png(rgb, 2, key % 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["p_partkey", "content"])

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), (F.col("p_size") % 5 + 1).cast("int"), (F.col("p_partkey") % 3 + 1).cast("int"))
    return pictures.with_pixel_hash(p.mapInArrow(drawn, "p_partkey long, content binary"))


@query("""WITH h AS (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents WHERE doc_id % 4 <> 0 GROUP BY text)
SELECT doc_id, first AS found FROM documents LEFT JOIN h ON sha256(text) = h""")
def pictures_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the first annotated record of the same content that has elements."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("image_sha256"))
    annotated = d.select("image_sha256", F.col("doc_id").alias("source_row_index"), F.when(F.col("doc_id") % 4 != 0, F.array("doc_id")).otherwise(F.array().cast("array<long>")).alias("elements"), F.lit(None).cast("string").alias("table"))
    return align.image_join(d, annotated).select("doc_id", F.get("image_elements", 0).alias("found"))


@query("""WITH e AS (SELECT l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey % 5 AS x FROM lineitem),
m AS (SELECT r, x FROM e WHERE i = 1)
SELECT e.r AS record_id, e.i AS element_index FROM e JOIN m USING (r) WHERE e.i > 1 AND e.x <> m.x AND e.i % 4 <> 0""")
def context_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that no marked box takes, with a label."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), i.alias("element_index"), F.array((F.col("l_partkey") % 5).cast("double")).alias("bbox")).withColumn("label", F.when(F.col("element_index") % 4 == 0, " ").otherwise("a"))
    aligned = e.where("element_index = 1").select("record_id", F.array("element_index").alias("evidence"))
    return align.context_elements(e, aligned).select("record_id", "element_index")


@query("""SELECT n_regionkey, string_agg(CASE WHEN k % 2 = 0 THEN 'own' || k ELSE 'f' || k END, ',' ORDER BY k) AS ids, 'f1,f3' AS marked
FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) GROUP BY n_regionkey""")
def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of facts by their places, and those that a question marks."""
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    rows = table(spark, sf_dir, "nation").select("n_regionkey", k.alias("k"))
    listed = rows.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.struct(F.when(k % 2 == 0, F.concat(F.lit("own"), k.cast("string"))).alias("id"), k.alias("k"))).alias("facts"))
    return listed.select("n_regionkey", F.array_join(F.transform(facts.with_ids(F.col("facts")), lambda f: f["id"]), ",").alias("ids"), F.array_join(facts.marked_ids(F.array(F.lit(0), F.lit(2))), ",").alias("marked"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS delta FROM orders""")
def adjacent_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of neighbours in listed order."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("value"))
    return facts.first_numeric_window(rows, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "delta")


@query("""WITH d AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) % 3 AS m FROM nation)
SELECT n_regionkey, count(*) AS n, count(*) - count(DISTINCT m) AS repeats, count(DISTINCT m) < count(*) AS repeated FROM d GROUP BY n_regionkey""")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that stand twice in a record."""
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")) % 3
    rows = table(spark, sf_dir, "nation").select("n_regionkey", k.alias("m")).groupBy("n_regionkey").agg(F.collect_list("m").alias("ids"))
    extra = F.size("ids") - F.size(F.array_distinct("ids"))
    return rows.select("n_regionkey", F.size("ids").cast("long").alias("n"), extra.cast("long").alias("repeats"), (extra > 0).alias("repeated"))


@query("""SELECT (row_number() OVER (ORDER BY lang, doc_id) - 1)::BIGINT AS place, lang, doc_id FROM documents""")
def pool_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the order of key and id, numbered."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return keyed.numbered(rows.withColumn("_order", F.struct("lang", "doc_id")), "_order").select(F.col("_place").alias("place"), "lang", "doc_id")


# --- mixtures


@query("""SELECT p_partkey, ['vbar', 'line', 'pie', NULL][(p_partkey % 6)::INT - 1] AS chart_type, p_size IN (7, 13, 23) OR p_partkey >= 900000 AS held FROM part WHERE p_partkey % 6 NOT IN (0, 1)""")
def absent_types_held_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart types that mixtures leave out, unknown ones kept; examples of held-out styles."""
    kinds = F.array(*[F.lit(x) for x in ("area", "scatter", "vbar", "line", "pie", None)])
    rows = table(spark, sf_dir, "part").withColumn("chart_type", F.get(kinds, (F.col("p_partkey") % 6).cast("int")))
    return mixture.without_absent_types(rows).select("p_partkey", "chart_type", mixture.is_holdout(F.col("p_size"), F.col("p_partkey")).alias("held"))


@query("""SELECT p_partkey AS seq, level FROM (SELECT p_partkey, 'L' || (p_size % 4 + 1) AS level, 0 AS part FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, 1 FROM part WHERE p_partkey % 2 = 1 AND p_size % 3 > 0) ORDER BY part, level NULLS LAST, p_partkey LIMIT 150""")
def curriculum_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic rows by level, then real ones with boxes, up to a cap."""
    rows = table(spark, sf_dir, "part")
    boxes = F.array_repeat(F.lit(1), (F.col("p_size") % 3).cast("int"))
    synthetic = rows.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("L"), (F.col("p_size") % 4 + 1).cast("string")).alias("level"), boxes.alias("boxes"))
    real = rows.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("seq"), F.lit(None).cast("string").alias("level"), boxes.alias("boxes"))
    return mixture.curriculum(synthetic, real, 150).select("seq", "level")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('4|' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 12""")
def sample_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twelve documents of each source."""
    return mixture.sample_per_kind(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 12, 4, "doc_id")


@query("SELECT doc_id FROM documents WHERE length(text) <= 400 AND doc_id % 10 <> 3")
def length_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of at most 400 characters, counted in batches; one that can't be counted is left out, not its batch."""
    def count(texts: list) -> list[int]:
        if any(t.startswith("\u0000") for t in texts):
            raise ValueError("can't be counted")
        return [len(t) for t in texts]

    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("\u0000"), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return mixture.within_length(rows, "text", count, 400).select("doc_id")


# --- metrics


@query("""WITH l AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey, l_quantity FROM lineitem),
q AS (SELECT DISTINCT image, CASE WHEN image % 3 = 0 THEN 'human' ELSE 'machine' END AS kind FROM l),
d AS (SELECT image, i, l_partkey % 100 / 100.0 AS score, l_quantity >= 34 AS near FROM l WHERE i > 1),
h AS (SELECT *, near AND row_number() OVER (PARTITION BY image, near ORDER BY score DESC, i) = 1 AS hit FROM d),
a AS (SELECT h.*, kind FROM h JOIN q USING (image)),
g AS (SELECT kind, count(*)::DOUBLE AS truths FROM q GROUP BY kind UNION ALL SELECT NULL, count(*) FROM q),
x AS (SELECT g.kind, truths, score, hit, row_number() OVER (PARTITION BY g.kind ORDER BY score DESC, image, i) AS place, sum(hit::INT) OVER (PARTITION BY g.kind ORDER BY score DESC, image, i) AS tp FROM g JOIN a ON g.kind IS NULL OR g.kind = a.kind),
p AS (SELECT g.kind, level, coalesce(max(tp::DOUBLE / place), 0.0) AS best FROM g CROSS JOIN (SELECT range AS level FROM range(101)) LEFT JOIN x ON x.kind IS NOT DISTINCT FROM g.kind AND floor(tp / x.truths * 100 + 1e-9) >= level GROUP BY ALL),
s AS (SELECT kind, count(*) AS n, avg((image % 5 > 0)::INT) AS accuracy FROM q GROUP BY kind UNION ALL SELECT NULL, count(*), avg((image % 5 > 0)::INT) FROM q)
SELECT s.kind, s.n, s.accuracy, round(ap, 9) AS ap FROM s JOIN (SELECT kind, avg(best) AS ap FROM p GROUP BY kind) t ON t.kind IS NOT DISTINCT FROM s.kind""")
def grounding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and average precision of detections, matched with each picture's box, overall and by kind."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), i.alias("seq"), "l_partkey", "l_quantity")  # noqa: E741
    square = F.array(*[F.lit(float(x)) for x in (0, 0, 50, 50)])
    # a box as long as the quantity says overlaps the square by half from 25.5 on: 34 of 50 is safely more
    found = l.where("seq > 1").select("image", F.col("seq").cast("long").alias("seq"), (F.col("l_partkey") % 100 / 100.0).alias("score"), F.array(F.lit(0.0), F.lit(0.0), F.lit(50.0), F.when(F.col("l_quantity") >= 34, F.col("l_quantity")).otherwise(10.0).cast("double")).alias("bbox"))
    answers = l.select("image").distinct().withColumn("kind", F.when(F.col("image") % 3 == 0, "human").otherwise("machine"))
    truths = answers.select("image", F.lit(1).alias("seq"), square.alias("bbox"))
    report = metrics.grounding_report(answers, found, truths, F.col("image") % 5 > 0)
    return report.select("kind", "n", "accuracy", F.round("ap", 9).alias("ap"))


@query("SELECT count(*) AS metric_n, avg((o_orderkey % 3 = 0)::INT) AS answer_accuracy, avg((o_totalprice > 100000)::INT) AS schema_valid, avg((o_custkey % 2 = 0)::INT) AS round_trip, NULL::VARCHAR AS stopped_early FROM orders")
def budget_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics summed up slice by slice, with time enough."""
    return budget.metrics_within(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") > 100000, F.col("o_custkey") % 2 == 0, 3600, 8)


@query("""SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem""")
def weighted_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean loss of chunks by their size."""
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("loss"), F.col("l_quantity").alias("n"))
    return metrics.weighted_loss(chunks).select(F.round("loss", 6).alias("loss"))


@query("""WITH e AS (SELECT event_id % 4 > 0 AS right_, event_id % 5 > 0 AS valid, ['agrees', 'no_plan', 'raises'][(event_id % 3 + 1)::INT] AS trip FROM events)
SELECT avg(right_::INT) AS answer_accuracy, avg(valid::INT) AS schema_valid, count_if(trip = 'agrees') / count_if(trip <> 'no_plan') AS round_trip, 0.25::DOUBLE AS ap, (avg(right_::INT) + 0.25) / 2 AS selection FROM e""")
def checkpoint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What checkpoints are chosen by."""
    i = F.col("event_id")
    trip = F.get(F.array(*[F.lit(x) for x in ("agrees", "no_plan", "raises")]), (i % 3).cast("int"))
    return metrics.training_metrics(table(spark, sf_dir, "events"), i % 4 > 0, i % 5 > 0, trip, 0.25)


# --- streams


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_total_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total counts, replaced as a whole by each batch; a second run changes nothing."""
    from .streaming import incremental

    schema = table(spark, sf_dir, "events").schema
    out, state = _folders(spark, "totals")
    for _ in range(2):
        incremental.counts_once(incremental.stream(spark, f"{sf_dir}/events.parquet", schema), ["event_type"], out, state)
    return spark.read.parquet(out)
