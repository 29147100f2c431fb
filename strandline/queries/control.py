"""Control-table decisions. Orders are streams, customers are running pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schemas
from strandline.control import decisions
from strandline.queries import query, table

ENTRIES = """WITH entries AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS pipeline_id,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'error' END AS target_state, o_orderkey % 5 AS stored_hash, o_orderkey % 3 AS hash,
  CASE WHEN o_orderkey % 3 = 0 THEN 'file:///a/' ELSE 'rtsp://h/' END || CAST(o_orderkey AS VARCHAR) AS input_uri, CASE WHEN o_orderkey % 2 = 0 THEN 'rtmp://out/' || CAST(o_orderkey AS VARCHAR) END AS output_uri,
  ['detect', o_orderpriority] AS frame_path, ['never', 'always', 'on_error', 'on_eos'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS restart_policy FROM orders),
  managers AS (SELECT CAST(c_custkey AS VARCHAR) AS pipeline_id FROM customer WHERE c_custkey % 3 <> 0)"""


def choice(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("error")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.when(c % 4 != 0, c.cast("string")).alias("pipeline_id"), state.alias("target_state"), (k % 5).alias("stored_hash"), (k % 3).alias("hash"),
        F.concat(F.when(k % 3 == 0, "file:///a/").otherwise("rtsp://h/"), k.cast("string")).alias("input_uri"), F.when(k % 2 == 0, F.concat(F.lit("rtmp://out/"), k.cast("string"))).alias("output_uri"),
        F.array(F.lit("detect"), "o_orderpriority").alias("frame_path"), choice(schemas.POLICIES, k % 4).alias("restart_policy"))


def managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("pipeline_id"))


@query("""SELECT event_id, p AS policy, r AS reason, CASE p WHEN 'never' THEN CASE r WHEN 'completed' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END WHEN 'always' THEN 'running'
  WHEN 'on_error' THEN CASE r WHEN 'error' THEN 'running' ELSE 'error' END ELSE CASE r WHEN 'completed' THEN 'running' ELSE 'completed' END END AS next_state
  FROM (SELECT event_id, ['never', 'always', 'on_error', 'on_eos'][CAST(event_id % 4 AS INTEGER) + 1] AS p, ['completed', 'error', 'updated'][CAST(event_id % 3 AS INTEGER) + 1] AS r FROM events)""")
def restart_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", choice(schemas.POLICIES, F.col("event_id") % 4).alias("policy"), choice(schemas.REASONS, F.col("event_id") % 3).alias("reason"))
    return rows.withColumn("next_state", decisions.next_state(F.col("policy"), F.col("reason")))


@query(f"""{ENTRIES} SELECT 'restart' AS action, id, pipeline_id FROM entries WHERE stored_hash <> hash AND pipeline_id IN (SELECT pipeline_id FROM managers)
  UNION ALL SELECT 'create', id, pipeline_id FROM entries WHERE pipeline_id IS NULL AND target_state = 'running'
  UNION ALL SELECT 'stop', NULL, pipeline_id FROM managers WHERE pipeline_id NOT IN (SELECT pipeline_id FROM entries WHERE pipeline_id IS NOT NULL)""")
def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.reconcile(entries(spark, sf_dir), managers(spark, sf_dir))


@query(f"{ENTRIES} SELECT pipeline_id FROM managers WHERE pipeline_id NOT IN (SELECT pipeline_id FROM entries WHERE pipeline_id IS NOT NULL)")
def reconcile_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.orphans(managers(spark, sf_dir), entries(spark, sf_dir))


@query(f"{ENTRIES} SELECT id, input_uri FROM entries WHERE pipeline_id IS NULL AND target_state = 'running'")
def reconcile_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.to_create(entries(spark, sf_dir)).select("id", "input_uri")


@query(f"""{ENTRIES}, r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'rtsp://new/' || CAST(o_orderkey AS VARCHAR) END AS i, CASE WHEN o_orderkey % 3 = 0 THEN ['draw'] ELSE [] END AS p,
  CASE WHEN o_orderkey % 7 = 0 THEN 'always' END AS rp FROM orders WHERE o_orderkey % 4 = 0)
  SELECT e.id, coalesce(i, input_uri) AS input_uri, output_uri, array_to_string(CASE WHEN len(p) > 0 THEN p ELSE frame_path END, '/') AS path, coalesce(rp, restart_policy) AS restart_policy FROM entries e LEFT JOIN r USING (id)""")
def stream_update_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").where(k % 4 == 0).select(
        k.cast("string").alias("id"), F.when(k % 2 == 0, F.concat(F.lit("rtsp://new/"), k.cast("string"))).alias("input_uri"), F.lit(None).cast("string").alias("output_uri"),
        F.when(k % 3 == 0, F.array(F.lit("draw"))).otherwise(F.array().cast("array<string>")).alias("frame_path"), F.when(k % 7 == 0, "always").alias("restart_policy"))
    return decisions.updated(entries(spark, sf_dir), requests).select("id", "input_uri", "output_uri", F.array_join("frame_path", "/").alias("path"), "restart_policy")


@query(f"{ENTRIES} SELECT id, input_uri FROM entries WHERE CAST(id AS BIGINT) % 6 <> 0")
def stream_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").cast("string").alias("id"))
    return decisions.removed(entries(spark, sf_dir), gone).select("id", "input_uri")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 400 ELSE 200 END AS status FROM orders""")
def stream_add_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 != 0, "rtsp://h/p").alias("input_uri"), F.when(k % 7 != 0, F.array(F.lit("detect"))).alias("frame_path"))
    return decisions.add_errors(rows).select("o_orderkey", "status")


@query(f"""{ENTRIES} SELECT id, CASE WHEN input_uri LIKE 'file://%' THEN 'never' ELSE restart_policy END AS policy,
  md5('{{"i":"' || input_uri || '"' || coalesce(',"o":"' || output_uri || '"', '') || ',"p":["' || array_to_string(frame_path, '","') || '"],"r":"' || restart_policy || '"}}') AS entry_hash FROM entries""")
def policy_file_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return entries(spark, sf_dir).select("id", decisions.effective_policy(c("restart_policy"), c("input_uri"), c("output_uri")).alias("policy"), decisions.entry_hash(c("input_uri"), c("output_uri"), c("frame_path"), c("restart_policy")).alias("entry_hash"))


@query(f"{ENTRIES} SELECT pipeline_id, count(*) AS entries FROM entries WHERE pipeline_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def pipeline_assigned_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.taken(entries(spark, sf_dir))


@query(f"""{ENTRIES} SELECT id, '{{"type":"StreamFinished","end_state":"' || target_state || '","stream_uuid":"' || coalesce(pipeline_id, '00000000-0000-0000-0000-000000000000') || '"}}' AS event,
  '{{"type":"StreamStartError","stream_uuid":"' || id || '"}}' AS start_error FROM entries""")
def finished_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", decisions.finished_event(F.col("target_state"), F.col("pipeline_id")).alias("event"), decisions.start_error_event(F.col("id")).alias("start_error"))


@query(f"""{ENTRIES} SELECT id, to_json({{'id': id, 'input_uri': input_uri, 'target_state': target_state, 'restart_policy': restart_policy}}) AS json, array_to_string(frame_path, ' -> ') AS shown FROM entries""")
def list_streams_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", F.to_json(F.struct("id", "input_uri", "target_state", "restart_policy")).alias("json"), F.array_join("frame_path", " -> ").alias("shown"))


@query("""SELECT o_orderkey, r_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O'""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups of small registries: Spark broadcasts the sides that its size limit allows."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").where("o_orderstatus = 'O'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "r_name", "n_name")
