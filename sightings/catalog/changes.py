"""Change handling: snapshots of suppliers as datasets, and events as a stream of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightings.catalog.registry import query
from sightings.session import scratch_path
from sightings.sources.driver import table
from sightings.streaming import changes

NOW = "2024-01-03 00:00:00"

# Old and new snapshot of the datasets; both statements run on Spark and DuckDB.
_OLD = (
    "SELECT concat('ds-', CAST(s_suppkey AS STRING)) AS key, concat('org-', CAST(s_suppkey % 10 AS STRING)) AS publishingorgkey,"
    " CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('p', CAST(s_suppkey % 3 AS STRING)) END AS projectid, s_name AS title,"
    " concat('n', CAST(s_suppkey % 4 AS STRING)) AS network1, concat('n', CAST(4 + s_suppkey % 6 AS STRING)) AS network2,"
    " concat('inst-', CAST(s_suppkey % 4 AS STRING)) AS installationkey,"
    " CASE WHEN s_suppkey % 3 = 0 THEN 'CC0_1_0' ELSE 'CC_BY_4_0' END AS license, s_suppkey % 6 AS age,"
    " CASE WHEN s_suppkey % 8 = 0 THEN 'FEED' ELSE 'DWC_ARCHIVE' END AS endpoint, s_suppkey AS n FROM supplier WHERE s_suppkey % 23 <> 1"
)
_NEW = (
    "SELECT concat('ds-', CAST(s_suppkey AS STRING)) AS key,"
    " concat('org-', CAST(CASE WHEN s_suppkey % 11 = 0 THEN 77 ELSE s_suppkey % 10 END AS STRING)) AS publishingorgkey,"
    " CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 2 = 0 THEN NULL ELSE concat('p', CAST(s_suppkey % 3 AS STRING)) END AS projectid,"
    " CASE WHEN s_suppkey % 13 = 0 THEN 'Renamed' ELSE s_name END AS title,"
    " concat('n', CAST(4 + s_suppkey % 6 AS STRING)) AS network1, concat('n', CAST(CASE WHEN s_suppkey % 17 = 0 THEN 99 ELSE s_suppkey % 4 END AS STRING)) AS network2,"
    " concat('inst-', CAST(s_suppkey % 4 AS STRING)) AS installationkey,"
    " CASE WHEN s_suppkey % 5 = 0 THEN 'CC_BY_NC_4_0' WHEN s_suppkey % 3 = 0 THEN 'CC0_1_0' ELSE 'CC_BY_4_0' END AS license, s_suppkey % 6 AS age,"
    " CASE WHEN s_suppkey % 8 = 0 THEN 'FEED' ELSE 'DWC_ARCHIVE' END AS endpoint, s_suppkey AS n FROM supplier WHERE s_suppkey % 19 <> 2"
)


def _snapshot(spark, sf_dir, sql: str):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    rows = spark.sql(sql)
    # created: a few minutes before "now", so that some datasets are too new to count
    return rows.select(
        "key", "publishingorgkey", "projectid", "title", F.array("network1", "network2").alias("networkkeys"),
        F.array(F.lit("c")).alias("category"), "installationkey", "license",
        F.expr(f"TIMESTAMP '{NOW}' - make_interval(0, 0, 0, 0, 0, age, 30)").alias("created"), F.array("endpoint").alias("endpoints"), "n")


def _dataset_changes(spark, sf_dir):
    return changes.snapshot_changes(_snapshot(spark, sf_dir, _OLD), _snapshot(spark, sf_dir, _NEW))


def _at():
    return F.lit(NOW).cast("timestamp")


_PAIRS = f"WITH o AS ({_OLD}), w AS ({_NEW}), pair AS (SELECT coalesce(o.key, w.key) AS key, o, w, o.key IS NULL AS created, w.key IS NULL AS deleted FROM o FULL JOIN w ON o.key = w.key),"
# a licence change counts when the dataset is older than three minutes: age is minutes plus half a minute
_CHANGED = ("(o.publishingorgkey IS DISTINCT FROM w.publishingorgkey OR o.projectid IS DISTINCT FROM w.projectid OR o.title IS DISTINCT FROM w.title"
            " OR list_sort([o.network1, o.network2]) <> list_sort([w.network1, w.network2]) OR (o.license <> w.license AND o.age >= 3))")
_KINDS = _PAIRS + (f" kind AS (SELECT *, CASE WHEN created THEN 'CREATED' WHEN deleted THEN 'DELETED' ELSE 'UPDATED' END AS changetype,"
                   f" coalesce(NOT created AND NOT deleted AND {_CHANGED}, false) AS changed FROM pair)")


@query("CHG1", _KINDS + " SELECT key, changetype, changed FROM kind")
def changed_datasets(spark, sf_dir):
    rows = _dataset_changes(spark, sf_dir)
    changed = (F.col("changetype") == "UPDATED") & changes.dataset_requires_update("old", "new", _at())
    return rows.select("key", "changetype", changed.alias("changed"))


@query("CHG2", _KINDS + " SELECT key, o.license <> w.license AND o.age >= 3 AS licensechanged FROM kind WHERE changetype = 'UPDATED'")
def changed_licenses(spark, sf_dir):
    rows = _dataset_changes(spark, sf_dir).filter("changetype = 'UPDATED'")
    return rows.select("key", changes.license_changed("old", "new", _at()).alias("licensechanged"))


def _organisations(spark, sf_dir, new: bool):
    """One organisation per nation; some change country or title, some are endorsed only now."""
    n = F.col("n_nationkey")
    country = F.when((n % 4 == 0) & F.lit(new), F.lit("XX")).otherwise(F.col("n_name"))
    title = F.when((n % 5 == 0) & F.lit(new), F.concat("n_name", F.lit(" Society"))).otherwise(F.col("n_name"))
    endorsed = F.when(n % 3 == 0, F.lit(False)).when(n % 3 == 1, F.lit(new)).otherwise(F.lit(True))
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("org-"), n.cast("string")).alias("key"), country.alias("country"), title.alias("title"), endorsed.alias("endorsed"))


def _organisation_changes(spark, sf_dir):
    return changes.snapshot_changes(_organisations(spark, sf_dir, False), _organisations(spark, sf_dir, True))


_ORG_ACTION = "CASE WHEN n_nationkey % 3 = 1 THEN 'CRAWL' WHEN n_nationkey % 3 = 2 AND (n_nationkey % 4 = 0 OR n_nationkey % 5 = 0) THEN 'METADATA+LOCATION' END"


@query("CHG3", f"WITH a AS (SELECT 'org-' || CAST(n_nationkey AS VARCHAR) AS orgkey, {_ORG_ACTION} AS action FROM nation)"
               " SELECT 'ds-' || CAST(s_suppkey AS VARCHAR) AS datasetkey, orgkey, action FROM supplier JOIN a ON orgkey = 'org-' || CAST(s_suppkey % 10 AS VARCHAR) WHERE action IS NOT NULL")
def changed_organisations(spark, sf_dir):
    """Organisation changes and the datasets they concern."""
    acting = _organisation_changes(spark, sf_dir).select(F.col("key").alias("orgkey"), changes.organisation_action().alias("action")).filter("action IS NOT NULL")
    datasets = table(spark, sf_dir, "supplier").select(F.concat(F.lit("ds-"), F.col("s_suppkey").cast("string")).alias("datasetkey"),
                                                       F.concat(F.lit("org-"), (F.col("s_suppkey") % 10).cast("string")).alias("orgkey"))
    return datasets.join(acting, "orgkey").select("datasetkey", "orgkey", "action")


@query("CHG4", "SELECT 'inst-' || CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 9 = 0 THEN 'METADATA' ELSE 'none' END AS action FROM supplier")
def changed_installations(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("inst-"), F.col("s_suppkey").cast("string")).alias("key")
    old = suppliers.select(key, F.lit("org-1").alias("organizationkey"))
    new = suppliers.select(key, F.when(F.col("s_suppkey") % 9 == 0, "org-2").otherwise("org-1").alias("organizationkey"))
    rows = changes.snapshot_changes(old, new)
    return rows.select("key", F.coalesce(changes.installation_action(), F.lit("none")).alias("action"))


@query("CHG5", f"WITH o AS ({_OLD}) SELECT key, network1 AS networkkey FROM o WHERE network1 IN ('n2', 'n5') UNION ALL SELECT key, network2 FROM o WHERE network2 IN ('n2', 'n5')")
def datasets_of_deleted_networks(spark, sf_dir):
    datasets = _snapshot(spark, sf_dir, _OLD)
    deleted = datasets.select(F.explode("networkkeys").alias("networkkey")).distinct().filter("networkkey IN ('n2', 'n5')")
    return changes.network_datasets(datasets, deleted)


_WINDOW_SECONDS = 40_000


@query("CHG6", "WITH RECURSIVE m AS (SELECT user_id, ts FROM events WHERE event_type <> 'error'), passed AS ("
               "SELECT user_id, min(ts) AS ts FROM m GROUP BY 1 UNION ALL SELECT * FROM (SELECT p.user_id, (SELECT min(ts) FROM m WHERE m.user_id = p.user_id"
               f" AND m.ts >= p.ts + INTERVAL {_WINDOW_SECONDS} SECOND) AS ts FROM passed p) WHERE ts IS NOT NULL)"
               " SELECT 'ds-' || CAST(user_id AS VARCHAR) AS datasetkey, CAST(epoch_us(ts) AS BIGINT) AS micros FROM passed")
def messages_passed_on(spark, sf_dir):
    """Messages of a file stream in four parts; a dataset passes once per window."""
    messages = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ds-"), F.col("user_id").cast("string")).alias("datasetkey"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", F.array(F.lit("FEED"))).otherwise(F.array(F.lit("EML"))).alias("endpoints"))
    folder = scratch_path(spark, "messages")
    bounds = messages.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    step = (bounds.high - bounds.low) / 4
    for part in range(4):  # files arrive one after the other
        after, before = bounds.low + step * part, bounds.low + step * (part + 1)
        upper = F.lit(True) if part == 3 else F.col("ts") < F.lit(before)
        messages.filter((F.col("ts") >= F.lit(after)) & upper).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    kept = changes.passed_messages(stream.filter(changes.crawlable(F.col("endpoints"))), "datasetkey", "ts", _WINDOW_SECONDS)
    return kept.select("datasetkey", F.unix_micros("ts").alias("micros"))


@query("CHG7", _KINDS + " SELECT key, 'Dataset [' || key || ']: Publishing Organization [' || o.publishingorgkey || '] -> [' || w.publishingorgkey || '], License ['"
                        " || o.license || '] -> [' || w.license || ']' AS message FROM kind WHERE changed")
def change_messages(spark, sf_dir):
    rows = _dataset_changes(spark, sf_dir).filter("changetype = 'UPDATED'")
    message = changes.update_message(changes.dataset_requires_update("old", "new", _at()))
    return rows.select("key", message.alias("message")).filter("message IS NOT NULL")


@query("CHG8", _KINDS + " SELECT key, CASE WHEN changetype = 'DELETED' THEN 'DELETE' WHEN n % 8 = 0 THEN '' WHEN changetype = 'CREATED' THEN 'CRAWL'"
                        " WHEN changed THEN 'CRAWL;METADATA' ELSE 'CRAWL' END AS actions FROM (SELECT *, coalesce(w.n, o.n) AS n FROM kind)")
def routed_actions(spark, sf_dir):
    """Change rows as a stream; each micro-batch is written as a table of actions."""
    folder = scratch_path(spark, "changes")
    rows = _dataset_changes(spark, sf_dir)
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    actions = stream.select("key", F.array_join(changes.dataset_actions(_at()), ";").alias("actions"))
    path = scratch_path(spark, "actions")
    changes.run_to_table(actions, path, scratch_path(spark, "actions-state"))
    return spark.read.schema(actions.schema).parquet(f"{path}/batch=*")
