"""What users put beside the defaults: prices, model entries and sources of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import costs
from tracemill.plans import load_queries
from tracemill.plans import queries as base
from tracemill.sources import adapters, bindings, scratch

#: A price that replaces a default one, one for models without any, and one that is more exact than a family's.
OWN_PRICES = [("north-large", "10.0", "50.0", "1.0", "12.5"), ("unlisted", "1.0", "2.0", "0.1", "0.5"), ("north-small-20240101", "0.5", "2.5", "0.05", "0.6")]
OWN_MODELS = [("north-large", 4, 4), ("unlisted-1", 1, 2), ("delta", 2, 2)]
#: Two sources over the same files, by the projects that each leaves out.
SOURCES = {"a": (1,), "b": (2, 3)}


def override_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs by model where a user's prices stand beside the defaults: exact before family, longer before shorter, own before default."""
    prices = costs.price_list(spark).unionByName(costs.price_list(spark, OWN_PRICES, "override"))
    return costs.cost_by_model(bindings.model_requests(spark, d), prices).withColumn("usd", F.round(F.col("usd").cast("double"), 4))


def override_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of the models that were used, by a user's catalogue beside the default one."""
    entries = costs.catalogue(spark).unionByName(costs.catalogue(spark, OWN_MODELS, "override"))
    return costs.tiers(bindings.model_requests(spark, d), entries)


def adapter_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files and diagnostics of two sources over one folder, each with a store of its own."""
    root = load_queries.store(spark, d)[0]
    options = {"layout": load_queries.LAYOUT, "glob": load_queries.GLOB}
    sources = [(adapters.Transcripts(id=name, excluded=tuple(f"/home/u/p{p}" for p in out), options=options), root) for name, out in SOURCES.items()]
    done = adapters.scan_all(spark, sources, scratch.fresh_path(spark, "stores"))
    return done.groupBy("source_id", "action").agg(F.count(F.lit(1)).alias("files"), F.sum("diagnostics").cast("long").alias("diagnostics"))


QUERIES = {"override_costs": override_costs, "override_tiers": override_tiers, "adapter_scan": adapter_scan}

_OWN = ", ".join(f"('{f}', {a}::DECIMAL(10,4), {b}::DECIMAL(10,4), {c}::DECIMAL(10,4), {e}::DECIMAL(10,4))" for f, a, b, c, e in [*OWN_PRICES, *(p for p in costs.DEFAULT_PRICES if p[0] != "north-large")])
ORACLE_SQL = {
    "override_costs": base.BY_MODEL.replace(base.PRICES, f"prices(family, p_in, p_out, p_cr, p_cw) AS (VALUES {_OWN})") + " SELECT * REPLACE (round(usd::DOUBLE, 4) AS usd) FROM by_model",
    "override_tiers": f"""{base.REQUESTS} SELECT DISTINCT model_id, CASE WHEN model_id = 'unlisted-1' THEN 1 WHEN starts_with(model_id, 'north-large') THEN 4 WHEN starts_with(model_id, 'north-small') THEN 2 WHEN starts_with(model_id, 'delta-mid') THEN 3 ELSE 0 END AS capability,
  CASE WHEN model_id = 'unlisted-1' THEN 2 WHEN starts_with(model_id, 'north-large') THEN 4 WHEN starts_with(model_id, 'north-small') THEN 1 WHEN starts_with(model_id, 'delta-mid') THEN 3 ELSE 0 END AS cost_tier FROM model_requests""",
    "adapter_scan": """WITH c AS (SELECT conv_id, conv_id % 5 AS project, count(*) FILTER (turn = 0 AND conv_id % 9 < 4) + count(*) FILTER (turn = 0 AND conv_id % 8 = 0) AS notes FROM conversations GROUP BY 1),
  s AS (SELECT 'a' AS source_id, notes FROM c WHERE project <> 1 UNION ALL SELECT 'b', notes FROM c WHERE project NOT IN (2, 3)) SELECT source_id, 'import' AS action, count(*) AS files, CAST(sum(notes) AS BIGINT) AS diagnostics FROM s GROUP BY 1""",
}
