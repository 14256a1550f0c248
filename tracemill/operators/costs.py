"""Prices and costs of model requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: USD for a million tokens: (model or family, input, output, cache read, cache write).
DEFAULT_PRICES = [("north-large", "15.0", "75.0", "1.5", "18.75"), ("north-small", "0.8", "4.0", "0.08", "1.0"), ("north", "3.0", "15.0", "0.3", "3.75"), ("delta-mid", "3.0", "15.0", "0.3", "3.75")]
PRICE = "decimal(10,4)"
RATES = ("input", "output", "cache_read", "cache_write")
#: Most rows of a price list; it is broadcast.
MOST_PRICES = 10_000


def price_list(spark: SparkSession, rows: list[tuple] = DEFAULT_PRICES, source: str = "default") -> DataFrame:
    if len(rows) > MOST_PRICES:
        raise ValueError(f"a price list has at most {MOST_PRICES} rows")
    df = spark.createDataFrame(rows, "family string, input string, output string, cache_read string, cache_write string")
    return df.select("family", *(F.col(r).cast(PRICE).alias(r) for r in RATES), F.lit(source).alias("price_source"))


def _bounded(entries: DataFrame) -> DataFrame:
    """entries, to be broadcast: a union of lists may have more rows than each."""
    if entries.limit(MOST_PRICES + 1).count() > MOST_PRICES:
        raise ValueError(f"a list of prices or models has at most {MOST_PRICES} rows")
    return F.broadcast(entries)


def resolve_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Price of each distinct model_id: an exact entry, else the longest family that its id begins with; overrides win where equal.

    Models are made distinct before they meet the (bounded) list, so requests are
    joined by equality only.
    """
    return _priced(models.select("model_id").distinct(), prices)


def _priced(models: DataFrame, prices: DataFrame) -> DataFrame:
    """models, a row for each model_id, with the price that resolve_prices() names."""
    fits = F.col("model_id").startswith(F.col("family"))
    best = F.struct((F.col("model_id") == F.col("family")).alias("exact"), F.length("family").alias("len"), (F.col("price_source") == "override").alias("own"))
    met = models.join(_bounded(prices), fits, "left")
    others = [c for c in models.columns if c != "model_id"]
    found = met.groupBy("model_id").agg(F.max_by(F.struct("family", *RATES, "price_source"), best).alias("p"), *(F.first(c).alias(c) for c in others))
    return found.select("model_id", *others, "p.*")


def _said_micro(requests: DataFrame) -> Column:
    """What a request states as its own cost, in millionths of USD; null where that is no number."""
    if "reported_usd" not in requests.columns:
        return F.lit(None).cast("decimal(38,4)")
    finite = F.col("reported_usd").isNotNull() & ~F.isnan("reported_usd") & (F.abs("reported_usd") < float("inf"))
    return F.when(finite, (F.col("reported_usd").cast("decimal(20,6)") * 1_000_000).cast("decimal(38,4)"))


def with_cost(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """requests with cost_micro (decimal) and cost_provenance: reported_usd where a request states a number, else tokens x USD for a million, null without a price."""
    priced = requests.join(F.broadcast(resolve_prices(requests, prices)), "model_id", "left")  # few models: dealt by them, most requests would go to one task
    parts = [F.coalesce(F.col(f"{r}_tokens"), F.lit(0)).cast("decimal(19,0)") * F.col(r) for r in RATES]
    said = _said_micro(requests)
    rows = priced.withColumns({"said_micro": said, "list_micro": sum(parts[1:], parts[0]).cast("decimal(38,4)")})
    rows = rows.withColumn("cost_provenance", F.when(F.col("said_micro").isNotNull(), "reported").when(F.col("list_micro").isNotNull(), "registry").otherwise("unknown"))
    return rows.withColumn("cost_micro", F.coalesce("said_micro", "list_micro")).drop("said_micro", "list_micro")


def model_usage(requests: DataFrame) -> DataFrame:
    tokens = [F.sum(F.coalesce(F.col(f"{r}_tokens"), F.lit(0))).alias(f"{r}_tokens") for r in RATES]
    return requests.groupBy("model_id").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("requests"), *tokens).orderBy(F.desc("requests"), "model_id")


def cost_by_model(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests, costed requests and USD of each model; null where nothing has a price. The provenance is the strongest: reported, registry, unknown.

    A cost is linear in tokens: requests are summed by model first, and only the
    sums meet prices, so that no task gets all requests of a model.
    """
    said = requests.withColumn("said_micro", _said_micro(requests))
    unsaid = F.col("said_micro").isNull()
    tokens = [F.sum(F.when(unsaid, F.coalesce(F.col(f"{r}_tokens"), F.lit(0)).cast("decimal(19,0)"))).alias(f"{r}_tokens") for r in RATES]
    sums = said.groupBy("model_id").agg(F.count(F.lit(1)).alias("requests"), F.count("said_micro").alias("said"), F.sum("said_micro").alias("said_micro"), *tokens)
    parts = [(F.coalesce(F.col(f"{r}_tokens"), F.lit(0)).cast("decimal(28,0)") * F.col(r)).cast("decimal(38,4)") for r in RATES]
    has_price = sum(parts[1:], parts[0]).isNotNull()
    listed = F.when(F.col("said") < F.col("requests"), sum(parts[1:], parts[0]).cast("decimal(38,4)"))
    micro = F.when(F.col("said_micro").isNotNull() | listed.isNotNull(), F.coalesce("said_micro", F.lit(0)) + F.coalesce(listed, F.lit(0)))
    costed = F.when(has_price, F.col("requests")).otherwise(F.col("said"))
    provenance = F.when(F.col("said") > 0, "reported").when(has_price, "registry").otherwise("unknown")
    usd = (micro.cast("decimal(38,4)") / F.lit(1_000_000)).cast("decimal(30,6)")
    return _priced(sums, prices).select("model_id", "requests", costed.alias("costed"), usd.alias("usd"), provenance.alias("provenance")).orderBy(F.desc_nulls_last("usd"), "model_id")


def cost_total(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """USD over all models, the strongest method of any (reported, registry, unknown), and confidence: models with a cost over requests."""
    by = cost_by_model(requests, prices)
    any_of = lambda method: F.count_if(F.col("provenance") == method) > 0
    method = F.when(any_of("reported"), "reported").when(any_of("registry"), "registry").otherwise("unknown")
    return by.agg(F.sum("usd").alias("usd"), method.alias("methodology"), F.round(F.count("usd") / F.sum("requests"), 9).alias("confidence"))


def model_distribution(requests: DataFrame) -> DataFrame:
    """Share of requests of each model by project, four places."""
    from pyspark.sql import Window

    n = requests.groupBy("project_id", "model_id").agg(F.count(F.lit(1)).alias("requests"))
    return n.withColumn("share", F.round(F.col("requests") / F.sum("requests").over(Window.partitionBy("project_id")), 4))


#: Model families: (family or id pattern, capability tier, cost tier), each from 1 to 5.
DEFAULT_CATALOGUE = [("north-large", 5, 5), ("north-small", 2, 1), ("delta-mid", 3, 3)]


def catalogue(spark: SparkSession, rows: list[tuple] = DEFAULT_CATALOGUE, source: str = "default") -> DataFrame:
    if len(rows) > MOST_PRICES:
        raise ValueError(f"a catalogue has at most {MOST_PRICES} rows")
    return spark.createDataFrame(rows, "pattern string, capability int, cost_tier int").withColumn("entry_source", F.lit(source))


def tiers(models: DataFrame, entries: DataFrame) -> DataFrame:
    """Capability and cost tier of each distinct model_id: an exact entry, else the longest pattern that its id begins with; 0 without one."""
    best = F.struct((F.col("model_id") == F.col("pattern")).alias("exact"), (F.col("entry_source") == "override").alias("own"), F.length("pattern").alias("len"))
    met = models.select("model_id").distinct().join(_bounded(entries), F.col("model_id").startswith(F.col("pattern")), "left")
    found = met.groupBy("model_id").agg(F.max_by(F.struct("capability", "cost_tier"), best).alias("e"))
    return found.select("model_id", F.coalesce("e.capability", F.lit(0)).alias("capability"), F.coalesce("e.cost_tier", F.lit(0)).alias("cost_tier"))


def dominant_models(requests: DataFrame) -> DataFrame:
    """The model with most requests of each project, the first by name of equals, and the project's requests."""
    return dominant_of(requests.groupBy("project_id", "model_id").agg(F.count(F.lit(1)).alias("requests")))


def dominant_of(counted: DataFrame) -> DataFrame:
    """dominant_models() of requests that are counted by project and model."""
    return counted.groupBy("project_id").agg(F.min_by("model_id", F.struct((-F.col("requests")).alias("n"), "model_id")).alias("model_id"), F.sum("requests").alias("requests"))
