"""Prices of models. The built-in list is a literal in the plan; a price table is an equi-join.

Prices and costs are decimals, so a sum of costs does not depend on the order of its rows. Tables show
them as doubles: the last step of each.
"""

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_REGION, FALLBACK_PRICE, REGION_PRICES
from ..functions import fields

PriceList = Sequence[tuple[str, float, float]]
RegionPrices = Mapping[str, PriceList]

_UNIT = "decimal(12,9)"
COST = "estimated_cost_usd"


def _price(input_price: float, output_price: float) -> Column:
    return F.struct(
        *(
            F.lit(Decimal(str(value))).cast(_UNIT).alias(name)
            for name, value in (("input", input_price), ("output", output_price))
        )
    )


def _listed_price(key: Column, prices: PriceList) -> Column:
    """Price of the first listed model key contained in `key`, NULL if none is."""
    listed = F.lit(None)
    for model_key, input_price, output_price in reversed(prices):
        listed = F.when(key.contains(model_key), _price(input_price, output_price)).otherwise(listed)
    return listed


def price_list(region: str, prices: RegionPrices = REGION_PRICES) -> PriceList:
    """The list of a region; an unknown region has the default list."""
    return prices.get(region, prices[DEFAULT_REGION])


def price(model: Column, listed: PriceList) -> Column:
    """Price struct of a model: the first match in a price list, else the fallback."""
    return F.coalesce(_listed_price(fields.price_key(model), listed), _price(*FALLBACK_PRICE))


def cost(input_tokens: Column, output_tokens: Column, unit: Column) -> Column:
    """Exact cost in USD, a decimal, of token sums at a price per 1,000; missing sums count 0."""
    thousandth = F.lit(Decimal("0.001"))
    tokens = [fields.or_zero(x).cast("decimal(20,0)") for x in (input_tokens, output_tokens)]
    return tokens[0] * unit["input"] * thousandth + tokens[1] * unit["output"] * thousandth


def cost_sum() -> Column:
    """The summed cost of a group as a double; the sum itself is exact."""
    return fields.or_zero(F.sum(COST)).cast("double").alias(COST)


def _sums_cost(unit: Column) -> Column:
    return cost(F.col("total_input_tokens"), F.col("total_output_tokens"), unit)


def _costed(df: DataFrame, unit: Column, exact: bool) -> DataFrame:
    # A column of its own keeps the list from being searched once for input and once for output.
    price_of_row = _sums_cost(F.col("__unit"))
    shown = price_of_row if exact else price_of_row.cast("double")
    return df.withColumn("__unit", unit).withColumn(COST, shown).drop("__unit")


def with_cost(
    df: DataFrame,
    model_column: str = "model_name",
    region: str = DEFAULT_REGION,
    prices: RegionPrices = REGION_PRICES,
    exact: bool = False,
) -> DataFrame:
    """Add `estimated_cost_usd` to token sums per model: a projection, no join and no shuffle.

    Use it after aggregation, so that every group is priced once. With `exact` the cost is a decimal,
    for further sums.
    """
    return _costed(df, price(F.col(model_column), price_list(region, prices)), exact)


def with_cost_by_region(
    df: DataFrame,
    region_column: str = "region",
    model_column: str = "model_name",
    prices: RegionPrices = REGION_PRICES,
    exact: bool = False,
) -> DataFrame:
    """Like `with_cost`, with the price list of each row's own region."""
    default = prices[DEFAULT_REGION]
    unit = price(F.col(model_column), default)
    for region, listed in prices.items():
        if listed != default:
            regional = price(F.col(model_column), listed)
            unit = F.when(F.col(region_column) == region, regional).otherwise(unit)
    return _costed(df, unit, exact)


def with_flat_cost(df: DataFrame) -> DataFrame:
    """Add `estimated_cost_usd` at the fallback price, for sums whose model is not known."""
    return df.withColumn(COST, _sums_cost(_price(*FALLBACK_PRICE)).cast("double"))


def price_table(spark: SparkSession, prices: RegionPrices = REGION_PRICES) -> DataFrame:
    """The price lists as a table (region, ord, model_key, in_price, out_price)."""
    rows = [
        (region, ord, *entry)
        for region, entries in prices.items()
        for ord, entry in enumerate(entries)
    ]
    schema = "region string, ord int, model_key string, in_price double, out_price double"
    return spark.createDataFrame(rows, schema)


def with_table_cost(
    models: DataFrame,
    table: DataFrame,
    model_column: str = "model_name",
    region: str = DEFAULT_REGION,
) -> DataFrame:
    """Like `with_cost`, with the prices in a table of any size; every row stays.

    Prices are looked up for the distinct names and joined back. "Key contained in name" is an
    equi-join on the substrings of a name that are as long as some key: no side has to be small
    enough to broadcast, and no cross join arises.
    """
    default = table.where(F.col("region") == DEFAULT_REGION)
    own = table.where(F.col("region") == region)
    listed = default
    if region != DEFAULT_REGION:
        listed = own.unionByName(default.where(~own.exists()))
    listed = listed.select(
        "model_key",
        "ord",
        F.struct(
            F.col("in_price").cast(_UNIT).alias("input"), F.col("out_price").cast(_UNIT).alias("output")
        ).alias("unit"),
    )
    lengths = listed.agg(F.collect_set(F.length("model_key"))).scalar()
    key = fields.price_key(F.col("__model"))
    length = F.col("__length")
    parts = F.transform(
        F.sequence(F.lit(1), F.length(key) - length + 1), lambda start: F.substring(key, start, length)
    )
    names = models.select(F.col(model_column).alias("__model")).where("__model is not null").distinct()
    units = (
        names.withColumn("__lengths", lengths)
        .select("__model", F.explode("__lengths").alias("__length"))
        .where((length > 0) & (length <= F.length(key)))
        .select("__model", F.explode(F.array_distinct(parts)).alias("model_key"))
        .join(listed, "model_key")
        .groupBy("__model")
        .agg(F.min_by("unit", "ord").alias("__listed"))
    )
    priced = models.join(units, models[model_column] == units["__model"], "left")
    unit = F.coalesce("__listed", _price(*FALLBACK_PRICE))
    return _costed(priced, unit, False).drop("__model", "__listed")
