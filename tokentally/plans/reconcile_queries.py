"""Queries that compare metrics, log and bill."""

from pyspark.sql import functions as F

from ..constants import DEFAULT_REGION
from ..operators import filters, pricing, reconcile
from . import views
from .registry import query, rounded

_SIDES = "WITH" + views.SQL_INVOCATIONS + "," + views.SQL_SIDES
_PRICED = "WITH" + views.SQL_INVOCATIONS + "," + views.SQL_PRICES + "," + views.SQL_SIDES
_BILL = "WITH" + views.SQL_BILL


def _sums(prefix: str = "") -> str:
    return (
        f"COUNT(*) AS {prefix}invocations, "
        f"CAST(COALESCE(SUM(tin), 0) AS BIGINT) AS {prefix}input_tokens, "
        f"CAST(COALESCE(SUM(tout), 0) AS BIGINT) AS {prefix}output_tokens"
    )


def _points(spark, folder):
    metrics, _ = views.two_sides(spark, folder)
    return reconcile.log_totals(metrics)


@query(
    "src_10_metric_totals",
    _SIDES + f" SELECT model_name AS model, {_sums()} FROM side_a GROUP BY model_name",
)
def _(spark, folder):
    return reconcile.metric_totals(_points(spark, folder))


_COMPARED = _SIDES + f""",
  a AS (SELECT model_name AS model, {_sums('metric_')} FROM side_a GROUP BY model_name),
  b AS (SELECT model_name AS model, {_sums('log_')} FROM side_b GROUP BY model_name),
  j AS (SELECT COALESCE(a.model, b.model) AS model,
    COALESCE(metric_invocations, 0) AS metric_invocations,
    COALESCE(metric_input_tokens, 0) AS metric_input_tokens,
    COALESCE(metric_output_tokens, 0) AS metric_output_tokens,
    COALESCE(log_invocations, 0) AS log_invocations,
    COALESCE(log_input_tokens, 0) AS log_input_tokens,
    COALESCE(log_output_tokens, 0) AS log_output_tokens
    FROM a FULL OUTER JOIN b ON a.model IS NOT DISTINCT FROM b.model)"""


def _comparison(spark, folder):
    metrics, log = views.two_sides(spark, folder)
    points = reconcile.metric_totals(reconcile.log_totals(metrics))
    return reconcile.compare_sources(points, reconcile.log_totals(log))


@query(
    "joi_04_compare_sources",
    _COMPARED + """ SELECT *, log_invocations - metric_invocations AS diff_invocations,
    log_input_tokens - metric_input_tokens AS diff_input_tokens,
    log_output_tokens - metric_output_tokens AS diff_output_tokens,
    log_invocations = metric_invocations AND log_input_tokens = metric_input_tokens
      AND log_output_tokens = metric_output_tokens AS matches FROM j""",
)
def _(spark, folder):
    return _comparison(spark, folder)


@query(
    "met_08_match_rates",
    _COMPARED + "".join(
        f"""{' UNION ALL ' if i else ' '}SELECT '{name}' AS measure,
        CAST(SUM(metric_{name}) AS BIGINT) AS metric_total, CAST(SUM(log_{name}) AS BIGINT) AS log_total,
        CAST(SUM(metric_{name}) - SUM(log_{name}) AS BIGINT) AS difference,
        round(SUM(log_{name}) / SUM(metric_{name}) * 100, 6) AS match_percent,
        round((SUM(metric_{name}) - SUM(log_{name})) / SUM(log_{name}) * 100, 6) AS difference_percent
        FROM j"""
        for i, name in enumerate(("invocations", "input_tokens", "output_tokens"))
    ),
)
def _(spark, folder):
    rates = reconcile.match_rates(_comparison(spark, folder))
    return rounded(rates, 6, "match_percent", "difference_percent")


def _model_sums(points):
    return points.groupBy("model").agg(
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
    )


@query(
    "joi_05_billed_and_computed_cost",
    _PRICED + f""",
    a AS (SELECT model_name, {_sums()} FROM side_a GROUP BY model_name),
    b AS (SELECT model_name, {_sums()} FROM side_b GROUP BY model_name),
    billed AS (SELECT a.model_name AS model, input_tokens * pin / 1000 + output_tokens * pout / 1000 AS billed
      FROM a JOIN unit u ON a.model_name IS NOT DISTINCT FROM u.model_name),
    computed AS (SELECT b.model_name AS model, input_tokens * pin / 1000 + output_tokens * pout / 1000 AS computed
      FROM b JOIN unit u ON b.model_name IS NOT DISTINCT FROM u.model_name)
    SELECT COALESCE(x.model, y.model) AS model, round(billed, 8) AS billed_cost,
    round(computed, 8) AS computed_cost, round(computed - billed, 8) AS difference,
    COALESCE(round(abs(computed - billed), 6) = 0, FALSE) AS matches
    FROM billed x FULL OUTER JOIN computed y ON x.model IS NOT DISTINCT FROM y.model""",
)
def _(spark, folder):
    metrics, log = views.two_sides(spark, folder)
    all_sums = _model_sums(reconcile.log_totals(metrics))
    unit = F.col("unit")
    nothing = F.lit(0)
    # The bill lists input and output of a model apart.
    listed = pricing.price_list(DEFAULT_REGION)
    billed = all_sums.withColumn("unit", pricing.price(F.col("model"), listed)).select(
        "model",
        F.explode(
            F.array(
                pricing.cost(F.col("total_input_tokens"), nothing, unit),
                pricing.cost(nothing, F.col("total_output_tokens"), unit),
            )
        ).alias("cost"),
    )
    priced = pricing.with_cost(_model_sums(reconcile.log_totals(log)), "model")
    computed = priced.select("model", F.col("estimated_cost_usd").alias("cost"))
    table = reconcile.compare_costs(billed, computed)
    return rounded(table, 8, "billed_cost", "computed_cost", "difference")


_COST = "round(CAST(SUM(CAST(cost AS DECIMAL(28, 10))) AS DOUBLE), 4) AS cost"


@query(
    "src_11_bill_by_day",
    _BILL + f" SELECT day, usage_type, {_COST} FROM v6 GROUP BY day, usage_type",
)
def _(spark, folder):
    return rounded(reconcile.bill_by_day(views.bill(spark, folder)), 4, "cost")


@query(
    "flt_14_charged_groups",
    _BILL + """ SELECT usage_type, COUNT(*) AS groups FROM v6 WHERE cost > 0 GROUP BY usage_type""",
)
def _(spark, folder):
    rows = filters.charged(views.bill(spark, folder))
    return rows.groupBy("usage_type").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "agg_22_bill_by_usage_type",
    _BILL + f""" SELECT usage_type, {_COST}, FALSE AS is_total FROM v6 WHERE cost > 0 GROUP BY usage_type
    UNION ALL SELECT NULL, {_COST}, TRUE FROM v6 WHERE cost > 0""",
)
def _(spark, folder):
    bill = reconcile.bill_by_usage_type(filters.charged(views.bill(spark, folder)))
    return rounded(bill, 4, "cost")
