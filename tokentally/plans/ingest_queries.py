"""Queries over files that Spark writes from the events: broken lines, waves of files, late records, stored
tables, and streams of two sides."""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fields
from ..functions.periods import Period
from ..operators import reconcile
from ..sources import quarantine
from ..sources.ingest import Archive
from ..sources.invocations import compact_clustered, read_compacted
from ..sources.shared import shared_folder
from ..sources.sinks import write_day_files
from ..streaming import jobs, late, trends
from ..streaming.reconcile import compare_by_hour
from . import views
from .registry import query

_V = "WITH" + views.SQL_INVOCATIONS
_RECORD = ("timestamp", "accountId", "region", "modelId", "identity", "input", "output")


def _lines(events: DataFrame) -> DataFrame:
    """Events as lines of a log: value, day."""
    record = F.to_json(F.struct(*_RECORD))
    return views.invocations_of(events).select(
        record.alias("value"), F.to_date("timestamp").alias("day"), F.substring("requestId", 5, 20).cast("long").alias("event_id")
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "events")


def _period(events: DataFrame) -> Period:
    first, last = events.agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    return Period(first or date(2024, 1, 1), last or date(2024, 1, 1))


def _day() -> Column:
    return F.concat_ws("/", "year", "month", "day").alias("day")


@query(
    "src_01_sorted_records",
    _V + """ SELECT strftime(ts, '%Y/%m/%d') AS day, COUNT(*) FILTER (event_id % 37 <> 5) AS good,
      COUNT(*) FILTER (event_id % 37 = 5) AS broken,
      CAST(SUM(tin) FILTER (event_id % 37 <> 5) AS BIGINT) AS input_tokens FROM v1 GROUP BY 1""",
)
def _(spark, folder):
    """Some lines are cut; the others are read, and the cut ones are found beside them."""
    lines = _lines(_events(spark, folder))
    cut = F.when(F.col("event_id") % 37 == 5, F.left("value", F.lit(60))).otherwise(F.col("value"))
    root = shared_folder(spark, "log")
    write_day_files(lines.withColumn("value", cut), root)
    found = quarantine.sort_invocations(spark, root, _period(_events(spark, folder)))
    good = found.records.groupBy(_day()).agg(
        F.count(F.lit(1)).alias("good"), F.sum(F.col("input.inputTokenCount")).alias("input_tokens")
    )
    day = F.regexp_extract("file", r"/(\d{4}/\d{2}/\d{2})/", 1).alias("day")
    broken = found.broken.groupBy(day).agg(F.count(F.lit(1)).alias("broken"))
    joined = good.join(broken, "day", "full").na.fill(0, ["good", "broken"])
    return joined.select("day", "good", "broken", "input_tokens")


@query(
    "src_03_archive_bit_by_bit",
    _V + """ SELECT strftime(ts, '%Y/%m/%d') AS day, COUNT(*) AS calls, CAST(SUM(tin) AS BIGINT) AS input_tokens,
      CAST(SUM(tout) AS BIGINT) AS output_tokens FROM v1 GROUP BY 1""",
)
def _(spark, folder):
    """Files come in two waves for the same days; the second run reads only the second wave."""
    events, root = _events(spark, folder), shared_folder(spark, "log")
    archive = Archive(spark, root, shared_folder(spark, "archive"))
    for wave in (0, 1):
        write_day_files(_lines(events.where(F.col("event_id") % 2 == wave)), root, "gzip")
        archive.ingest(_period(events))
    return archive.read().groupBy(_day()).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("input.inputTokenCount")).alias("input_tokens"),
        F.sum(F.col("output.outputTokenCount")).alias("output_tokens"),
    )


@query(
    "str_05_corrected_windows_stream",
    _V + """ SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start,
      CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 hour AS window_end, application_name,
      CAST(SUM(tin + tout) AS BIGINT) AS total_tokens, COUNT(*) AS requests FROM v1 GROUP BY ALL""",
)
def _(spark, folder):
    """Records come in three waves, each over all days, so most of the later ones are late."""
    events, source = _events(spark, folder), shared_folder(spark, "waves")
    target = shared_folder(spark, "windows")
    for wave in (0, 1, 2):
        events.where(F.col("event_id") % 3 == wave).write.parquet(f"{source}/events{wave}.parquet")
        calls = views.invocation_stream(spark, f"{source}/*.parquet", "*.parquet")
        late.write_windows(trends.with_event_time(calls), target, f"{target}_checkpoint").awaitTermination()
    return late.read_windows(spark, target).all()


@query(
    "flt_03_identity_in_clustered_table",
    _V + """ SELECT strftime(ts, '%Y/%m/%d') AS day, COUNT(*) AS calls, CAST(SUM(tin) AS BIGINT) AS input_tokens FROM v1
      WHERE arn = 'arn:aws:iam::111111111111:role/Chatbot-Role' GROUP BY 1""",
)
def _(spark, folder):
    """The log is stored along identity and time; row groups without the identity are not read."""
    calls = views.invocations(spark, folder)
    padded = calls.withColumns({k: F.lpad(k, 2, "0") for k in ("month", "day")})
    target = shared_folder(spark, "clustered")
    compact_clustered(padded, target)
    stored = read_compacted(spark, target, schemas.TAGGED_INVOCATION)
    own = stored.where(F.col("identity.arn") == "arn:aws:iam::111111111111:role/Chatbot-Role")
    return own.groupBy(_day()).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("input.inputTokenCount")).alias("input_tokens")
    )


_SIDE = """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, model_name AS model, CAST(COUNT(*) AS BIGINT) AS invocations,
  CAST(COALESCE(SUM(tin), 0) AS BIGINT) AS input_tokens, CAST(COALESCE(SUM(tout), 0) AS BIGINT) AS output_tokens"""
_COUNTS = ("invocations", "input_tokens", "output_tokens")
_END = "no model"


def _points(calls: DataFrame) -> DataFrame:
    return calls.select(fields.event_time().alias("event_time"), *reconcile.log_columns())


@query(
    "joi_04_compare_by_hour_stream",
    "WITH" + views.SQL_INVOCATIONS + "," + views.SQL_SIDES + f""",
    a AS ({_SIDE} FROM side_a GROUP BY 1, 2), b AS ({_SIDE} FROM side_b GROUP BY 1, 2),
    j AS (SELECT coalesce(a.hour, b.hour) AS hour, CASE WHEN a.hour IS NULL THEN b.model ELSE a.model END AS model,
      {", ".join(f"coalesce({side}.{c}, 0) AS {name}_{c}" for side, name in (("a", "metric"), ("b", "log")) for c in _COUNTS)}
      FROM a FULL JOIN b ON a.hour = b.hour AND a.model IS NOT DISTINCT FROM b.model)
    SELECT *, {", ".join(f"log_{c} - metric_{c} AS diff_{c}" for c in _COUNTS)},
      {" AND ".join(f"log_{c} = metric_{c}" for c in _COUNTS)} AS matches FROM j""",
)
def _(spark, folder):
    """All calls as metrics, and a log that has lost some; points far ahead close the last hours."""
    source, result = shared_folder(spark, "points"), shared_folder(spark, "compared")
    schema = None
    for side, calls in zip(("metrics", "log"), views.two_sides(spark, folder), strict=True):
        points = _points(calls)
        schema = points.schema
        points.write.parquet(f"{source}/{side}/points")
    newest = spark.read.parquet(f"{source}/metrics/points").agg(F.max("event_time").alias("at"))
    for wave in range(4):
        streams = [spark.readStream.schema(schema).parquet(f"{source}/{side}/*") for side in ("metrics", "log")]
        compared = compare_by_hour(*streams)
        jobs.write_stream(compared, f"{result}/table", f"{result}/checkpoint").awaitTermination()
        ahead = F.col("at") + F.make_dt_interval(F.lit(30 * (wave + 1)))
        ends = [F.lit(_END).alias("model"), *(F.lit(1).cast("long").alias(c) for c in _COUNTS)]
        for side in ("metrics", "log"):
            newest.select(ahead.alias("event_time"), *ends).write.parquet(f"{source}/{side}/end{wave}")
    found = jobs.read_result(spark, f"{result}/table", compared.schema)
    return found.where(~F.col("model").eqNullSafe(_END))
