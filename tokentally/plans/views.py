"""The inputs of the queries, derived from the sample tables: one projection or aggregate each.

`SQL_*` state the same inputs as common table expressions.
"""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..operators.prompts import flatten_records
from ..schemas import PROMPT_RECORD
from ..sources.invocations import ANY_AGE

_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


# Declared, so that planning does not open files to infer them.
_SCHEMAS = {
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
      value double, props string""",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
      l_quantity double, l_extendedprice double, l_discount double, l_tax double,
      l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


# Columns as SQL text: one expression each, where nested calls would be hundreds.
_INVOCATION = (
    f"date_format(ts, \"{_TEXT}\") AS timestamp",
    "'111111111111' AS accountId",
    """named_struct('arn', CASE user_id % 5
      WHEN 0 THEN concat('arn:aws:sts::111111111111:assumed-role/CustomerService-Role/s', user_id)
      WHEN 1 THEN concat('arn:aws:sts::111111111111:assumed-role/DataAnalysis-Role/s', user_id)
      WHEN 2 THEN concat('arn:aws:iam::111111111111:user/dev', user_id)
      WHEN 3 THEN 'arn:aws:iam::111111111111:role/Chatbot-Role'
      ELSE 'arn:aws:iam::111111111111:role/user-service' END) AS identity""",
    """element_at(array('us-east-1', 'us-west-2', 'eu-central-1', 'ap-northeast-1',
      'ap-northeast-2', 'ap-southeast-1', 'sa-east-1'), int(user_id % 7 + 1)) AS region""",
    "concat('req-', event_id) AS requestId",
    "'Converse' AS operation",
    """CASE WHEN event_id % 101 = 0 THEN NULL
      WHEN event_type = 'view' THEN 'us.anthropic.claude-3-haiku-20240307-v1:0'
      WHEN event_type = 'click' THEN 'anthropic.claude-3-5-sonnet-20240620-v1:0'
      WHEN event_type = 'purchase' THEN concat('arn:aws:models:us-east-1:111111111111:',
        'inference-profile/us.anthropic.claude-sonnet-4-5-20250929-v1:0')
      WHEN event_type = 'signup' THEN 'vendor.other-model-v1'
      WHEN event_id % 2 = 0 THEN 'us.anthropic.claude-opus-4-20250514-v1:0'
      ELSE 'claude-3-opus-20240229' END AS modelId""",
    """named_struct('inputTokenCount',
      CASE WHEN event_id % 97 <> 0 THEN int(floor(value * 20)) END) AS input""",
    """named_struct('outputTokenCount',
      CASE WHEN event_id % 89 <> 0 THEN int(event_id * 7 % 6000) END) AS output""",
    """map(
      'application_name', CASE event_id % 5 WHEN 0 THEN 'CustomerServiceApp'
        WHEN 1 THEN 'SalesAssistantApp' WHEN 2 THEN 'DeveloperToolsApp'
        WHEN 3 THEN 'DocumentAnalysisApp' END,
      'application_id', CASE WHEN event_id % 5 < 4 AND user_id % 13 <> 0
        THEN concat('app-00', event_id % 5 + 1) END,
      'environment', CASE event_id % 5 WHEN 2 THEN 'development' WHEN 4 THEN NULL
        ELSE 'production' END,
      'team', CASE event_id % 5 WHEN 0 THEN 'customer-support' WHEN 1 THEN 'sales'
        WHEN 2 THEN 'engineering' WHEN 3 THEN 'product' END,
      'cost_center', CASE event_id % 5 WHEN 0 THEN 'CS-123' WHEN 1 THEN 'SALES-456'
        WHEN 2 THEN 'ENG-789' WHEN 3 THEN 'PROD-999' END,
      'tenant_id', CASE event_id % 5 WHEN 0 THEN concat('tenant-', user_id % 3 + 101)
        WHEN 1 THEN concat('prospect-', user_id % 2 + 301)
        WHEN 3 THEN CASE user_id % 3 WHEN 0 THEN 'acme-corp' WHEN 1 THEN 'globex-inc'
          ELSE 'initech-llc' END END,
      'user_id', CASE WHEN event_id % 5 < 4 THEN concat('user-', user_id) END,
      'experiment_id', CASE WHEN event_id % 5 < 4 AND event_id % 3 = 0 THEN 'prompt-test-001' END,
      'variant', CASE WHEN event_id % 5 < 4 AND event_id % 3 = 0
        THEN if(user_id % 2 = 0, 'version-a', 'version-b') END,
      'user_email', CASE WHEN event_id % 5 < 4 AND user_id % 17 = 0 THEN 'someone@example.com' END
    ) AS requestMetadata""",
    "string(year(ts)) AS year",
    "string(month(ts)) AS month",
    "string(day(ts)) AS day",
)


def invocations_of(events: DataFrame) -> DataFrame:
    """Tagged invocation records from events, batch or stream."""
    return events.selectExpr(*_INVOCATION)


def _between(events: DataFrame, start: date, end: date) -> DataFrame:
    """Events of the days `start` to `end`: a plain range, so files and row groups are skipped."""
    first = F.lit(f"{start} 00:00:00").cast("timestamp_ntz")
    after = F.lit(f"{end + timedelta(days=1)} 00:00:00").cast("timestamp_ntz")
    return events.where((F.col("ts") >= first) & (F.col("ts") < after))


def invocations(
    spark: SparkSession, folder: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Invocation records. With days given, the scan skips files and row groups of other days."""
    events = table(spark, folder, "events")
    if start is not None and end is not None:
        events = _between(events, start, end)
    return invocations_of(events)


def invocation_stream(spark: SparkSession, folder: str, names: str = "events*.parquet") -> DataFrame:
    """The same records as a stream of files with such names."""
    files = spark.readStream.schema(_SCHEMAS["events"]).option("pathGlobFilter", names)
    files = files.option("maxFileAge", ANY_AGE)
    return invocations_of(files.parquet(folder))


SQL_INVOCATIONS = """
v1 AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", ts, event_id, event_type,
    CASE user_id % 5
      WHEN 0 THEN 'arn:aws:sts::111111111111:assumed-role/CustomerService-Role/s' || user_id
      WHEN 1 THEN 'arn:aws:sts::111111111111:assumed-role/DataAnalysis-Role/s' || user_id
      WHEN 2 THEN 'arn:aws:iam::111111111111:user/dev' || user_id
      WHEN 3 THEN 'arn:aws:iam::111111111111:role/Chatbot-Role'
      ELSE 'arn:aws:iam::111111111111:role/user-service' END AS arn,
    CASE user_id % 7 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' WHEN 2 THEN 'eu-central-1'
      WHEN 3 THEN 'ap-northeast-1' WHEN 4 THEN 'ap-northeast-2' WHEN 5 THEN 'ap-southeast-1'
      ELSE 'sa-east-1' END AS region,
    'req-' || event_id AS request_id,
    CASE WHEN event_id % 101 = 0 THEN NULL
      WHEN event_type = 'view' THEN 'us.anthropic.claude-3-haiku-20240307-v1:0'
      WHEN event_type = 'click' THEN 'anthropic.claude-3-5-sonnet-20240620-v1:0'
      WHEN event_type = 'purchase' THEN 'arn:aws:models:us-east-1:111111111111:inference-profile/us.anthropic.claude-sonnet-4-5-20250929-v1:0'
      WHEN event_type = 'signup' THEN 'vendor.other-model-v1'
      WHEN event_id % 2 = 0 THEN 'us.anthropic.claude-opus-4-20250514-v1:0'
      ELSE 'claude-3-opus-20240229' END AS model_id,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(floor(value * 20) AS INTEGER) END AS tin,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(event_id * 7 % 6000 AS INTEGER) END AS tout,
    CASE event_id % 5 WHEN 0 THEN 'CustomerServiceApp' WHEN 1 THEN 'SalesAssistantApp'
      WHEN 2 THEN 'DeveloperToolsApp' WHEN 3 THEN 'DocumentAnalysisApp' END AS application_name,
    CASE WHEN event_id % 5 < 4 AND user_id % 13 <> 0 THEN 'app-00' || (event_id % 5 + 1) END AS application_id,
    CASE WHEN event_id % 5 IN (0, 1, 3) THEN 'production' WHEN event_id % 5 = 2 THEN 'development' END AS environment,
    CASE event_id % 5 WHEN 0 THEN 'customer-support' WHEN 1 THEN 'sales' WHEN 2 THEN 'engineering'
      WHEN 3 THEN 'product' END AS team,
    CASE event_id % 5 WHEN 0 THEN 'CS-123' WHEN 1 THEN 'SALES-456' WHEN 2 THEN 'ENG-789'
      WHEN 3 THEN 'PROD-999' END AS cost_center,
    CASE event_id % 5 WHEN 0 THEN 'tenant-' || (user_id % 3 + 101)
      WHEN 1 THEN 'prospect-' || (user_id % 2 + 301)
      WHEN 3 THEN CASE user_id % 3 WHEN 0 THEN 'acme-corp' WHEN 1 THEN 'globex-inc' ELSE 'initech-llc' END
      END AS tenant_id,
    CASE WHEN event_id % 5 < 4 THEN 'user-' || user_id END AS user_id,
    CASE WHEN event_id % 5 < 4 AND event_id % 3 = 0 THEN 'prompt-test-001' END AS experiment_id,
    CASE WHEN event_id % 5 < 4 AND event_id % 3 = 0 THEN
      CASE WHEN user_id % 2 = 0 THEN 'version-a' ELSE 'version-b' END END AS variant,
    CASE WHEN event_id % 5 < 4 AND user_id % 17 = 0 THEN 'someone@example.com' END AS user_email,
    CAST(year(ts) AS VARCHAR) AS year, CAST(month(ts) AS VARCHAR) AS month,
    CAST(day(ts) AS VARCHAR) AS day, CAST(ts AS DATE) AS date,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE 1 END AS has_model
  FROM events),
v1m AS (
  SELECT *, CASE WHEN event_type = 'purchase' AND has_model = 1
      THEN 'us.anthropic.claude-sonnet-4-5-20250929-v1:0' ELSE model_id END AS model_name,
    CASE WHEN contains(arn, 'assumed-role') THEN regexp_extract(arn, 'assumed-role/[^/]+')
      WHEN contains(arn, ':user/') THEN regexp_extract(arn, 'user/[^/]+')
      WHEN contains(arn, 'user') THEN NULL ELSE 'Unknown' END AS label
  FROM v1)"""

SQL_PRICES = """
prices(ord, model_key, pin, pout) AS (VALUES
  (0, 'claude-3-haiku-20240307', 0.00025::DOUBLE, 0.00125::DOUBLE),
  (1, 'claude-3-sonnet-20240229', 0.003, 0.015),
  (2, 'claude-3-opus-20240229', 0.015, 0.075),
  (3, 'claude-3-5-haiku-20241022', 0.0008, 0.004),
  (4, 'claude-3-5-sonnet-20240620', 0.003, 0.015),
  (5, 'claude-3-5-sonnet-20241022', 0.003, 0.015),
  (6, 'claude-3-7-sonnet-20250219', 0.003, 0.015),
  (7, 'claude-sonnet-4-20250514', 0.003, 0.015),
  (8, 'claude-sonnet-4-5-20250929', 0.003, 0.015),
  (9, 'claude-opus-4-20250514', 0.015, 0.075),
  (10, 'claude-opus-4-1-20250808', 0.015, 0.075)),
model_names AS (
  SELECT DISTINCT model_name, CASE WHEN contains(model_name, '.')
    THEN split_part(split_part(model_name, '.', -1), '-v', 1) ELSE model_name END AS price_key
  FROM v1m),
unit AS (
  SELECT m.model_name, COALESCE(arg_min(p.pin, p.ord), 0.00025) AS pin,
    COALESCE(arg_min(p.pout, p.ord), 0.00125) AS pout
  FROM model_names m LEFT JOIN prices p ON contains(m.price_key, p.model_key)
  GROUP BY m.model_name)"""


_ACTIVITY_KEYS = (
    "concat('user-', user_id) AS UserId",
    """CASE WHEN user_id % 50 = 7 AND day(ts) = 3 THEN 'n/a' ELSE date_format(
      if(user_id % 10 = 0, ts - INTERVAL 10 DAYS, ts), 'MM-dd-yyyy') END AS Date""",
)
_ACTIVITY_COUNTERS = (
    "int(sum(if(event_type = 'view', if(day(ts) = 10, 50, 1), 0))) AS Chat_MessagesSent",
    "int(nullif(count_if(event_type = 'click'), 0)) AS Inline_SuggestionsCount",
    "int(count_if(event_type = 'purchase')) AS Inline_AcceptanceCount",
    "int(sum(if(event_type = 'view', event_id % 7, 0))) AS Chat_AICodeLines",
    "int(sum(if(event_type = 'click', event_id % 5, 0))) AS Inline_AICodeLines",
    "int(count_if(event_type = 'signup')) AS Dev_GenerationEventCount",
    "int(count_if(event_type = 'error' AND event_id % 2 = 0)) AS TestGeneration_EventCount",
    "int(count_if(event_type = 'error' AND event_id % 6 = 1)) AS DocGeneration_EventCount",
    "int(sum(if(event_type = 'purchase', event_id % 50, 0))) AS Transformation_LinesIngested",
)


def activity(
    spark: SparkSession, folder: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Activity rows: events counted per user and day.

    Some users report ten days early and so are active over New Year, some dates are broken, some
    counters are empty, and one day is far busier than the others.
    """
    events = table(spark, folder, "events")
    if start is not None and end is not None:
        events = _between(events, start, end + timedelta(days=10))
    keys = [F.expr(key) for key in _ACTIVITY_KEYS]
    return events.groupBy(*keys).agg(*[F.expr(counter) for counter in _ACTIVITY_COUNTERS])


SQL_ACTIVITY = """
v3 AS (
  SELECT 'user-' || user_id AS UserId,
    CASE WHEN user_id % 50 = 7 AND day(ts) = 3 THEN 'n/a' ELSE
      strftime(CASE WHEN user_id % 10 = 0 THEN ts - INTERVAL 10 DAY ELSE ts END, '%m-%d-%Y') END AS Date,
    CAST(SUM(CASE WHEN event_type = 'view' THEN CASE WHEN day(ts) = 10 THEN 50 ELSE 1 END ELSE 0 END) AS BIGINT) AS chat,
    CAST(NULLIF(COUNT(*) FILTER (event_type = 'click'), 0) AS BIGINT) AS suggestions,
    CAST(COUNT(*) FILTER (event_type = 'purchase') AS BIGINT) AS acceptances,
    CAST(SUM(CASE WHEN event_type = 'view' THEN event_id % 7 ELSE 0 END) AS BIGINT) AS chat_lines,
    CAST(SUM(CASE WHEN event_type = 'click' THEN event_id % 5 ELSE 0 END) AS BIGINT) AS inline_lines,
    CAST(COUNT(*) FILTER (event_type = 'signup') AS BIGINT) AS dev,
    CAST(COUNT(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS BIGINT) AS test,
    CAST(COUNT(*) FILTER (event_type = 'error' AND event_id % 6 = 1) AS BIGINT) AS doc,
    CAST(SUM(CASE WHEN event_type = 'purchase' THEN event_id % 50 ELSE 0 END) AS BIGINT) AS transformed
  FROM events GROUP BY 1, 2)"""


def _moment(seconds: str) -> str:
    """So many seconds into 2024, whatever the session's zone."""
    return f"(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}))"


def _log_time(seconds: str) -> str:
    return f"date_format({_moment(seconds)}, \"{_TEXT}\")"


def _file(kind: str, seconds: str, name: str) -> str:
    day = f"date_format({_moment(seconds)}, 'yyyy/MM/dd')"
    return f"concat({day}, '/{kind}/', {name}, '.json.gz')"


_CHAT_TIME = f"CASE WHEN conv_id % 17 <> 0 THEN {_log_time('conv_id * 3600 + turn * 60')} END"
_CHAT_USER = """CASE WHEN conv_id % 29 = 0 THEN NULL WHEN conv_id % 31 = 0 THEN ''
  ELSE concat('User-', conv_id % 23) END"""
_CHAT_FILE = _file("GenerateAssistantResponse", "conv_id * 3600", "'c-', conv_id") + " AS file"
_INLINE_TIME = f"""CASE WHEN doc_id % 43 = 0 THEN left({_log_time('doc_id * 60')}, 10)
  WHEN doc_id % 37 <> 0 THEN {_log_time('doc_id * 60')} END"""
_INLINE_FILE = _file("GenerateCompletions", "doc_id * 60", "'d-', doc_id") + " AS file"


def turns(spark: SparkSession, folder: str, text: Column) -> DataFrame:
    """User turns with `text` of the turn and of the assistant turn right after it.

    Joined on (conversation, turn), which is as good as unique, so a conversation that holds most
    turns still spreads over all tasks; a window per conversation would not.
    """
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", text.alias("x"))
    asked = said.where(F.col("role") == "user").select("conv_id", "turn", F.col("x").alias("asked"))
    answered = said.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("answered")
    )
    return asked.join(answered, ["conv_id", "turn"], "left")


def _record(**parts: str) -> str:
    """One record; the parts not given are NULL."""
    pairs = [
        f"'{field.name}', "
        + parts.get(field.name, f"CAST(NULL AS {field.dataType.simpleString()})")
        for field in PROMPT_RECORD
    ]
    return f"named_struct({', '.join(pairs)})"


_CHAT_RECORD = _record(
    generateAssistantResponseEventRequest=f"""named_struct(
      'prompt', CASE WHEN doc_id % 13 <> 0 THEN text END,
      'timeStamp', {_INLINE_TIME}, 'userId', CASE WHEN doc_id % 29 <> 0 THEN concat('User-', doc_id % 23) END)""",
    generateAssistantResponseEventResponse="""named_struct(
      'assistantResponse', CASE WHEN doc_id % 11 <> 0 THEN substr(text, int(length(text) div 3 + 1)) END,
      'messageMetadata', named_struct('conversationId', concat('c-', doc_id % 19)))""",
)
_INLINE_RECORD = _record(
    generateCompletionsEventRequest=f"""named_struct(
      'leftContext', CASE WHEN doc_id % 41 <> 0 THEN left(text, int(length(text) div 2)) END,
      'rightContext', substr(text, int(length(text) div 2 + 1)),
      'timeStamp', {_INLINE_TIME}, 'userId', concat('dev-', doc_id % 31),
      'fileName', concat('src/f', doc_id, '.py'))""",
    generateCompletionsEventResponse="""named_struct('completions', array(
      named_struct('content', lang),
      named_struct('content', CASE WHEN doc_id % 3 <> 0 THEN source END),
      named_struct('content', text)))""",
)


def prompt_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Raw prompt-log documents with whole texts: each holds a chat, an inline request and neither.

    One document holds both sides of its records, as log files do, so no text is shuffled.
    """
    return table(spark, folder, "documents").selectExpr(
        f"array({_CHAT_RECORD}, {_INLINE_RECORD}, {_record()}) AS records"
    )


def inline_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Raw documents of the inline requests only."""
    return table(spark, folder, "documents").selectExpr(f"array({_INLINE_RECORD}) AS records", _INLINE_FILE)


def chat_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat chat rows. Texts are counted before the turns are paired: only numbers are shuffled."""
    return turns(spark, folder, fields.text_tokens(F.col("text"))).selectExpr(
        "'chat' AS type",
        "asked AS input_tokens",
        "coalesce(answered, 0) AS output_tokens",
        f"{_CHAT_TIME} AS timestamp",
        f"{_CHAT_USER} AS user_id",
        "concat('c-', conv_id) AS conversation_id",
        _CHAT_FILE,
    )


def inline_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat inline rows."""
    return flatten_records(inline_logs(spark, folder), fields.text_tokens, "file").drop(
        "conversation_id"
    )


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat rows of both kinds, with their file."""
    return chat_prompts(spark, folder).unionByName(
        inline_prompts(spark, folder), allowMissingColumns=True
    )


SQL_PROMPTS = """
v4 AS (
  SELECT 'chat' AS type, CAST(length(u.text) // 3 AS BIGINT) AS input_tokens,
    CAST(COALESCE(length(a.text) // 3, 0) AS BIGINT) AS output_tokens,
    CASE WHEN u.conv_id % 17 = 0 THEN NULL ELSE strftime(
      TIMESTAMP '2024-01-01' + to_hours(u.conv_id) + to_minutes(u.turn), '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
    CASE WHEN u.conv_id % 29 = 0 THEN NULL WHEN u.conv_id % 31 = 0 THEN ''
      ELSE 'User-' || (u.conv_id % 23) END AS user_id,
    'c-' || u.conv_id AS conversation_id, CAST(NULL AS VARCHAR) AS file_name,
    strftime(TIMESTAMP '2024-01-01' + to_hours(u.conv_id), '%Y/%m/%d')
      || '/GenerateAssistantResponse/c-' || u.conv_id || '.json.gz' AS file
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
  UNION ALL
  SELECT 'inline',
    CASE WHEN doc_id % 41 = 0 THEN (length(text) - length(text) // 2) // 3 ELSE length(text) // 3 END,
    length(lang || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END || chr(10)
      || text) // 3,
    CASE WHEN doc_id % 43 = 0 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d')
      WHEN doc_id % 37 = 0 THEN NULL
      ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ') END,
    'dev-' || (doc_id % 31), NULL, 'src/f' || doc_id || '.py',
    strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y/%m/%d')
      || '/GenerateCompletions/d-' || doc_id || '.json.gz'
  FROM documents)"""


def two_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All calls, and a log that has lost some calls of two models and all of a third."""
    events = table(spark, folder, "events")
    late = F.col("event_type").isin("view", "click") & (F.col("event_id") % 10 == 0)
    arrived = events.where(~late & (F.col("event_type") != "signup"))
    return invocations_of(events), invocations_of(arrived)


SQL_SIDES = """
side_a AS (SELECT * FROM v1m),
side_b AS (SELECT * FROM v1m WHERE event_type <> 'signup'
  AND NOT (event_type IN ('view', 'click') AND event_id % 10 = 0))"""


def bill(spark: SparkSession, folder: str) -> DataFrame:
    """Billing groups: day, usage type, cost."""
    return table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("day"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("usage_type"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("cost"),
    )


SQL_BILL = """
v6 AS (
  SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag || '-' || l_linestatus AS usage_type,
    l_extendedprice * l_discount AS cost
  FROM lineitem)"""


# Records of `prompt_logs`: the inline rows of v4, and a chat for each document.
SQL_PROMPT_LOGS = SQL_PROMPTS + """,
v5 AS (
  SELECT 'chat' AS type, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE length(text) // 3 END AS input_tokens,
    CASE WHEN doc_id % 11 = 0 THEN 0 ELSE (length(text) - length(text) // 3) // 3 END AS output_tokens,
    CASE WHEN doc_id % 43 = 0 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d')
      WHEN doc_id % 37 = 0 THEN NULL
      ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
    CASE WHEN doc_id % 29 <> 0 THEN 'User-' || (doc_id % 23) END AS user_id,
    'c-' || (doc_id % 19) AS conversation_id, CAST(NULL AS VARCHAR) AS file_name
  FROM documents
  UNION ALL
  SELECT type, input_tokens, output_tokens, "timestamp", user_id, conversation_id, file_name
  FROM v4 WHERE type = 'inline')"""
