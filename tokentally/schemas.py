"""Fixed read schemas. Names keep the case of the files: Spark's JSON reader is case-sensitive."""

from pyspark.sql import types as T

from .constants import ACTIVITY_COUNTERS


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

# Only what the queries touch: message bodies are left out, so the parser skips them.
INVOCATION = _struct(
    timestamp=_S,
    accountId=_S,
    region=_S,
    modelId=_S,
    identity=_struct(arn=_S),
    input=_struct(inputTokenCount=_I),
    output=_struct(outputTokenCount=_I),
)

# Metadata keys differ between callers, hence a map: unknown keys survive.
TAGGED_INVOCATION = _struct(
    timestamp=_S,
    accountId=_S,
    identity=_struct(arn=_S),
    region=_S,
    requestId=_S,
    operation=_S,
    modelId=_S,
    input=_struct(inputContentType=_S, inputTokenCount=_I),
    output=_struct(outputContentType=_S, outputTokenCount=_I),
    requestMetadata=T.MapType(_S, _S),
    schemaType=_S,
    schemaVersion=_S,
)

_CONTENT = T.ArrayType(_struct(text=_S))
_MESSAGE = _struct(role=_S, content=_CONTENT)

# A log-event document: the record plus message bodies, latency and both clocks in epoch ms.
_EVENT_RECORD = _struct(
    **{f.name: f.dataType for f in TAGGED_INVOCATION if f.name not in ("input", "output")},
    input=_struct(
        inputContentType=_S,
        inputBodyJson=_struct(messages=T.ArrayType(_MESSAGE)),
        inputTokenCount=_I,
    ),
    output=_struct(
        outputContentType=_S,
        outputBodyJson=_struct(
            output=_struct(message=_MESSAGE),
            stopReason=_S,
            metrics=_struct(latencyMs=_L),
            usage=_struct(inputTokens=_L, outputTokens=_L, totalTokens=_L),
        ),
        outputTokenCount=_I,
    ),
)
LOG_EVENTS = _struct(
    events=T.ArrayType(_struct(timestamp=_L, message=_EVENT_RECORD, ingestionTime=_L)),
)

PROMPT_RECORD = _struct(
    generateAssistantResponseEventRequest=_struct(prompt=_S, timeStamp=_S, userId=_S),
    generateAssistantResponseEventResponse=_struct(
        assistantResponse=_S, messageMetadata=_struct(conversationId=_S)
    ),
    generateCompletionsEventRequest=_struct(
        leftContext=_S, rightContext=_S, timeStamp=_S, userId=_S, fileName=_S
    ),
    generateCompletionsEventResponse=_struct(completions=T.ArrayType(_struct(content=_S))),
)
PROMPT_LOG = _struct(records=T.ArrayType(PROMPT_RECORD))

# Counters come as text: an empty or broken one must read as NULL, not stop the job.
ACTIVITY_TEXT = _struct(UserId=_S, Date=_S, **{name: _S for name in ACTIVITY_COUNTERS})
