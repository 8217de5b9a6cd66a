"""Price list, token estimates, limits. They must stay as they are for equal results."""

# Price per 1,000 tokens in USD: (model key, input, output).
# The first key contained in a model name sets its price, so the order counts.
MODEL_PRICES = (
    ("claude-3-haiku-20240307", 0.00025, 0.00125),
    ("claude-3-sonnet-20240229", 0.003, 0.015),
    ("claude-3-opus-20240229", 0.015, 0.075),
    ("claude-3-5-haiku-20241022", 0.0008, 0.004),
    ("claude-3-5-sonnet-20240620", 0.003, 0.015),
    ("claude-3-5-sonnet-20241022", 0.003, 0.015),
    ("claude-3-7-sonnet-20250219", 0.003, 0.015),
    ("claude-sonnet-4-20250514", 0.003, 0.015),
    ("claude-sonnet-4-5-20250929", 0.003, 0.015),
    ("claude-opus-4-20250514", 0.015, 0.075),
    ("claude-opus-4-1-20250808", 0.015, 0.075),
)

# Price of a model that no key matches, and of users whose model is not known.
FALLBACK_PRICE = (0.00025, 0.00125)

DEFAULT_REGION = "default"
REGIONS = (
    "us-east-1",
    "us-west-2",
    "eu-central-1",
    "ap-northeast-1",
    "ap-northeast-2",
    "ap-southeast-1",
)

# Today every region has the same list; the region stays a key because prices may part.
REGION_PRICES = {region: MODEL_PRICES for region in (DEFAULT_REGION, *REGIONS)}

# Tokens per counted activity, by scenario.
TOKEN_ESTIMATES = {
    "conservative": {
        "chat_in": 100, "chat_out": 300, "chat_code_line": 50,
        "inline_suggestion": 40, "inline_code_line": 50,
        "dev_in": 400, "dev_out": 600,
        "test_in": 300, "test_out": 500,
        "doc_in": 200, "doc_out": 400,
    },
    "average": {
        "chat_in": 150, "chat_out": 500, "chat_code_line": 75,
        "inline_suggestion": 60, "inline_code_line": 75,
        "dev_in": 600, "dev_out": 1000,
        "test_in": 450, "test_out": 750,
        "doc_in": 350, "doc_out": 600,
    },
    "optimistic": {
        "chat_in": 200, "chat_out": 800, "chat_code_line": 100,
        "inline_suggestion": 80, "inline_code_line": 100,
        "dev_in": 1000, "dev_out": 1500,
        "test_in": 600, "test_out": 1000,
        "doc_in": 500, "doc_out": 800,
    },
}

# Monthly limits: development commands, transformed lines.
MONTHLY_DEV_EVENTS = 30
MONTHLY_TRANSFORMED_LINES = 4000
DAYS_PER_MONTH = 30
WARN_SHARE = 0.8
CAUTION_PERCENT = 50

SPIKE_FACTOR = 3
CONTEXT_WINDOW_TOKENS = 200_000
SUBSCRIPTION_USD = 19.0
VIRTUAL_PRICE = (0.003, 0.015)
ALARM_TOKENS_PER_HOUR = 10_000
KST_OFFSET_HOURS = 9
LARGE_REQUEST_TOKENS = 5000
CHARS_PER_TOKEN = 3

# Request metadata that every call should carry, and that none may carry.
REQUIRED_METADATA = ("application_name", "application_id", "environment", "team", "cost_center")
FORBIDDEN_METADATA = ("user_email", "password", "api_key")

# Counters of the daily activity report, in file order after UserId and Date.
ACTIVITY_COUNTERS = (
    "Chat_AICodeLines",
    "Chat_MessagesInteracted",
    "Chat_MessagesSent",
    "CodeFix_AcceptanceEventCount",
    "CodeFix_AcceptedLines",
    "CodeFix_GeneratedLines",
    "CodeFix_GenerationEventCount",
    "CodeReview_FailedEventCount",
    "CodeReview_FindingsCount",
    "CodeReview_SucceededEventCount",
    "Dev_AcceptanceEventCount",
    "Dev_AcceptedLines",
    "Dev_GeneratedLines",
    "Dev_GenerationEventCount",
    "DocGeneration_AcceptedFileUpdates",
    "DocGeneration_AcceptedFilesCreations",
    "DocGeneration_AcceptedLineAdditions",
    "DocGeneration_AcceptedLineUpdates",
    "DocGeneration_EventCount",
    "DocGeneration_RejectedFileCreations",
    "DocGeneration_RejectedFileUpdates",
    "DocGeneration_RejectedLineAdditions",
    "DocGeneration_RejectedLineUpdates",
    "InlineChat_AcceptanceEventCount",
    "InlineChat_AcceptedLineAdditions",
    "InlineChat_AcceptedLineDeletions",
    "InlineChat_DismissalEventCount",
    "InlineChat_DismissedLineAdditions",
    "InlineChat_DismissedLineDeletions",
    "InlineChat_RejectedLineAdditions",
    "InlineChat_RejectedLineDeletions",
    "InlineChat_RejectionEventCount",
    "InlineChat_TotalEventCount",
    "Inline_AICodeLines",
    "Inline_AcceptanceCount",
    "Inline_SuggestionsCount",
    "TestGeneration_AcceptedLines",
    "TestGeneration_AcceptedTests",
    "TestGeneration_EventCount",
    "TestGeneration_GeneratedLines",
    "TestGeneration_GeneratedTests",
    "Transformation_EventCount",
    "Transformation_LinesGenerated",
    "Transformation_LinesIngested",
)
