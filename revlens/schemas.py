"""Fixed schemas and enumerations.

Every table is read with an explicit schema; nothing is inferred.  Sentinel
values (``accepted = -1``, ``repo = ''``, ``language = ''``) are kept at the
boundary so results match the review store's semantics, and NULL never
reaches a sentinel column.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reviewed application's for equal results.
# ---------------------------------------------------------------------------

# Finding severity, worst first.
SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
# Finding category.
CATEGORIES = ["security", "bug", "logic", "style", "performance", "test_coverage"]
# Stored (legacy) severity labels.
STORED_SEVERITIES = ["CRITICAL", "WARNING", "SUGGESTION"]
# Stored label -> normalised severity (anything else is lower-cased).
STORED_TO_SEVERITY = {"CRITICAL": "critical", "WARNING": "high", "SUGGESTION": "low"}
# PR verdicts.
VERDICTS = ["approved", "needs_changes", "critical_issues"]
# Acceptance sentinel values: -1 unrated, 0 rejected, 1 accepted.
UNRATED, REJECTED, ACCEPTED = -1, 0, 1
# Webhook actions that trigger a review.
REVIEWABLE_ACTIONS = ["opened", "synchronize", "reopened"]
# File extension -> language ("unknown" otherwise).
EXTENSION_LANGUAGE = {".py": "python", ".js": "javascript", ".ts": "javascript",
                      ".jsx": "javascript", ".tsx": "javascript"}
# Convention categories.
CONVENTION_CATEGORIES = ["security", "python_style", "error_handling", "performance", "testing"]
# Severity icons (outputs) and notification colours.
SEVERITY_ICONS = {"critical": "🚨", "high": "❗", "medium": "⚠️", "low": "💡", "info": "ℹ️"}
COLOUR_CRITICAL, COLOUR_HIGH, COLOUR_OK = "#FF4444", "#FFB800", "#36A64F"
# Verdict -> emoji.
VERDICT_EMOJI = {"approved": "✅", "needs_changes": "⚠️", "critical_issues": "🚨"}
VERDICT_EMOJI_DEFAULT = "🤖"
# Rich-notification emoji by bare verdict words.
VERDICT_SLACK_EMOJI = {"APPROVED": ":white_check_mark:", "NEEDS CHANGES": ":warning:",
                       "CRITICAL ISSUES": ":rotating_light:"}
VERDICT_SLACK_EMOJI_DEFAULT = ":information_source:"
# Acceptance labels: prompt context and history page.
PROMPT_STATUS = {1: "✓ accepted", 0: "✗ rejected", -1: "unrated"}
HISTORY_STATUS = {1: "✅ Accepted", 0: "❌ Rejected", -1: "— Unrated"}
# Character caps.
MAX_PATCH_CHARS = 4000
MAX_SUMMARY_CHARS = 12000
MAX_STORED_SNIPPET = 2000
MAX_STORED_COMMENT = 1000
MAX_PR_BODY = 1000
LIST_COMMENT_CHARS = 200
LIST_SNIPPET_CHARS = 100
SHORT_SHA = 12
EMBED_BATCH = 100
MAX_RETRIES = 3
PREVIEW_CHARS = 80
# Minimum SHA length and finding text length.
MIN_SHA_LEN = 7
MIN_FINDING_TEXT = 5
# Retrieval sizes used by the review pipeline.
SIMILAR_REVIEWS_N = 3
CONVENTIONS_N = 3

# Our own product name, used in rendered texts.
PRODUCT = "RevLens"

# ---------------------------------------------------------------------------
# Table schemas (section 1.2 of the blueprint)
# ---------------------------------------------------------------------------

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType(), False),
    T.StructField("code_snippet", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("comment", T.StringType(), True),
    T.StructField("file", T.StringType(), True),
    T.StructField("line", T.IntegerType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("accepted", T.IntegerType(), True),
    T.StructField("repo", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("pr_number", T.IntegerType(), True),
    T.StructField("pr_title", T.StringType(), True),
])

CONVENTION_SCHEMA = T.StructType([
    T.StructField("convention_id", T.StringType(), False),
    T.StructField("rule", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("repo", T.StringType(), True),
    T.StructField("language", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("added_by", T.StringType(), True),
])

_USER = T.StructType([T.StructField("login", T.StringType()), T.StructField("id", T.LongType()),
                      T.StructField("type", T.StringType())])
_REF = T.StructType([T.StructField("label", T.StringType()), T.StructField("ref", T.StringType()),
                     T.StructField("sha", T.StringType())])
EVENT_SCHEMA = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("number", T.LongType()),
    T.StructField("pull_request", T.StructType([
        T.StructField("number", T.LongType()), T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()), T.StructField("state", T.StringType()),
        T.StructField("draft", T.BooleanType()), T.StructField("html_url", T.StringType()),
        T.StructField("user", _USER), T.StructField("head", _REF), T.StructField("base", _REF),
        T.StructField("additions", T.LongType()), T.StructField("deletions", T.LongType()),
        T.StructField("changed_files", T.LongType()),
    ])),
    T.StructField("repository", T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("full_name", T.StringType()), T.StructField("private", T.BooleanType()),
        T.StructField("html_url", T.StringType()),
        T.StructField("owner", T.StructType([T.StructField("login", T.StringType()),
                                             T.StructField("id", T.LongType())])),
        T.StructField("default_branch", T.StringType()),
    ])),
    T.StructField("sender", _USER),
])

DELIVERY_SCHEMA = T.StructType([
    T.StructField("delivery_id", T.StringType()),
    T.StructField("received_ts", T.TimestampType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("body", T.StringType()),
])

DIFF_FILE_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("pr_number", T.LongType()),
    T.StructField("filename", T.StringType()), T.StructField("patch", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("additions", T.IntegerType()),
    T.StructField("deletions", T.IntegerType()),
])

HUNK_TYPE = T.StructType([T.StructField("start", T.IntegerType()),
                          T.StructField("length", T.IntegerType())])

FINDING_SCHEMA = T.StructType([
    T.StructField("line", T.IntegerType()), T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("issue", T.StringType()),
    T.StructField("suggestion", T.StringType()), T.StructField("code_fix", T.StringType()),
])

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("feedback_id", T.LongType()), T.StructField("review_id", T.LongType()),
    T.StructField("accepted", T.IntegerType()), T.StructField("ts", T.TimestampType()),
])
