"""Error and data-quality triage.

Pure column logic: a ``when`` chain over error name / message text, a literal
map for suggestions, and arrays of recommendation texts.  Grouped counts are
ordinary aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

# --- fixed values: error class names and messages per error code -------------
ERROR_CLASS = {
    K.ERROR_AUTH: ("AuthenticationError", "Authentication failed: HTTP request failed"),
    K.ERROR_RATE_LIMIT: ("RateLimitError", "Rate limit exceeded"),
    K.ERROR_API: ("ApiError", "HTTP request failed"),
    K.ERROR_TIMEOUT: ("TimeoutError", "Operation 'network_request' timed out after 0ms"),
    K.ERROR_NETWORK: ("NetworkError", "Network error: Connection refused"),
    K.ERROR_GRAPHQL: ("GraphQLError", "GraphQL error"),
}


def error_name_message(code: Column, retry_after_s: Column | None = None):
    """Error class name and message text for a delivery error code."""
    name = F.lit(None).cast("string")
    msg = F.lit(None).cast("string")
    for c, (n, m) in ERROR_CLASS.items():
        name = F.when(code == c, F.lit(n)).otherwise(name)
        text = F.lit(m)
        if c == K.ERROR_RATE_LIMIT and retry_after_s is not None:
            text = F.when(
                retry_after_s.isNotNull(),
                F.concat(F.lit("Rate limit exceeded. Retry after "), retry_after_s.cast("string"), F.lit(" seconds")),
            ).otherwise(F.lit(m))
        msg = F.when(code == c, text).otherwise(msg)
    return name, msg


def error_category(name: Column, message: Column) -> Column:
    """G1: first matching category, case-sensitive; ``unknown_error`` otherwise."""
    n, m = F.coalesce(name, F.lit("")), F.coalesce(message, F.lit(""))
    out = None
    for cat, in_name, in_msg in K.ERROR_CATEGORIES:
        cond = n.contains(in_name) | m.contains(in_msg)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out.otherwise(F.lit(K.UNKNOWN_ERROR))


def recovery_suggestion(category: Column) -> Column:
    """Fixed text per category (literal map lookup, unknown -> the unknown text)."""
    pairs = []
    for k, v in K.RECOVERY_SUGGESTIONS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(K.RECOVERY_SUGGESTIONS[K.UNKNOWN_ERROR]))


def categorize_errors(df: DataFrame, name_col: str = "error_name", message_col: str = "error_message") -> DataFrame:
    """G1+G2: per category, number of errors and the suggestion."""
    c = df.withColumn("category", error_category(F.col(name_col), F.col(message_col)))
    return c.groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("errors")).withColumn(
        "suggestion", recovery_suggestion(F.col("category"))
    )


def severity_level(severity: Column) -> Column:
    """Low -> debug, medium -> warn, high/critical -> error, else warn."""
    out = None
    for s, lvl in K.SEVERITY_LEVELS.items():
        out = F.when(severity == s, F.lit(lvl)) if out is None else out.when(severity == s, F.lit(lvl))
    return out.otherwise(F.lit("warn"))


def quality_recommendations(issue: Column, severity: Column) -> Column:
    """Recommendation texts for an issue, in fixed order."""
    parts = []
    for needle, texts in K.QUALITY_RECOMMENDATIONS:
        parts.append(F.when(issue.contains(needle), F.array(*[F.lit(t) for t in texts])).otherwise(F.array()))
    parts.append(F.when(severity == "critical", F.array(F.lit(K.CRITICAL_RECOMMENDATION))).otherwise(F.array()))
    return F.concat(*parts)


def quality_issues(df: DataFrame, issue_col: str = "issue", severity_col: str = "severity") -> DataFrame:
    """G3 per distinct (issue, severity): occurrences, log level, recommendations joined by '; '."""
    g = df.groupBy(F.col(issue_col).alias("issue"), F.col(severity_col).alias("severity")).agg(
        F.count(F.lit(1)).cast("bigint").alias("occurrences")
    )
    return g.select(
        "issue",
        "severity",
        "occurrences",
        severity_level(F.col("severity")).alias("level"),
        F.array_join(quality_recommendations(F.col("issue"), F.col("severity")), "; ").alias("recommendations"),
    )


def finding_severity(severity: Column) -> Column:
    """Map finding severity to a quality-issue severity: error -> high, warning -> medium."""
    return F.when(severity == "error", F.lit("high")).otherwise(F.lit("medium"))
