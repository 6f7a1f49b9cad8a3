"""Row types of the raw records and the fixed value sets of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("batch", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("subindustry", T.StringType()),
    T.StructField("all_locations", T.StringType()),
    T.StructField("regions", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("team_size", T.StringType()),
    T.StructField("launched_at", T.LongType()),
    T.StructField("one_liner", T.StringType()),
    T.StructField("long_description", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("isHiring", T.BooleanType()),
    T.StructField("nonprofit", T.BooleanType()),
    T.StructField("top_company", T.BooleanType()),
])

# Every raw record must carry these keys.
REQUIRED_FIELDS = tuple(f.name for f in RAW_SCHEMA.fields)

# Outcome labels and the two that count as operating.
KNOWN_STATUSES = ("Active", "Inactive", "Acquired", "Public")
OPERATING_STATUSES = ("Active", "Public")
UNKNOWN = "Unknown"
UNSPECIFIED = "Unspecified"

# Columns of the cleaned table, in order.
CLEAN_COLUMNS = (
    "company_id", "slug", "name", "website", "one_liner", "long_description", "profile_url", "stage",
    "status", "is_operating", "industry", "subindustry",
    "batch", "batch_season", "batch_year", "batch_code", "batch_start", "batch_order",
    "team_size", "team_size_outlier", "launched_at",
    "is_hiring", "is_nonprofit", "is_top_company", "tags", "regions",
    "all_locations", "location_entries", "primary_city", "primary_region", "primary_country",
    "location_count", "is_remote",
)

# Columns that feature building adds.
FEATURE_COLUMNS = (
    "ai_tag", "ai_keyword", "is_ai", "batch_status", "years_since_batch", "tag_count",
    "team_size_bucket", "description_length",
)
