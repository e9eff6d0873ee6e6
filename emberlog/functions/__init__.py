"""Column -> Column building blocks."""

from .levels import (  # noqa: F401
    infer_level,
    is_error,
    is_warning,
    level_from_message,
    level_from_status,
    level_rank,
    map_level,
    status_category,
    syslog_priority,
)
from .privacy import cap_length, redact_pii, token_estimate, wrap_markers  # noqa: F401
from .rates import activity_class, error_rate, parse_success_rate, pct, rate_class, share_of_max  # noqa: F401
from .text import (  # noqa: F401
    as_array,
    base_name,
    category_title,
    ellipsize,
    escape_text,
    is_blank,
    request_id,
    strip,
)
from .times import bucket_label, cloud_stamp, cloud_ts, iso_text, span_text, utc_wall_clock  # noqa: F401
from .variants import first_present  # noqa: F401
