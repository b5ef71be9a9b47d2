"""Names, defaults and fixed values shared by the operators."""

from __future__ import annotations

# HTTP methods in search and one-hot order.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")

# Methods reported as uncommon in an explanation.
UNCOMMON_METHODS = ("DELETE", "PUT", "PATCH")

# Default attack tokens, searched literally and case-insensitively.
SUSPICIOUS_PATTERNS = (
    "../",
    "select",
    "union",
    "drop",
    "<script>",
    "eval(",
    "exec(",
    "/etc/passwd",
    "cmd.exe",
)

# Attack family of each token above; the extra tokens a caller adds belong to none.
ATTACK_CATEGORIES = {
    "path_traversal": ("../", "/etc/passwd"),
    "sql_injection": ("select", "union", "drop"),
    "xss": ("<script>",),
    "command_injection": ("eval(", "exec(", "cmd.exe"),
}

# Feature groups in vector order, each with its column names.
FEATURE_GROUPS = {
    "template_id": ("template_id",),
    "status_code_category": ("status_2xx", "status_4xx", "status_5xx"),
    "path_length": ("path_length",),
    "suspicious_tokens": ("suspicious_score",),
    "http_method": tuple(f"method_{m}" for m in METHODS),
    "time_features": ("hour", "weekday"),
    "ip_statistics": ("ip_frequency", "ip_path_diversity", "ip_request_rate"),
    "user_agent_hash": ("user_agent_hash",),
}

DEFAULT_FEATURES = tuple(FEATURE_GROUPS)

PARSED_COLUMNS = (
    "parse_kind",
    "event_us",
    "event_ts",
    "wall_ts",
    "zone",
    "ip",
    "user",
    "method",
    "path",
    "protocol",
    "status",
    "size",
    "referrer",
    "user_agent",
    "raw",
)


def feature_names(enabled=DEFAULT_FEATURES) -> list[str]:
    """Vector column names for the enabled groups, always in the fixed group order."""
    unknown = set(enabled) - set(FEATURE_GROUPS)
    if unknown:
        raise ValueError(f"unknown feature groups: {sorted(unknown)}")
    return [c for group, cols in FEATURE_GROUPS.items() if group in enabled for c in cols]
