"""Which chunks must not be embedded: ordered secret rules, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RULES: tuple[tuple[str, str], ...] = (
    ("likely_private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("likely_access_token", r"\b(ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})"),
    ("likely_connection_string", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@"),
    ("likely_credential_assignment", r"(?i)(api_?key|secret|token|password|passwd)[A-Za-z0-9_]*[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_=]{16,}"),
)


def exclusion_reason(text: Column) -> Column:
    """Name of the first rule that matches, or null."""
    out = None
    for name, pattern in RULES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out
