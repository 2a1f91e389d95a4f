"""Redaction of secrets, as one chain of built-in replacements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REDACTED = "[REDACTED]"

# Patterns of secrets, applied in this order.
PRIVATE_KEY = r"(?s)(-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----).*?(-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|\z)"
ASSIGNMENT = (
    r"(?imd)^(\s*(?:export\s+)?[\"']?[\w.\-]*(?:SECRET|TOKEN|PASSWORD|PASSWD|PWD|PRIVATE_KEY|API_KEY|ACCESS_KEY|ACCOUNT_?KEY|CREDENTIAL)"
    r"[\w.\-]*[\"']?\s*[=:]\s*)(\S.*)$"
)
URL_CREDENTIALS = r"://[^/\s@:]+:[^/\s@]*@"
CONNECTION = r"(?i)(\b(?:password|pwd|accountkey|sharedaccesskey)=)[^;\s\"']+"
PROVIDER = (
    r"(?:AKIA|ASIA|ABIA|ACCA|AGPA|AIDA|AIPA|ANPA|ANVA|AROA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,}"
    r"|xox[abposr]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|https://hooks\.slack\.com/services/[A-Za-z0-9/+]{20,}"
    r"|eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}|glpat-[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{36}"
    r"|sk_live_[A-Za-z0-9]{24,}|rk_live_[A-Za-z0-9]{24,}|sk-ant-[A-Za-z0-9_\-]{20,}|sk-proj-[A-Za-z0-9_\-]{20,}"
)
OPAQUE = r"(?<=[\"'])(?=[A-Za-z0-9_\-]*[A-Za-z])(?=[A-Za-z0-9_\-]*[0-9])[A-Za-z0-9_\-]{32,}(?=[\"'])"


def redact(text: Column) -> Column:
    out = F.regexp_replace(text, PRIVATE_KEY, f"$1\n{REDACTED}\n$2")
    out = F.regexp_replace(out, ASSIGNMENT, f"$1{REDACTED}")
    out = F.regexp_replace(out, URL_CREDENTIALS, f"://{REDACTED}@")
    out = F.regexp_replace(out, CONNECTION, f"$1{REDACTED}")
    out = F.regexp_replace(out, PROVIDER, REDACTED)
    return F.regexp_replace(out, OPAQUE, REDACTED)
