"""Secrets and personal data in source text: detectors, scrubbing, and the policy that drops a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: category: (pattern, scrubbed). Original detectors; those not scrubbed are only reported. None looks around, so every engine agrees.
DETECTORS: dict[str, tuple[str, bool]] = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]", True),
    "phone": (r"\+[0-9][0-9 ().-]{6,}[0-9]", True),
    "cloud_key": (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", True),
    "token": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", True),
    "credential": (r"(?i)\b(?:password|passwd|secret|api_?key|access_?token)\b\s*[:=]\s*['\"]?[A-Za-z0-9/+_.-]{8,}", True),
    "ip": (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", True),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False),
    "license_line": (r"(?i)copyright \(c\)|all rights reserved", False),
}
#: Categories that count as credentials.
CREDENTIALS = ["cloud_key", "token", "credential"]
MOST_CREDENTIALS, MOST_SCRUBBED = 3, 100


def hits(text: Column, category: str) -> Column:
    return F.regexp_count(text, F.lit(DETECTORS[category][0]))


def scrub(text: Column) -> Column:
    """Text with every scrubbed category replaced by its name in angle brackets."""
    out = text
    for name, (pattern, scrubbed) in DETECTORS.items():
        if scrubbed:
            out = F.regexp_replace(out, pattern, f"<{name.upper()}>")
    return out


def drop_reason(counts: dict[str, Column]) -> Column:
    """Why a file is dropped, or null: a private key, several credentials, or so many matches that it is data."""
    add = lambda names: sum((counts[n] for n in names), F.lit(0))
    return (
        F.when(counts["private_key"] > 0, "private_key").when(add(CREDENTIALS) >= MOST_CREDENTIALS, "credential_hits")
        .when(add([n for n, d in DETECTORS.items() if d[1]]) >= MOST_SCRUBBED, "data_file")
    )


def histogram_bucket(n: Column) -> Column:
    return F.when(n >= 100, "100+").when(n >= 50, "50-99").when(n >= 10, "10-49").when(n >= 5, "5-9").when(n >= 2, "2-4").when(n == 1, "1")


def test_path(path: Column, language: str) -> Column:
    """Whether a path belongs to tests, by the habits of the language."""
    if language == "go":
        return path.endswith("_test.go")
    return path.rlike(r"(?<![A-Za-z])[Tt]ests?(?![a-z])") | path.rlike(r"(?<=[a-z])Tests?(?![a-z])")
