"""Built-in detector bank and the small dimensions that every stage shares."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    op: str
    display_name: str
    type: str
    severity: str
    regex: str
    confidence: float
    ignore_case: bool = False
    validator: str | None = None
    #: A cheap pattern that every match contains; looked for before the pattern runs.
    needs: str | None = None


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"

# Names, types, severities, patterns and confidences of the bank.
BANK = [
    Pattern("detect_ssn", "Social Security Number", "ssn", "critical", r"\m\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\M", 0.95, validator="ssn", needs=r"[0-9]{3}[-.\s]?[0-9]{2}[-.\s]?[0-9]{4}"),
    Pattern("detect_credit_card", "Credit Card Number", "credit_card", "critical", r"\m(?:4[0-9]{3}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|5[1-5][0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|3[47][0-9]{2}[-\s]?[0-9]{6}[-\s]?[0-9]{5}|6(?:011|5[0-9]{2})[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4})\M", 0.9, validator="luhn", needs=r"[3456][0-9]{3}[-\s]?[0-9]{4}"),
    Pattern("detect_aws_key", "Passwords & Credentials", "aws_key", "critical", r"\m(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\M", 0.98, validator="aws", needs="A(?:KI|BI|CC|SI)A[0-9A-Z]{16}"),
    Pattern("detect_sk_key", "Passwords & Credentials", "api_key", "high", r"\msk-[A-Za-z0-9]{20,}\M", 0.95, needs="sk-[A-Za-z0-9]"),
    Pattern("detect_api_key_assign", "Passwords & Credentials", "api_key", "high", r"""(?:api[_-]?key|apikey|api[_-]?secret|apisecret)\s*[=:"']\s*[A-Za-z0-9_\-]{20,64}""", 0.8, True, needs=r"""[=:"']\s*[A-Za-z0-9_\-]{20}"""),
    Pattern("detect_private_key", "Passwords & Credentials", "private_key", "critical", r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+|ENCRYPTED\s+|PGP\s+)?PRIVATE\s+KEY(?:\s+BLOCK)?-----", 0.99, needs="-----BEGIN"),
    Pattern("detect_github_token", "Passwords & Credentials", "api_key", "high", r"\m(?:ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59})\M", 0.99, needs="(?:ghp|github_pat)_"),
    Pattern("detect_email", "Personal Email Address", "email", "low", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\M", 0.99, needs="@"),
    Pattern("detect_aws_secret", "Passwords & Credentials", "aws_secret", "critical", r"""(?:aws_secret_access_key|secret_access_key|SecretAccessKey)\s*[=:"']\s*["']*[A-Za-z0-9/+=]{20,50}""", 0.85, True, needs=r"""[=:"']\s*["']*[A-Za-z0-9/+=]{20}"""),
    Pattern("detect_stripe", "Passwords & Credentials", "api_key", "high", r"\m(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}\M", 0.99, needs="[spr]k_(?:live|test)_"),
    Pattern("detect_bearer", "Passwords & Credentials", "api_key", "high", r"[Bb]earer\s+[A-Za-z0-9_\-.]{20,}", 0.85, needs="[Bb]earer"),
    Pattern("detect_slack", "Passwords & Credentials", "api_key", "high", r"\mxox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9\-]*\b", 0.98, needs="xox[baprs]-"),
    Pattern("detect_phone", "Personal Phone Number", "phone", "medium", r"\b\+?1?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\M", 0.85, needs=r"[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}"),
    Pattern("detect_ipv4", "IP Address", "ip_address", "medium", rf"\m(?:{_OCTET}\.){{3}}{_OCTET}\M", 0.90, needs=r"[0-9]\.[0-9]"),
    Pattern("detect_conn_string", "Passwords & Credentials", "connection_string", "critical", r"""(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|mssql)://[^\s'"]+""", 0.95, True, needs="://"),
    Pattern("detect_jwt", "Passwords & Credentials", "jwt", "high", r"\meyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", 0.98, needs="eyJ"),
    Pattern("detect_kv_secret", "Passwords & Credentials", "api_key", "high", r"""(?:password|passwd|secret|token|auth)\s*[=:]\s*["']?[^\s"']{8,64}["']?""", 0.75, True, needs=r"""[=:]\s*["']?[^\s"']{8}"""),
    Pattern("detect_date", "Date of Birth", "date", "medium", rf"\m(?:(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}})\M", 0.70, True, needs=r"[0-9]{4}|[0-9][/-][0-9]"),
]

# Order of severities and actions, and each profile's action by severity.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
ACTION_RANK = {"allow": 0, "warn": 1, "redact": 2, "block": 3}
PROFILES = {
    "personal_protection": {"critical": "block", "high": "redact", "medium": "warn", "low": "allow"},
    "business_standard": {"critical": "block", "high": "block", "medium": "redact", "low": "warn"},
    "strict_compliance": {"critical": "block", "high": "block", "medium": "block", "low": "redact"},
    "monitor_only": {"critical": "warn", "high": "warn", "medium": "warn", "low": "warn"},
}
BOOST = 0.02
