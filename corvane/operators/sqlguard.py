"""What SQL may run against a store: one read-only statement that leaves raw events alone."""

from __future__ import annotations

import re


class Refused(ValueError):
    """A statement that isn't allowed."""


def checked(sql: str) -> str:
    """The statement, stripped, if it starts with SELECT or WITH and doesn't name security_events."""
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", text):
        raise Refused("only SELECT and WITH statements are allowed")
    if re.search(r"(?i)\bsecurity_events\b", text):
        raise Refused("security_events can't be queried")
    if ";" in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", "", text):
        raise Refused("one statement at a time")
    return text
