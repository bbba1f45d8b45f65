"""The ordered credential detectors, and the column tests that let clean text skip them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesieve.functions.text import sql_string

# Detector regexes, types and severities. The order is part of the contract:
# each detector runs on the text the previous ones have already rewritten.
DETECTOR_TABLE = [
    (r"sk-proj-[A-Za-z0-9_\-]{20,}", "OPENAI_PROJECT_KEY", "critical"),
    (r"sk-[A-Za-z0-9_\-]{20,}", "OPENAI_KEY", "critical"),
    (r"pk-[A-Za-z0-9_\-]{20,}", "PUBLIC_KEY", "high"),
    (r"ant-[A-Za-z0-9]{20,}", "ANTHROPIC_KEY", "critical"),
    (r"AKIA[0-9A-Z]{16}", "AWS_ACCESS_KEY", "critical"),
    (r"gh[pousr]_[A-Za-z0-9_]{36,}", "GITHUB_TOKEN", "critical"),
    (r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*", "SLACK_TOKEN", "critical"),
    (r"AIza[0-9A-Za-z_-]{35}", "GOOGLE_API_KEY", "critical"),
    (r"ya29\.[0-9A-Za-z_-]+", "GOOGLE_OAUTH", "critical"),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "JWT_TOKEN", "high"),
    (r"npm_[A-Za-z0-9]{36}", "NPM_TOKEN", "critical"),
    (r"glpat-[A-Za-z0-9_\-]{20,}", "GITLAB_TOKEN", "critical"),
    (r"dckr_pat_[A-Za-z0-9_\-]{20,}", "DOCKER_TOKEN", "critical"),
    (r"gho_[A-Za-z0-9]{36}", "GITHUB_OAUTH", "critical"),
    (r"[A-Za-z0-9]{32}\.[A-Za-z0-9]{16}\.[A-Za-z0-9]{20,}", "GENERIC_API_KEY", "high"),
    (r"postgres(ql)?://[^\s\"']{10,}", "DATABASE_URL", "critical"),
    (r"mongodb(\+srv)?://[^\s\"']{10,}", "DATABASE_URL", "critical"),
    (r"https?://[^\s\"']*:[^\s\"'@]+@[^\s\"']+", "URL_WITH_CREDENTIALS", "high"),
]

# For each detector, substrings every match must contain: a list of alternatives, each a
# list of substrings that must all be present. Searching bytes for a substring is far
# cheaper than decoding the text and running a regex over it.
_REQUIRED = [
    [["sk-proj-"]],
    [["sk-"]],
    [["pk-"]],
    [["ant-"]],
    [["AKIA"]],
    [["ghp_"], ["gho_"], ["ghu_"], ["ghs_"], ["ghr_"]],
    [["xox"]],
    [["AIza"]],
    [["ya29."]],
    [["eyJ"]],
    [["npm_"]],
    [["glpat-"]],
    [["dckr_pat_"]],
    [["gho_"]],
    None,
    [["postgres"]],
    [["mongodb"]],
    [["://", "@"]],
]

# Two detectors would try every start in a long run of text and scan the rest of the run each time.
# For them Spark gets an equivalent form that reads a text once: ``skip`` consumes, without going
# back, what no match can start in, whole runs that fail included, and ``match`` is what is replaced.
# If a run fails from its first start it fails from all later ones, as each needs what follows it.
_JWT_TAIL = r"[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
_URL_TAIL = r"(?:[^\s\"'@:]*+:?+@)*+[^\s\"'@:]*+:[^\s\"'@]++@[^\s\"']++"
_ONE_PASS = {
    9: (rf"[^e]++|e(?!yJ)|eyJ(?!{_JWT_TAIL})[A-Za-z0-9_-]*+", f"eyJ{_JWT_TAIL}"),
    17: (rf"[^h]++|h(?!ttps?://)|https?://(?!{_URL_TAIL})[^\s\"']*+", f"https?://{_URL_TAIL}"),
}

# The generic key has no fixed text beyond dots. This middle part starts at a literal dot,
# so it is found without trying every letter as a start.
_GENERIC_MIDDLE = r"\.[A-Za-z0-9]{16}\."


@dataclass(frozen=True)
class Detector:
    """One detector. Its methods give SQL text for a text expression ``t``."""

    index: int
    regex: str
    kind: str
    severity: str

    @property
    def replacement(self) -> str:
        return f"[REDACTED:{self.kind}]"

    def may_match(self, t: str) -> str:
        """False only when the detector cannot match."""
        required = _REQUIRED[self.index]
        if required is None:
            return f"({t} RLIKE {sql_string(_GENERIC_MIDDLE)})"
        groups = [" AND ".join(f"contains({t}, '{s}')" for s in group) for group in required]
        return "(" + " OR ".join(groups) + ")"

    @property
    def _one_pass(self) -> str | None:
        """What lies before a match as group 1, the match as group 2."""
        if self.index not in _ONE_PASS:
            return None
        skip, match = _ONE_PASS[self.index]
        return sql_string(rf"\G((?:{skip})*+)({match})")

    def replace_in(self, t: str) -> str:
        if self._one_pass:
            return f"regexp_replace({t}, {self._one_pass}, '$1{self.replacement}')"
        return f"regexp_replace({t}, {sql_string(self.regex)}, '{self.replacement}')"

    def matches_in(self, t: str) -> str:
        if self._one_pass:
            return f"regexp_extract_all({t}, {self._one_pass}, 2)"
        return f"regexp_extract_all({t}, {sql_string(self.regex)}, 0)"


DETECTORS = [Detector(i, *row) for i, row in enumerate(DETECTOR_TABLE)]


EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
# The same addresses, found in one pass: an address starts where the run of its characters does or
# the last one ended, and its domain is read label by label, up to the last that can end it.
_OTHER_LABELS = r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9\-]++)*+"
EMAIL_ONE_PASS = (
    r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++"
    rf"(?:{_OTHER_LABELS}\.[A-Za-z]{{2,}}+(?:[A-Za-z0-9\-]*+(?={_OTHER_LABELS}\.[A-Za-z]{{2}}))?+)++"
)
KEY_VALUE = (
    r"((?i:api[_-]?key|secret|token|password|passwd)\w*[ \t]*[=:][ \t]*[\"']?)"
    r"([^\s\"'\[,;]{8,})"
)


@dataclass(frozen=True)
class ExtraRule:
    """A rule that runs after all detectors where it is asked for by name. What precedes the matched
    ``group`` stays."""

    name: str
    index: int
    regex: str
    kind: str
    severity: str
    gate: str
    before: str = ""
    group: int = 0

    @property
    def replacement(self) -> str:
        return f"[REDACTED:{self.kind}]"

    def may_match(self, t: str) -> str:
        return "(" + " OR ".join(f"contains(lower({t}), '{word}')" for word in self.gate.split()) + ")"

    def replace_in(self, t: str) -> str:
        return f"regexp_replace({t}, {sql_string(self.regex)}, '{self.before}{self.replacement}')"

    def matches_in(self, t: str) -> str:
        return f"regexp_extract_all({t}, {sql_string(self.regex)}, {self.group})"


_AFTER = len(DETECTORS)
EXTRA_RULES = {
    rule.name: rule
    for rule in (
        ExtraRule("email", _AFTER, EMAIL_ONE_PASS, "EMAIL", "medium", "@"),
        ExtraRule("key_value", _AFTER + 1, KEY_VALUE, "KEY_VALUE", "high", "key secret token passw", "$1", 2),
    )
}


def chosen_rules(extra: Iterable[str]) -> list:
    """All detectors, then the extra rules of these names in their fixed order."""
    extra = set(extra)
    if unknown := extra - set(EXTRA_RULES):
        raise ValueError(f"no such rules: {sorted(unknown)}")
    return [*DETECTORS, *(rule for name, rule in EXTRA_RULES.items() if name in extra)]


def any_may_match(t: str, extra: Iterable[str] = ()) -> str:
    """SQL text that is false only when no detector can match ``t``, whatever the others
    rewrote before.

    Placeholders put in by earlier detectors hold none of the required substrings, so
    testing the original text is enough.
    """
    return "(" + " OR ".join(d.may_match(t) for d in chosen_rules(extra)) + ")"


def detector_info() -> Column:
    """Constant array of (detector, severity, replacement), by detector index."""
    rules = chosen_rules(EXTRA_RULES)
    rows = ", ".join(f"('{d.kind}', '{d.severity}', '{d.replacement}')" for d in rules)
    return F.expr(
        f"CAST(array({rows}) AS ARRAY<STRUCT<detector: STRING, severity: STRING, replacement: STRING>>)"
    )
