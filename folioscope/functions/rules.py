"""Declarative style rules compiled to Column expressions, and their check before use."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import rule_data as D

LEVELS = ("error", "warning", "suggestion")
KINDS = ("existence", "substitution", "occurrence", "conditional", "capitalization")
SCOPES = ("text", "heading", "heading.h1", "heading.h2", "heading.h3", "heading.h4", "heading.h5", "heading.h6", "table.cell", "sentence", "raw")


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    level: str
    scope: str = "text"
    ignorecase: bool = False
    nonword: bool = False
    tokens: tuple[str, ...] = ()
    swap: dict[str, str] = field(default_factory=dict, hash=False)
    exceptions: tuple[str, ...] = ()
    most: int = 0

    def pattern(self) -> str:
        """All tokens or keys as one alternation, between word boundaries unless the rule says otherwise."""
        inside = "|".join(self.tokens or self.swap)
        return ("(?i)" if self.ignorecase else "") + (f"(?:{inside})" if self.nonword else rf"\b(?:{inside})\b")

    def replacement(self, found: Column) -> Column:
        """What a substitution rule wants instead of a match: the value of the first key that matches it whole."""
        flag, out = "(?i)" if self.ignorecase else "", F.lit(None).cast("string")
        for key, value in reversed(self.swap.items()):
            whole = f"{flag}^(?:{key})$"
            out = F.when(found.rlike(whole), F.regexp_replace(found, whole, value) if "$" in value else F.lit(value)).otherwise(out)
        return out


def rules(vocabulary: list[str] | None = None, brand_terms: dict[str, str] | None = None, legacy_hosts: list[str] | None = None) -> list[Rule]:
    """The rule package. `vocabulary` exempts names in headings and, if 3 to 5 capitals, acronyms; `brand_terms` adds to ProductTerms; `legacy_hosts` makes LegacyHost."""
    words = list(D.VOCABULARY if vocabulary is None else vocabulary)
    out = [Rule(n, "existence", level, scope, flag == "ignorecase", flag == "nonword", tuple(t)) for n, (level, scope, flag, t) in D.EXISTENCE.items()]
    for n, (level, scope, flag, swap) in D.SUBSTITUTION.items():
        swap = {**(brand_terms or {}), **swap} if n == "ProductTerms" else swap
        out.append(Rule(n, "substitution", level, scope, flag == "ignorecase", flag == "nonword", swap=swap))
    if legacy_hosts:
        out.append(Rule("LegacyHost", "existence", D.LEGACY_HOST_LEVEL, "text", nonword=True, tokens=tuple(h.replace(".", r"\.") for h in legacy_hosts)))
    level, most, token = D.SENTENCE_LENGTH
    out.append(Rule("SentenceLength", "occurrence", level, "sentence", tokens=(token,), most=most))
    out.append(Rule("Acronyms", "conditional", D.ACRONYM[0], "text", tokens=D.ACRONYM[1:], exceptions=tuple(w for w in words if w.isalpha() and w.isupper() and 3 <= len(w) <= 5)))
    for n, (level, style) in D.HEADING_CASE.items():
        out.append(Rule(n, "capitalization", level, "heading.h1" if style == "title" else "heading", tokens=(style,), exceptions=tuple(words)))
    return out


def catalog(package: list[Rule]) -> list[tuple]:
    """(name, kind, level, scope, number of patterns, whether a replacement needs no judgement) of each rule, by name."""
    from folioscope.functions.fix_data import NOT_AUTOMATABLE

    return sorted((r.name, r.kind, r.level, r.scope, len(r.tokens or r.swap), r.name not in NOT_AUTOMATABLE) for r in package)


def vocabulary_lines(lines: list[str]) -> list[str]:
    """Accepted names of a vocabulary file: no comments, once each, sorted without regard to case."""
    return sorted({x.strip() for x in lines if x.strip() and not x.strip().startswith("#")}, key=str.casefold)


def preflight(config: dict) -> list[str]:
    """What is wrong with a rule as read from a file: missing or unknown kind, level, scope; values that are no strings (a bare Yes)."""
    name, wrong = config.get("name", "?"), []
    if config.get("extends") not in KINDS:
        wrong.append(f"{name}: extends is {config.get('extends')!r}, not one of {', '.join(KINDS)}")
    if config.get("level") not in LEVELS:
        wrong.append(f"{name}: level is {config.get('level')!r}")
    scopes = config.get("scope") or ["text"]
    for scope in [scopes] if isinstance(scopes, str) else scopes:
        if scope not in SCOPES:
            wrong.append(f"{name}: scope {scope!r} is unknown")
    for key in ("tokens", "exceptions"):
        wrong += [f"{name}: {key} has {v!r}, which is no string" for v in config.get(key) or [] if not isinstance(v, str)]
    wrong += [f"{name}: swap has {k!r}: {v!r}, not two strings" for k, v in (config.get("swap") or {}).items() if not (isinstance(k, str) and isinstance(v, str))]
    return wrong
