"""Columns that label graph nodes, edges and evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracewright.functions.paths import first_of

# Names, patterns, ranks and their order decide results and are stated as they are.
SUBSYSTEMS = (
    ("Identity and access", r"auth|session|login|permission|policy|guard"),
    ("Frontend", r"component|hook|frontend|view|template|\.tsx|\.jsx|\.vue|\.svelte"),
    ("API and routing", r"route|controller|middleware|api|server.action|webhook|resolver"),
    ("Data", r"table|model|schema|column|migration|database|repository"),
    ("Integrations", r"external.service|service:|client|integration|stripe|supabase|firebase|openai"),
    ("Configuration", r"environment|config|deployment|docker|vercel|cloudflare"),
)
ARCHITECTURES = {"Frontend": "Interface", "Data": "Data layer", "Integrations": "External systems", "Configuration": "Operations"}
FEATURES = (
    ("Authentication", r"login|sign.?in|register|auth|session"),
    ("Payments", r"checkout|payment|stripe|billing|invoice"),
    ("Uploads", r"upload|file|storage|attachment"),
    ("Search", r"search|query|filter"),
    ("Administration", r"admin|dashboard|manage"),
    ("Notifications", r"notification|email|message"),
    ("API", r"route|controller|api|webhook"),
    ("Data", r"table|model|schema|database"),
)
RISKS = (("high", r"auth|password|session|secret|process|exec|delete|unlink|payment|webhook"), ("medium", r"route|controller|table|model|schema|environment|external.service|upload|write"))
EDGE_KINDS = (("data", r"table|read|write|create|update|delete|persist"), ("request", r"http|route|request|response|middleware|handler"), ("external", r"service|external|provider|client"))
SEMANTIC_PRIORITY = {"security": 6, "external": 5, "data": 4, "request": 3, "service": 2, "interface": 1, "code": 0}
ENGINE_RANKS = {
    "typescript-semantic": 100, "php-parser": 96, "tree-sitter": 88, "framework-adapter": 84, "ast-grep": 72, "native": 66, "ctags": 52,
    "ripgrep": 30, "gitleaks": 90, "semgrep": 90, "osv-scanner": 90, "syft": 76, "grype": 84,
}
CONFIDENCES = ("low", "medium", "high")
LABELS = ("heuristic", "likely", "strong", "confirmed")
SEVERITIES = ("info", "attention", "risk")
PACKAGE_CLASSES = ("detected", "declared", "resolved")


def rank_in(names, column: Column) -> Column:
    """Place of a name in an ascending order, from 1; 0 if it is not there."""
    return F.array_position(F.array(*map(F.lit, names)), column).cast("int")


def name_at(names, rank: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), rank.cast("int"))


def subsystem(kind: Column, path: Column, role: Column) -> Column:
    signal = F.lower(F.concat_ws(" ", kind, path, role))
    return first_of([(n, signal.rlike(p)) for n, p in SUBSYSTEMS], "Application core")


def architecture(subsystem_: Column) -> Column:
    return first_of([(to, subsystem_ == of) for of, to in ARCHITECTURES.items()], "Application")


def feature(name: Column, path: Column, kind: Column) -> Column:
    signal = F.lower(F.concat_ws(" ", name, path, kind))
    return first_of([(n, signal.rlike(p)) for n, p in FEATURES], "Core behavior")


def risk(kind: Column, name: Column, path: Column) -> Column:
    signal = F.lower(F.concat_ws(" ", kind, name, path))
    return first_of([(n, signal.rlike(p)) for n, p in RISKS], "low")


def semantic(kind: Column, name: Column, path: Column) -> Column:
    low = F.lower(kind)
    signal = F.lower(F.concat_ws(" ", kind, name, path))
    return first_of(
        [
            ("security", signal.rlike(r"auth|security|permission|policy|guard|session")),
            ("request", low.isin("route", "route_handler", "controller", "middleware", "endpoint", "resolver")),
            ("data", low.isin("table", "model", "schema", "column", "repository")),
            ("external", low == "external_service"),
            ("service", low.isin("service", "provider", "worker", "job", "command")),
            ("interface", low.isin("component", "view", "template", "hook")),
        ],
        "code",
    )


def edge_kind(relationship: Column) -> Column:
    return first_of([(n, F.lower(relationship).rlike(p)) for n, p in EDGE_KINDS], "code")


def overview_kind(kind: Column, key: Column, label: Column) -> Column:
    signal = F.lower(F.concat_ws(" ", kind, key, label))
    rules = (("security", r"auth|identity|security|session|permission"), ("data", r"database|data|model|storage|table|queue"), ("external", r"external|integration|service|provider|api client"), ("interface", r"view|ui|front|client|interface"))
    return first_of([(n, signal.rlike(p)) for n, p in rules], "application")


def engine_rank(engine: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ENGINE_RANKS.items() for x in pair]), engine), F.lit(50))


def evidence_label(engine: Column, confidence: Column, sources: Column, documentation: Column) -> Column:
    """How far one source's fact can be trusted, given how many engines agree."""
    score = engine_rank(engine) + F.when(confidence == "high", 8).when(confidence == "low", -12).otherwise(0)
    return F.when(documentation, "heuristic").when((sources > 1) & (confidence != "low"), "confirmed").when(score >= 76, "strong").when(score >= 48, "likely").otherwise("heuristic")


def vendor_severity(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin("critical", "high", "error"), "risk").when(low.isin("medium", "moderate", "warning"), "attention").otherwise("info")
