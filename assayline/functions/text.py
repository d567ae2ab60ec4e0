"""Predicates and projections on text as Column expressions (inputs are columns, results are columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rule name and pattern, in the order in which they are tried.
POLICY_RULES: list[tuple[str, str]] = [
    ("Resident registration number exposure", r"\b\d{6}-\d{7}\b"),
    ("Korean mobile phone number exposure", r"\b01[016789]-\d{3,4}-\d{4}\b"),
    ("Email address exposure", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("Credit card number exposure", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b"),
    ("Secret-like token exposure", r"(?i)\b(?:api[_-]?key|secret(?:[_-]?key)?|access[_-]?token|refresh[_-]?token|bearer[_-]?token)\b\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{16,}[\"']?"),
]

#: Tokens that make a flag true.
TRUTHY = ("true", "1", "yes", "y", "t", "on", "calib")
#: Tokens that make an expected outcome a failure.
FAILING = ("fail", "failed", "negative", "f")
#: Message parts that mark an error of the system under test.
SYSTEM_ERRORS = ("Adapter Error", "Connection Error", "HTTP 5", "Timeout", "timeout", "Wrapper startup failed")
#: Severities from worst to mildest.
SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
#: Directories and file names of tests.
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs", "e2e", "cypress", "integration", "unit", "functional", "it")
TEST_FILE = r"^test[_-]|(?:_test\.py|_spec\.py|[.\-](?:test|spec)\.(?:ts|js)|\.(?:test|spec)\.(?:tsx|jsx)|_test\.go|_spec\.go|tests?\.java|\.feature)$"
#: Names too common to tell a caller.
GENERIC_NAMES = (
    "len", "range", "list", "dict", "set", "tuple", "str", "int", "float", "bool", "type", "isinstance", "iter",
    "next", "callable", "open", "close", "read", "write", "send", "min", "max", "sum", "abs", "round", "all", "any",
    "print", "input", "format", "repr", "vars", "dir", "id", "hash", "hex", "bin", "oct", "ord", "chr", "bytes",
    "bytearray", "memoryview", "object", "getattr", "setattr", "hasattr", "delattr", "issubclass", "super",
    "enumerate", "zip", "map", "filter", "reduce", "sorted", "reversed", "log", "logger", "logging", "console",
    "push", "pop", "shift", "unshift", "splice", "slice", "concat", "join", "split", "trim", "replace", "match",
    "search", "test", "exec", "indexOf", "lastIndexOf", "includes", "find", "findIndex", "every", "some", "forEach",
    "keys", "values", "entries", "assign", "create", "freeze", "stringify", "parse", "now", "Date", "Math", "JSON",
    "addEventListener", "removeEventListener", "dispatchEvent", "init", "main", "run", "start", "stop", "reset",
    "update", "load", "save", "check", "validate", "render", "build", "get", "has", "put", "add", "remove", "delete",
    "clear", "parseInt", "parseFloat", "isNaN", "isFinite", "Number", "String", "Boolean",
)


def blank_to_null(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUTHY), F.lit(False))


def outcome(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(*FAILING), "fail").otherwise("pass")


def severity_rank(c: Column) -> Column:
    """0 for the worst; unknown and null severities rank 9."""
    up, rank = F.upper(c), F.lit(9)
    for i, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(up == s, i).otherwise(rank)
    return rank


def first_policy_hit(text: Column, rules: list[tuple[str, str]] = POLICY_RULES) -> Column:
    """struct(reason, matched) of the first rule that text breaks, null if none. Of JSON only the values count, not keys."""

    def first(t: Column) -> Column:
        hits = []
        for name, pattern in rules:
            found = F.regexp_extract(t, pattern, 0)
            hits.append(F.when(found != "", F.struct(F.lit(name).alias("reason"), found.alias("matched"))))
        return F.coalesce(*hits)

    # In a one-element array the values are worked out once, however many rules look at them.
    return F.get(F.transform(F.array(json_values(text)), first), F.lit(0))


#: A string of a JSON text, with the colon where it is a key, or another scalar.
_SCALAR = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|-?[0-9][0-9.eE+-]*+|true|false'


def json_values(text: Column) -> Column:
    """The scalar values of a JSON text at any depth, in its order, one a line, without keys and nulls; other texts as
    they are, also those that only begin with a JSON value. Of a key that an object holds twice both values are there."""
    may = text.rlike(r'^\s*+[\[{"0-9tfn-]')

    # The parser stops behind the first value. Only if all of a text is one value does what is put behind it come second.
    def followed_by(end: int) -> Column:
        return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f",{end}]"))), "$[1]", "int") == end

    found = F.filter(F.regexp_extract_all(text, F.lit(_SCALAR), F.lit(0)), lambda x: ~x.endswith(":"))
    values = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>")
    return F.when(may & followed_by(1) & followed_by(2), F.array_join(values, "\n")).otherwise(text)


def is_trivial(code: Column, min_chars: int = 20, min_lines: int = 2) -> Column:
    """Fewer characters than min_chars after trimming, or fewer non-blank lines than min_lines."""
    body = F.regexp_replace(code, r"^\s+|\s+$", "")
    return (F.length(body) < min_chars) | (F.size(F.filter(F.split(body, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")) < min_lines)


def is_test_location(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, TEST_DIRS))) | F.element_at(parts, -1).rlike(TEST_FILE)


def needs_translation(c: Column) -> Column:
    return c.rlike("[一-鿿]") | c.rlike("[A-Za-z]{4,}")


def criteria_mode(c: Column) -> Column:
    """none, dsl or geval."""
    dsl = c.contains("status_code=") | c.contains("raw~r/") | c.contains("json.")
    return F.when(F.coalesce(c, F.lit("")) == "", "none").when(dsl, "dsl").otherwise("geval")


def contains_keyword(criteria: Column) -> Column:
    """The keyword that a 'response must include X' sentence asks for, null if it is none."""
    text = F.trim(criteria)
    quote = "[\"'“”‘’]?"
    patterns = (
        f"응답에\\s*{quote}(.+?){quote}\\s*(?:이|가|을|를)?\\s*포함되어야\\s*함",
        f"응답에\\s*{quote}(.+?){quote}\\s*(?:이|가|을|를)?\\s*포함되어야\\s*합니다",
        "(?i)(?:response|output)\\s+must\\s+include\\s+[\"']?(.+?)[\"']?$",
    )
    return F.coalesce(*(blank_to_null(F.regexp_extract(text, p, 1)) for p in patterns))


def squeezed(c: Column) -> Column:
    """Lower case without white space, for comparing."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def criteria_contains(criteria: Column, actual: Column) -> Column:
    """Whether the asked keyword is in the answer; null where criteria ask for none."""
    word = squeezed(contains_keyword(criteria))
    return F.when(word != "", squeezed(actual).contains(word))


def error_class(status: Column, explicit: Column, message: Column) -> Column:
    """system or quality for failed turns, '' for others."""
    hit = F.lit(False)
    for part in SYSTEM_ERRORS:
        hit = hit | F.coalesce(message, F.lit("")).contains(part)
    given = F.lower(F.coalesce(explicit, F.lit("")))
    return F.when(F.coalesce(status, F.lit("")) != "failed", "").when(given.isin("system", "quality"), given).when(hit, "system").otherwise("quality")


def failure_reason(message: Column, task_passed: Column) -> Column:
    """One of seven reasons, by the first part of the message that matches."""
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(m.contains("Promptfoo policy checks reported") | m.contains("정책 검사"), "policy")
        .when(m.contains("Format Compliance Failed") | m.contains("응답 형식"), "format")
        .when(m.contains("Adapter Error") | m.contains("Connection Error"), "connection")
        .when(m.contains("TaskCompletion failed") | F.coalesce(~task_passed, F.lit(False)), "task")
        .when(m.contains("AnswerRelevancyMetric") | m.contains("답변 관련성"), "relevancy")
        .when(m.contains("Metrics failed") | m.contains("지표 평가 실패"), "metric")
        .otherwise("other")
    )


def action_verdict(severity: Column, classification: Column, confidence: Column, cited: Column, used: Column) -> Column:
    """What to do with an issue, from severity, judgement and how well the judgement is grounded."""
    sev, cls, conf = F.upper(F.coalesce(severity, F.lit(""))), F.lower(F.coalesce(classification, F.lit(""))), F.lower(F.coalesce(confidence, F.lit("")))
    weak = ((used == 0) | ((cited == 0) & conf.isin("low", ""))) & (cls != "false_positive")
    return (
        F.when((cls == "false_positive") & (conf == "high"), "false_positive_sure")
        .when(cls == "false_positive", "false_positive")
        .when(cls == "wont_fix", "ignore")
        .when(sev.isin("BLOCKER", "CRITICAL") & weak, "fix_now_weak_basis")
        .when(sev.isin("BLOCKER", "CRITICAL"), "fix_now")
        .when((sev == "MAJOR") & weak, "review_weak_basis")
        .when(sev == "MAJOR", "review")
        .when(sev.isin("MINOR", "INFO"), "later")
        .otherwise("triage")
    )


def head_tail(c: Column, limit: int, head: float = 0.7) -> Column:
    """Text cut to limit characters: its beginning and its end around a mark."""
    mark = "\n...\n"
    first = int((limit - len(mark)) * head)
    last = limit - len(mark) - first
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, first), F.lit(mark), F.right(c, F.lit(last))))


def strip_html(c: Column) -> Column:
    """Text without tags, with the common character references decoded and blanks squeezed."""
    out = F.regexp_replace(c, r"<[^>]+>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def first_paragraph(c: Column, width: int = 200) -> Column:
    """The first paragraph with text that is no heading between double asterisks, blanks squeezed, cut to width; '' if none."""
    paragraphs = F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)[\s\x1c-\x1f]+", " ")))
    kept = F.filter(paragraphs, lambda p: (p != "") & ~(p.startswith("**") & p.endswith("**")))
    return F.coalesce(F.substring(F.get(kept, F.lit(0)), 1, width), F.lit(""))
