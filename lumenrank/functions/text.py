"""Text of reports, paths, prompts and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_CONTEXT = "General photography account"
DEFAULT_LINE = "Vision scoring summary"
QWEN = ("qwen3-vl", "qwen2.5vl", "qwen2.5-vl")
QWEN_SMALL_EDGE, QWEN_SMALL, QWEN_LARGE, OTHER_TOKENS = 512, 650, 750, 220
RETRYABLE = ("timed out", "timeout", "connection failed", "connection reset", "temporarily unavailable", "429", "500", "502", "503", "504")
RATE_LIMIT = ("429", "rate", "overloaded", "529")
CONTEXT_PATTERN = r"(?isU)\bcontext:\s*(.+?)(?:\.\s*rate each criterion|\.\s*return only|\n\n)"
BENCH_FAILED = ("vision scoring failed", "technical-only", "circuit breaker", "ollama unavailable")
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".tiff", ".bmp")


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def markdown_cell(x: Column) -> Column:
    """One table cell: bars escaped, on one line."""
    return F.trim(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def first_sentence(x: Column) -> Column:
    """Up to the white space that follows the first full stop, question or exclamation mark."""
    return strip(F.get(F.split(strip(x), r"(?U)(?<=[.!?])\s+", 2), F.lit(0)))


def one_line(raw: Column, fallback: Column) -> Column:
    """A caption: raw, or the first sentence of the fallback, on one line, without back-ticks and one quote at either end, cut at 220."""
    empty = F.lit("")
    line = F.coalesce(F.nullif(strip(F.coalesce(raw, empty)), empty), F.nullif(first_sentence(F.coalesce(fallback, empty)), empty), F.lit(DEFAULT_LINE))
    line = F.regexp_replace(strip(F.regexp_replace(line, r"(?U)\s+", " ")), r"^`+|`+$", "")
    # Each step names the one before once, so the expression stays small.
    line = F.regexp_replace(line, r"(?sU)^['\"]\s*(.*?)\s*$", "$1")
    line = F.regexp_replace(line, r"(?sU)^\s*(.*?)\s*['\"]$", "$1")
    return F.coalesce(F.nullif(F.substring(line, 1, 220), empty), F.lit(DEFAULT_LINE))


def context(prompt: Column) -> Column:
    """The account context that a prompt names, or the default."""
    found = F.regexp_extract(F.coalesce(prompt, F.lit("")), CONTEXT_PATTERN, 1)
    bare = F.regexp_replace(F.regexp_replace(strip(found), r'^"+|"+$', ""), r"^'+|'+$", "")
    return F.when(bare != "", bare).otherwise(DEFAULT_CONTEXT)


def prompt(template: str, account: Column) -> Column:
    """A template with its {context} filled in; a blank one gets the default."""
    told = strip(F.coalesce(account, F.lit("")))
    return F.replace(F.lit(template), F.lit("{context}"), F.when(told != "", told).otherwise(DEFAULT_CONTEXT))


def is_qwen(model: Column) -> Column:
    name = F.lower(strip(F.coalesce(model, F.lit(""))))
    out = F.lit(False)
    for p in QWEN:
        out = out | name.startswith(p)
    return out


def token_budget(model: Column, edge: Column) -> Column:
    return F.when(is_qwen(model) & (edge <= QWEN_SMALL_EDGE), QWEN_SMALL).when(is_qwen(model), QWEN_LARGE).otherwise(OTHER_TOKENS).cast("long")


def model_candidates(preferred: Column, fallbacks: list[str]) -> Column:
    """Names to try in order: the preferred, it without its date, the fallbacks; each once, none empty."""
    undated = F.when(preferred.rlike("-[0-9]{8}$"), F.regexp_replace(preferred, "-[0-9]{8}$", ""))
    return F.array_distinct(F.filter(F.array(preferred, undated, *(F.lit(f) for f in fallbacks)), lambda m: m.isNotNull() & (m != "")))


def holds(x: Column, marks: tuple[str, ...]) -> Column:
    """Whether lower-case x has any of the marks."""
    out, low = F.lit(False), F.lower(F.coalesce(x, F.lit("")))
    for m in marks:
        out = out | low.contains(m)
    return out


def setup_hint(error: Column, scorer: Column) -> Column:
    """Advice for a scorer that does not start: a short code."""
    low = F.lower(F.coalesce(error, F.lit("")))
    missing = low.contains("no module named") | low.contains("import")
    unknown = low.contains("not_found_error") & low.contains("model")
    network = low.contains("certificate") | low.contains("https") | low.contains("connection") | low.contains("offline")
    return (
        F.when(scorer == "ollama", F.concat(F.lit("check the server address, the model and the time-out: "), F.coalesce(error, F.lit(""))))
        .when(missing, F.concat(F.lit("install what the scorer needs: "), scorer))
        .when((scorer == "claude") & unknown, "choose another model")
        .when((scorer == "clip") & network, "the first run needs the network")
        .otherwise("check the installation")
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, lower-case; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^./]+$", "")


def is_picture(path: Column) -> Column:
    return suffix(path).isin(*EXTENSIONS)


def quoted(path: Column) -> Column:
    """A path for a URL: slashes stay, a blank is %20."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def ranked_name(rank: Column, kind: str, name: Column, ext: Column | str) -> Column:
    """Such as 03_cropped_a.jpg; ranks over 99 get as many digits as they need."""
    return F.concat(F.format_string(f"%02d_{kind}_", rank.cast("long")), name, ext if isinstance(ext, Column) else F.lit(ext))


def bar(share: Column, width: int = 30) -> Column:
    return F.repeat(F.lit("#"), F.floor(share * width).cast("int"))


def breadcrumbs(path: Column) -> Column:
    """Links from the root down to path's folder: array of struct(name, href); the last one is where it stands."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.transform(parts, lambda p, i: F.struct(p.alias("name"), F.repeat(F.lit("../"), (n - 1 - i).cast("int")).alias("href")))


def base64_text(content: Column) -> Column:
    """Base 64 on one line, whatever the session's setting is."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
