"""Settings: key=value text, and which of several places wins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.numeric import clamp
from lumenrank.functions.text import DEFAULT_CONTEXT

# Name -> (kind, default, least, most).
SETTINGS = {
    "timeout_sec": ("int", 300, 30, None),
    "max_edge": ("int", 1024, 256, None),
    "jpeg_quality": ("int", 80, 30, 95),
    "keep_alive": ("text", "10m", None, None),
    "detector_context": ("bool", False, None, None),
    "concurrency": ("int", 2, 1, 16),
    "max_retries": ("int", 2, 0, 8),
    "backoff_sec": ("float", 0.75, 0.05, 10.0),
    "breaker_errors": ("int", 6, 1, 50),
    "base_url": ("text", "http://127.0.0.1:11434", None, None),
    "model": ("text", "qwen2.5vl:7b", None, None),
}
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def parse_env(content: str) -> dict[str, str]:
    """Lines of key=value; blank lines and # comments are skipped, "export " and matching quotes taken off, the last of a key wins."""
    out = {}
    for line in content.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, equals, value = line.removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if not equals or not key:
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key] = value
    return out


def resolve(name: str, places: list[dict[str, str]], default: str | None = None, required: bool = False) -> str | None:
    """The first place that has a non-blank value: by custom the process, then the working folder, then the input folder."""
    for place in places:
        value = (place.get(name) or "").strip()
        if value:
            return value
    if required and default is None:
        raise KeyError(f"{name} is not set")
    return default


# The variables of each, in the order in which they count.
API_KEY, HUB_TOKENS, CLAUDE_MODELS = "ANTHROPIC_API_KEY", ("HF_TOKEN", "HUGGINGFACE_HUB_TOKEN"), ("ANTHROPIC_MODEL", "CLAUDE_MODEL")
CLAUDE_DEFAULT, ACCOUNT = "claude-haiku-4-5-20251001", "ACCOUNT_CONTEXT"


def api_key(places: list[dict[str, str]], export: dict[str, str] | None = None) -> str:
    """The key of the remote scorer: an error where none is set; export, if given, gets it, as clients read it there."""
    value = resolve(API_KEY, places, required=True)
    if export is not None:
        export[API_KEY] = value
    return value


def hub_token(places: list[dict[str, str]], export: dict[str, str] | None = None) -> str | None:
    """The token of the model hub, by either name, in each place before the next; none is fine."""
    for place in places:
        for name in HUB_TOKENS:
            if value := (place.get(name) or "").strip():
                if export is not None:
                    export[HUB_TOKENS[0]] = value
                return value
    return None


def claude_model(asked: str | None, env: dict[str, str]) -> str:
    """The model by the command line, else by the process's variables, else the default."""
    return next((v for v in ((asked or "").strip(), *((env.get(n) or "").strip() for n in CLAUDE_MODELS)) if v), CLAUDE_DEFAULT)


def account_context(places: list[dict[str, str]]) -> str:
    """What the model is told about the account."""
    return resolve(ACCOUNT, places, DEFAULT_CONTEXT)


def model_weights(name: str, env: dict[str, str], cache: str, variable: str = "DETECTOR_WEIGHTS") -> str:
    """Where a detector's weights lie: a variable, else a file in the cache. There is no network to fetch them from, so none is an error."""
    for path in ((env.get(variable) or "").strip(), os.path.join(cache, name)):
        if path and os.path.isfile(path):
            return path
    raise FileNotFoundError(f"{name} is neither in {variable} nor in {cache}")


def process_env() -> dict[str, str]:
    return dict(os.environ)


def env_rows(lines: DataFrame) -> DataFrame:
    """(key, value) from lines (file, line_no, line) by the same rules as parse_env, the last of a key winning in each file."""
    line = F.trim("line")
    bare = F.regexp_replace(line, "^export ", "")
    pairs = lines.where((line != "") & ~line.startswith("#") & bare.contains("=")).select("file", "line_no", F.trim(F.regexp_extract(bare, r"^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract(bare, r"^[^=]*=(.*)$", 1)).alias("value"))
    pairs = pairs.where("key <> ''").withColumn("value", F.regexp_replace("value", r"""^(["'])(.*)\1$""", "$2"))
    return pairs.groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))


def typed(name: Column, value: Column) -> Column:
    """A setting as text after its default and its bounds: what is no number counts as missing."""
    out = F.when(F.lit(False), F.lit(""))
    for key, (kind, default, least, most) in SETTINGS.items():
        if kind in ("int", "float"):
            cast = "long" if kind == "int" else "double"
            number = F.coalesce(F.trim(value).try_cast(cast), F.lit(default).cast(cast))
            number = clamp(number, F.lit(least).cast(cast), F.lit(most if most is not None else 2**53).cast(cast))
            out = out.when(name == key, number.cast("string"))
        elif kind == "bool":
            low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
            out = out.when(name == key, F.when(low.isin(*YES), "true").when(low.isin(*NO), "false").otherwise(str(default).lower()))
        else:
            out = out.when(name == key, F.coalesce(F.nullif(F.trim(F.coalesce(value, F.lit(""))), F.lit("")), F.lit(default)))
    return out
