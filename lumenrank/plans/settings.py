"""Settings, names, errors and small numbers: literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrank.functions import numeric, text
from lumenrank.plans.replies import values
from lumenrank.sources import config

ENV = [(p, k, v) for p, rows in ((1, [("max_edge", "768"), ("concurrency", "x"), ("jpeg_quality", "99"), ("keep_alive", " "), ("detector_context", "YES")]), (2, [("timeout_sec", "10"), ("keep_alive", "20m"), ("concurrency", "4"), ("backoff_sec", "0.01")]), (3, [("timeout_sec", "450"), ("max_retries", "-2"), ("model", "m:1"), ("detector_context", "off"), ("breaker_errors", "8")])) for k, v in rows]
ERRORS = [(1, "claude", "No module named x"), (2, "claude", "not_found_error: model: y"), (3, "claude", "429 Too Many Requests"), (4, "ollama", "Connection reset by peer"), (5, "clip", "certificate verify failed"), (6, "clip", "weights are corrupt"), (7, "ollama", None), (8, "claude", "Overloaded (529)"), (9, "ollama", "TIMED OUT"), (10, "clip", "cannot import torch")]
MODELS = [(1, "qwen2.5vl:7b", 512), (2, "Qwen3-VL:8b", 768), (3, "name-20250514", 1024), (4, "minicpm", 256), (5, "fallback-a", 512), (6, " qwen2.5-vl ", 512), (7, "x-2025", 1), (8, "", 9)]
FALLBACKS = ["fallback-a", "fallback-b"]
PROMPTS = [(1, "You judge photos. Context: street scenes.  Rate each criterion from 0."), (2, 'context: "birds"\n\nmore'), (3, "no such thing"), (4, None), (5, "CONTEXT: cars. Return only JSON"), (6, "context:   . return only x"), (7, "Context: two\nlines. rate each criterion")]
NUMBERS = [(1, "1.5"), (2, "x"), (3, None), (4, " 7 "), (5, "-2e3"), (6, ""), (7, "0")]
TEMPLATE = "Judge for {context}. Answer in JSON."


def env_resolution(spark, d):
    rows = spark.createDataFrame(ENV, "place int, name string, value string").where(F.trim("value") != "")
    first = rows.groupBy("name").agg(F.min_by("value", "place").alias("value"))
    names = spark.createDataFrame([(n,) for n in config.SETTINGS], "name string")
    return names.join(first, "name", "left").select("name", config.typed(F.col("name"), F.col("value")).alias("value"))


def error_classes(spark, d):
    e = F.col("error")
    df = spark.createDataFrame(ERRORS, "id int, scorer string, error string")
    return df.select("id", text.holds(e, text.RETRYABLE).alias("retryable"), text.holds(e, text.RATE_LIMIT).alias("rate_limit"), (text.holds(e, ("not_found_error",)) & text.holds(e, ("model",))).alias("unknown_model"), text.setup_hint(e, F.col("scorer")).alias("hint"))


def model_candidates(spark, d):
    df = spark.createDataFrame(MODELS, "id int, model string, edge int")
    return df.select("id", F.array_join(text.model_candidates(F.col("model"), FALLBACKS), ",").alias("candidates"), text.is_qwen(F.col("model")).alias("qwen"), text.token_budget(F.col("model"), F.col("edge")).alias("tokens"))


def context_extract(spark, d):
    df = spark.createDataFrame(PROMPTS, "id int, prompt string").withColumn("context", text.context(F.col("prompt")))
    return df.select("id", "context", text.prompt(TEMPLATE, F.when(F.col("id") % 2 == 1, F.col("context"))).alias("compact"))


def backoff_schedule(spark, d):
    return spark.range(0, 9).select(F.col("id").alias("attempt"), numeric.backoff(F.lit(0.75), F.col("id")).alias("seconds"))


def safe_number(spark, d):
    df = spark.createDataFrame(NUMBERS, "id int, word string")
    return df.select("id", numeric.safe_number(F.trim("word"), 5.0).alias("number"), F.trim("word").try_cast("double").isNotNull().alias("is_number"))


QUERIES = {f.__name__: f for f in (env_resolution, error_classes, model_candidates, context_extract, backoff_schedule, safe_number)}


def _any(x: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{m}')" for m in marks) + ")"


def _typed_sql() -> str:
    out = "CASE name"
    for name, (kind, default, least, most) in config.SETTINGS.items():
        if kind in ("int", "float"):
            t = "BIGINT" if kind == "int" else "DOUBLE"
            out += f" WHEN '{name}' THEN least(greatest(coalesce(TRY_CAST(trim(value) AS {t}), {default}), {least}), {most if most is not None else 2**53})::{t}::VARCHAR"
        elif kind == "bool":
            out += f" WHEN '{name}' THEN CASE WHEN lower(trim(coalesce(value, ''))) IN {config.YES} THEN 'true' WHEN lower(trim(coalesce(value, ''))) IN {config.NO} THEN 'false' ELSE '{str(default).lower()}' END"
        else:
            out += f" WHEN '{name}' THEN coalesce(nullif(trim(coalesce(value, '')), ''), '{default}')"
    return out + " END"


_CONTEXT = "coalesce(nullif(trim(trim(trim(regexp_extract(coalesce(prompt, ''), '(?is)\\bcontext:\\s*(.+?)(?:\\.\\s*rate each criterion|\\.\\s*return only|\\n\\n)', 1)), '\"'), ''''), ''), '" + text.DEFAULT_CONTEXT + "')"
_QWEN = "(" + " OR ".join(f"starts_with(lower(trim(model)), '{p}')" for p in text.QWEN) + ")"

SQL = {
    "env_resolution": f"WITH e AS {values(ENV, 'place, name, value')}, f AS (SELECT name, arg_min(value, place) AS value FROM e WHERE trim(value) <> '' GROUP BY name), n AS {values([(n,) for n in config.SETTINGS], 'name')} SELECT n.name, {_typed_sql().replace('CASE name', 'CASE n.name', 1)} AS value FROM n LEFT JOIN f ON n.name = f.name",
    "error_classes": f"""WITH e AS {values(ERRORS, 'id, scorer, error', ['INT', 'VARCHAR', 'VARCHAR'])} SELECT id, {_any('error', text.RETRYABLE)} AS retryable, {_any('error', text.RATE_LIMIT)} AS rate_limit, {_any('error', ('not_found_error',))} AND {_any('error', ('model',))} AS unknown_model,
      CASE WHEN scorer = 'ollama' THEN 'check the server address, the model and the time-out: ' || coalesce(error, '') WHEN {_any('error', ('no module named', 'import'))} THEN 'install what the scorer needs: ' || scorer WHEN scorer = 'claude' AND {_any('error', ('not_found_error',))} AND {_any('error', ('model',))} THEN 'choose another model' WHEN scorer = 'clip' AND {_any('error', ('certificate', 'https', 'connection', 'offline'))} THEN 'the first run needs the network' ELSE 'check the installation' END AS hint FROM e""",
    "model_candidates": f"""WITH m AS {values(MODELS, 'id, model, edge')}, c AS (SELECT *, CASE WHEN regexp_matches(model, '-[0-9]{{8}}$') THEN [model, regexp_replace(model, '-[0-9]{{8}}$', ''), 'fallback-a', 'fallback-b'] ELSE [model, 'fallback-a', 'fallback-b'] END AS l FROM m),
      u AS (SELECT *, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS k FROM c) SELECT id, array_to_string(k, ',') AS candidates, {_QWEN} AS qwen, CASE WHEN {_QWEN} AND edge <= 512 THEN 650 WHEN {_QWEN} THEN 750 ELSE 220 END::BIGINT AS tokens FROM u""",
    "context_extract": f"WITH p AS {values(PROMPTS, 'id, prompt', ['INT', 'VARCHAR'])}, c AS (SELECT id, {_CONTEXT} AS context FROM p) SELECT id, context, replace('{TEMPLATE}', '{{context}}', CASE WHEN id % 2 = 1 THEN context ELSE '{text.DEFAULT_CONTEXT}' END) AS compact FROM c",
    "backoff_schedule": "SELECT range AS attempt, 0.75::DOUBLE * power(2, range) AS seconds FROM range(9)",
    "safe_number": f"WITH n AS {values(NUMBERS, 'id, word', ['INT', 'VARCHAR'])} SELECT id, coalesce(TRY_CAST(trim(word) AS DOUBLE), 5.0) AS number, TRY_CAST(trim(word) AS DOUBLE) IS NOT NULL AS is_number FROM n",
}
