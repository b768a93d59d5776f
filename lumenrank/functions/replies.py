"""Reading a model's reply: JSON, a rubric in plain text, or prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.numeric import array_mean, array_median, clamp, half_even_int
from lumenrank.functions.text import first_sentence, one_line, strip

# Fixed values.
KEYS = ("subject_clarity", "lighting", "color_pop", "emotion", "scroll_stop", "crop_4x5")
LABELS = {"subject_clarity": r"subject[\s_-]*clarity", "lighting": "lighting", "color_pop": r"color[\s_-]*pop", "emotion": "emotion", "scroll_stop": r"scroll[\s_-]*stop", "crop_4x5": r"crop[\s_-]*4x5"}
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
AFTER_LABEL = (rf"\s*[:=-]\s*{NUMBER}\s*/\s*10", rf"[^0-9]{{0,48}}{NUMBER}\s*/\s*10", rf"\s*[:=-]\s*{NUMBER}", rf"[^0-9]{{0,48}}{NUMBER}")
RAW = "struct<" + ", ".join(f"{k}: string" for k in (*KEYS, "total", "one_line")) + ">"
PAYLOAD = "struct<" + ", ".join(f"{k}: bigint" for k in (*KEYS, "total")) + ", one_line: string>"
PROSE_LINE = "Vision response prose; neutral fallback"


def _found(x: Column, pattern: str) -> Column:
    """The first group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def score(x: Column) -> Column:
    """A score from a number: nearest whole, 0 to 10."""
    return clamp(half_even_int(x), 0, 10)


def _total(x: Column) -> Column:
    return clamp(half_even_int(x), 0, 60)


def json_body(text: Column) -> Column:
    """From the first opening brace to the last closing one; a code fence around it is taken off first."""
    text = strip(text)
    fenced = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)$", 1)
    inner = F.when(fenced.rlike(r"(?s)```"), F.regexp_extract(fenced, r"(?s)^(.*)```", 1)).otherwise(fenced)
    body = F.when(text.startswith("```"), strip(inner)).otherwise(text)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(braces != "", braces).otherwise(body)


def json_scores(text: Column) -> Column:
    """The fields of a JSON object as text (RAW), null if text holds no object. A bare list or number is no object."""
    body = json_body(F.coalesce(text, F.lit("")))
    one = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{RAW}>")  # in brackets nothing may follow the object
    return F.when(body.startswith("{") & (F.size(one) == 1), F.get(one, F.lit(0)))


def with_payload(df: DataFrame, raw: str, fallback: str, out: str = "payload") -> DataFrame:
    """df with normalised scores (PAYLOAD) from fields as text in column raw (RAW); null where raw is.

    Scores are whole, 0 to 10; a field that is there but no number counts 5. From three known ones their mean fills the
    rest, and their sum stands in for a total that is missing, or that is under 10 though the sum reaches 20. With fewer,
    unknown ones stay null and a missing total is 30.
    """
    r = F.col(raw)
    number = lambda k, default: F.when(r[k].isNotNull(), F.coalesce(r[k].try_cast("double"), F.lit(default)))
    df = df.withColumns({"__known": F.array(*(score(number(k, 5.0)) for k in KEYS)), "__told": _total(number("total", 30.0))})
    df = df.withColumn("__some", F.filter("__known", lambda v: v.isNotNull()))
    df = df.withColumn("__fill", F.when(F.size("__some") >= 3, score(array_mean(F.col("__some")))))
    df = df.withColumn("__full", F.transform("__known", lambda v: F.coalesce(v, F.col("__fill"))))
    df = df.withColumn("__sum", F.when(F.col("__fill").isNotNull(), F.aggregate("__full", F.lit(0).cast("long"), lambda s, v: s + v)))
    told, summed = F.col("__told"), F.col("__sum")
    total = F.when(summed.isNotNull() & (told.isNull() | ((told < 10) & (summed >= 20))), summed).otherwise(F.coalesce(told, F.lit(30)))
    fields = F.struct(*(F.get("__full", F.lit(i)).cast("long").alias(k) for i, k in enumerate(KEYS)), total.cast("long").alias("total"), one_line(r["one_line"], F.col(fallback)).alias("one_line"))
    return df.withColumn(out, F.when(r.isNotNull(), fields)).drop("__known", "__told", "__some", "__fill", "__full", "__sum")


def with_rubric(df: DataFrame, text: str, out: str = "raw") -> DataFrame:
    """df with the fields (RAW) of a rubric in plain text: "label: n/10", "label ... n/10", "label: n", "label ... n", in that order; null below three labels.

    A label without a number of its own takes the next number within 48 characters, on the next line too.
    """
    df = df.withColumn("__text", strip(F.coalesce(F.col(text), F.lit(""))))
    t = F.col("__text")
    df = df.withColumn("__known", F.array(*(score(F.coalesce(*(_found(t, f"(?isU){LABELS[k]}{p}") for p in AFTER_LABEL)).cast("double")) for k in KEYS)))
    df = df.withColumn("__some", F.filter("__known", lambda v: v.isNotNull()))
    df = df.withColumn("__fill", score(array_mean(F.col("__some"))))
    df = df.withColumn("__full", F.transform("__known", lambda v: F.coalesce(v, F.col("__fill"))))
    total = F.coalesce(_total(_found(t, rf"(?isU)\btotal\s*[:=-]?\s*{NUMBER}").cast("double")), F.aggregate("__full", F.lit(0).cast("long"), lambda s, v: s + v))
    line = strip(F.regexp_extract(strip(F.regexp_extract(t, r"(?isU)\bone[\s_-]*line\s*[:=-]\s*(.+)", 1)), r"^[^\r\n]*", 0))
    line = F.when(line != "", line).otherwise(F.substring(first_sentence(t), 1, 180))
    fields = F.struct(*(F.get("__full", F.lit(i)).cast("string").alias(k) for i, k in enumerate(KEYS)), total.cast("string").alias("total"), line.alias("one_line"))
    return df.withColumn(out, F.when(F.size("__some") >= 3, fields)).drop("__text", "__known", "__some", "__fill", "__full")


def neutral_scores(text: Column) -> Column:
    """Fields (RAW) of prose: the median of all "n/10", else 5, for every score; null without text."""
    text = strip(F.coalesce(text, F.lit("")))
    rated = F.transform(F.regexp_extract_all(text, F.lit(rf"(?U)\b{NUMBER}\s*/\s*10\b"), F.lit(1)), lambda v: v.cast("double"))
    value = F.coalesce(score(array_median(rated)), F.lit(5).cast("long"))
    first = first_sentence(text)
    line = F.when(first != "", F.substring(first, 1, 180)).otherwise(PROSE_LINE)
    fields = F.struct(*(value.cast("string").alias(k) for k in KEYS), _total((value * 6).cast("double")).cast("string").alias("total"), line.alias("one_line"))
    return F.when(text != "", fields)


def with_parsed(df: DataFrame, content: str, thinking: str) -> DataFrame:
    """df with payload and mode by the first reading that succeeds: JSON, rubric, prose, each of content, then of thinking; null if none does."""
    names = {"content": content, "thinking": thinking}
    for name, c in names.items():
        df = with_rubric(df.withColumns({f"__json-{name}": json_scores(F.col(c)), f"__neutral-{name}": neutral_scores(F.col(c))}), c, f"__plain-{name}")
    ways = [f"{how}-{name}" for how in ("json", "plain", "neutral") for name in names]
    mode = F.coalesce(*(F.when(F.col(f"`__{w}`").isNotNull(), F.lit(w)) for w in ways))
    df = df.withColumns({"mode": mode, "__fields": F.coalesce(*(F.col(f"`__{w}`") for w in ways))}).drop(*(f"__{w}" for w in ways))
    df = df.withColumn("__said", strip(F.coalesce(F.when(F.col("mode").endswith("content"), F.col(content)).otherwise(F.col(thinking)), F.lit(""))))
    return with_payload(df, "__fields", "__said").drop("__fields", "__said")


def in_range(p: Column) -> Column:
    """Whether a payload keeps to its schema: six scores of 0 to 10, a total of 0 to 60, a line."""
    ok = p["total"].between(0, 60) & p["one_line"].isNotNull()
    for k in KEYS:
        ok = ok & p[k].between(0, 10)
    return F.coalesce(ok, F.lit(False))
