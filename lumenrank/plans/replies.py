"""Reading model replies: every turn of the conversations as prose, rubric, JSON or thinking, and literal rows for the odd forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrank.functions import replies as rep
from lumenrank.functions import text
from lumenrank.plans import adapters as ad
from lumenrank.sources.shared import materialise

# (id, content, thinking): our own wording.
REPLIES = [
    (1, '{"subject_clarity": 8, "lighting": 7, "color_pop": 8, "emotion": 6, "scroll_stop": 8, "crop_4x5": 9, "total": 46, "one_line": "Sharp and bright."}', None),
    (2, '```json\n{"subject_clarity": 3, "lighting": 4.5, "color_pop": 5.5, "total": 4, "one_line": "\'quoted\'"}\n```', None),
    (3, 'Here: {"subject_clarity": "x", "lighting": 12, "emotion": -3, "total": 99} done', ""),
    (4, "", '{"subject_clarity": 5, "lighting": 5, "one_line": ""}'),
    (5, "Subject clarity: 8/10\nLighting - 7/10\nColor pop: 8/10\nEmotion: 7/10\nScroll stop: 8/10\nCrop 4x5: 9/10\nTOTAL: 47\nOne line: Strong lead room.\nmore", None),
    (6, "Subject clarity 8 out of 10, lighting around 9, color-pop = 8. Emotion: 6\nscroll_stop: 7; crop 4x5: 8\nTOTAL: 8\none line: \"unclosed", None),
    (7, "A quiet picture. Nothing stands out! I would give 6/10, perhaps 7/10, or 4 / 10.", None),
    (8, "No numbers at all here", "thinking about 9/10"),
    (9, None, "subject clarity: 2, lighting: 3, emotion: 4"),
    (10, None, None),
    (11, "   ", "\n"),
    (12, "[1, 2, 3]", None),
    (13, "{broken json", "Lighting: 4/10 emotion 5/10 color pop: 6/10"),
    (14, "lighting:\n1. emotion 3\ncolor pop: 11", None),
    (15, '{"a": 1} and {"total": 12}', None),
    (16, '{"total": 22, "one_line": "  many   spaces\\n and `ticks` "}', None),
    (17, "Score 10/10. Great.", "later"),
    (18, '{"subject_clarity": 2.5, "lighting": 3.5, "color_pop": 4.5, "emotion": 5.5, "scroll_stop": 6.5, "crop_4x5": 7.5}', None),
]


def _rows(spark, d):
    """(id, content, thinking), written once: the parser names its input often."""
    c, t, kind = F.col("conv_id"), F.col("turn"), (F.col("conv_id") + F.col("turn")) % 4
    number = lambda k, most: ((c * k + t) % most).cast("string")
    as_json = F.concat(F.lit('{"subject_clarity": '), number(3, 13), F.lit(', "lighting": '), number(5, 11), F.lit(', "emotion": '), number(7, 11), F.lit(', "total": '), number(11, 70), F.lit(', "one_line": "turn  '), t.cast("string"), F.lit('."}'))
    rubric = F.concat(F.lit("Subject clarity: "), number(3, 11), F.lit("/10. Lighting - "), number(5, 11), F.lit("/10\nEmotion = "), number(7, 11), F.lit("\n"), F.col("text"))
    content = F.when(kind == 0, F.col("text")).when(kind == 1, as_json).when(kind == 2, rubric)
    thinking = F.when(kind == 3, F.concat(F.col("text"), F.lit(" So "), number(2, 11), F.lit("/10.")))
    told = ad.table(spark, d, "conversations").select((F.lit(1000) + c * 100 + t).cast("long").alias("id"), content.alias("content"), thinking.alias("thinking"))
    return materialise(spark.createDataFrame(REPLIES, "id long, content string, thinking string").unionAll(told), "replies")


def _flat(df, p, *more):
    return df.select("id", *more, *(p[k].alias(k) for k in (*rep.KEYS, "total", "one_line")))


def reply_json(spark, d):
    df = _rows(spark, d).withColumn("raw", rep.json_scores(F.col("content"))).where("raw is not null")
    return _flat(df, F.col("raw"))


def reply_plaintext(spark, d):
    df = rep.with_rubric(_rows(spark, d), "content").where("raw is not null")
    return _flat(df, F.col("raw"))


def reply_neutral(spark, d):
    df = _rows(spark, d).withColumn("raw", rep.neutral_scores(F.col("content"))).where("raw is not null")
    return _flat(df, F.col("raw"))


def reply_normalise(spark, d):
    df = _rows(spark, d).withColumn("raw", rep.json_scores(F.col("content"))).where("raw is not null")
    df = rep.with_payload(df, "raw", "content", "p")
    return _flat(df, F.col("p"), rep.in_range(F.col("p")).alias("valid"))


def reply_cascade(spark, d):
    return _flat(rep.with_parsed(_rows(spark, d), "content", "thinking"), F.col("payload"), "mode")


def one_line_sanitise(spark, d):
    df = ad.table(spark, d, "conversations")
    return df.select("conv_id", "turn", text.one_line(F.when(F.col("turn") % 2 == 0, F.col("text")), F.col("text")).alias("line"))


def md_escape_rows(spark, d):
    return ad.table(spark, d, "conversations").select("conv_id", "turn", text.markdown_cell(F.concat(F.col("role"), F.lit("|"), F.col("text"))).alias("cell"))


QUERIES = {f.__name__: f for f in (reply_json, reply_plaintext, reply_neutral, reply_normalise, reply_cascade, one_line_sanitise, md_escape_rows)}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else str(v)


def values(rows, names: str, types: list[str] | None = None) -> str:
    body = ", ".join("(" + ", ".join(f"{literal(v)}::{types[i]}" if types else literal(v) for i, v in enumerate(r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


_WS = r"[ \t\n\r\f\v]"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"
_FIRST = lambda x: _STRIP(f"coalesce(nullif(regexp_extract({x}, '(?s)^(.*?[.!?]){_WS}', 1), ''), {x})")


def _line_sql(raw: str, fallback: str) -> str:
    """One line of raw, else of the fallback's first sentence."""
    line = f"CASE WHEN {_STRIP(f'coalesce({raw}, chr(32))')} <> '' THEN {_STRIP(f'coalesce({raw}, chr(32))')} WHEN {_FIRST(_STRIP(fallback))} <> '' THEN {_FIRST(_STRIP(fallback))} ELSE 'Vision scoring summary' END"
    squeezed = f"regexp_replace(regexp_replace({_STRIP(f'regexp_replace({line}, $${_WS}+$$, chr(32), $$g$$)')}, '^`+', ''), '`+$', '')"
    opened = f"{_STRIP(f'''regexp_replace({squeezed}, '^[''"]', '')''')}"
    closed = f"{_STRIP(f'''regexp_replace({opened}, '[''"]$', '')''')}"
    return f"coalesce(nullif(left({closed}, 220), ''), 'Vision scoring summary')"


_NUMBER = lambda k, most: f"((conv_id * {k} + turn) % {most})"
_BASE = f"""r AS (SELECT * FROM {values(REPLIES, 'id, content, thinking', ['BIGINT', 'VARCHAR', 'VARCHAR'])} UNION ALL SELECT 1000 + conv_id * 100 + turn, CASE (conv_id + turn) % 4 WHEN 0 THEN text
  WHEN 1 THEN '{{"subject_clarity": ' || {_NUMBER(3, 13)} || ', "lighting": ' || {_NUMBER(5, 11)} || ', "emotion": ' || {_NUMBER(7, 11)} || ', "total": ' || {_NUMBER(11, 70)} || ', "one_line": "turn  ' || turn || '."}}'
  WHEN 2 THEN 'Subject clarity: ' || {_NUMBER(3, 11)} || '/10. Lighting - ' || {_NUMBER(5, 11)} || '/10' || chr(10) || 'Emotion = ' || {_NUMBER(7, 11)} || chr(10) || text END, CASE WHEN (conv_id + turn) % 4 = 3 THEN text || ' So ' || {_NUMBER(2, 11)} || '/10.' END FROM conversations)"""
_TEXTS = f"{_BASE}, t AS (SELECT id, src, ord, {_STRIP('coalesce(txt, chr(32))')} AS txt FROM (SELECT id, 'content' AS src, 1 AS ord, content AS txt FROM r UNION ALL SELECT id, 'thinking', 2, thinking FROM r))"
_JSON = f"""{_TEXTS}, j0 AS (SELECT *, CASE WHEN starts_with(txt, '```') THEN {_STRIP("CASE WHEN regexp_matches(regexp_extract(txt, '(?s)^```[^\\n]*\\n(.*)$', 1), '```') THEN regexp_extract(regexp_extract(txt, '(?s)^```[^\\n]*\\n(.*)$', 1), '(?s)^(.*)```', 1) ELSE regexp_extract(txt, '(?s)^```[^\\n]*\\n(.*)$', 1) END")} ELSE txt END AS body FROM t),
j1 AS (SELECT *, coalesce(nullif(regexp_extract(body, '(?s)\\{{.*\\}}', 0), ''), body) AS js FROM j0),
js AS (SELECT id, src, ord, txt, {", ".join(f"json_extract_string(js, '$.{k}') AS {k}" for k in (*rep.KEYS, "total", "one_line"))} FROM j1 WHERE starts_with(js, '{{') AND json_valid(js))"""
_WITHIN = lambda x, most: f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(round_even({x}, 0), 0), {most}) END)::BIGINT"
_SCORE = lambda x: _WITHIN(x, 10)


def _found_sql(k: str) -> str:
    tries = ", ".join(f"nullif(regexp_extract(txt, '(?is){rep.LABELS[k].replace(chr(92) + 's', ' ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r')}{p}', 1), '')" for p in rep.AFTER_LABEL)
    return _SCORE(f"coalesce({tries})::DOUBLE")


_KNOWN = ", ".join(f"k{i}" for i in range(6))
_MEAN = _SCORE(f"list_avg(list_filter([{_KNOWN}], lambda v: v IS NOT NULL))")
_SEEN = f"len(list_filter([{_KNOWN}], lambda v: v IS NOT NULL))"
_FULL = lambda i: f"coalesce(k{i}, fill)"
_SUM = " + ".join(_FULL(i) for i in range(6))
_PLAIN = f"""p0 AS (SELECT *, {", ".join(f"{_found_sql(k)} AS k{i}" for i, k in enumerate(rep.KEYS))} FROM t), p1 AS (SELECT *, {_MEAN} AS fill, {_SEEN} AS seen FROM p0 WHERE {_SEEN} >= 3),
p2 AS (SELECT *, {_STRIP("regexp_extract(" + _STRIP("regexp_extract(txt, '(?is)\\bone[ \\t\\n\\r_-]*line\\s*[:=-]\\s*(.+)', 1)") + ", '^[^\\r\\n]*', 0)")} AS told FROM p1),
plain AS (SELECT id, src, ord, txt, {", ".join(f"({_FULL(i)})::VARCHAR AS {k}" for i, k in enumerate(rep.KEYS))}, coalesce({_WITHIN("nullif(regexp_extract(txt, '(?is)" + chr(92) + "btotal" + chr(92) + "s*[:=-]?" + chr(92) + "s*" + rep.NUMBER + "', 1), '')::DOUBLE", 60)}, {_SUM})::VARCHAR AS total, coalesce(nullif(told, ''), left({_FIRST('txt')}, 180)) AS one_line FROM p2)"""
_NEUTRAL = f"""n0 AS (SELECT *, regexp_extract_all(txt, '\\b{rep.NUMBER}\\s*/\\s*10\\b', 1)::DOUBLE[] AS rated FROM t WHERE txt <> ''), n1 AS (SELECT *, coalesce({_SCORE("list_median(rated)")}, 5) AS v FROM n0),
neutral AS (SELECT id, src, ord, txt, {", ".join(f"v::VARCHAR AS {k}" for k in rep.KEYS)}, (v * 6)::VARCHAR AS total, coalesce(nullif(left({_FIRST('txt')}, 180), ''), '{rep.PROSE_LINE}') AS one_line FROM n1)"""


def _payload_sql(source: str) -> str:
    """Normalised rows of source, which has the fields as text, txt and any others."""
    number = lambda k, default: f"CASE WHEN {k} IS NOT NULL THEN coalesce(TRY_CAST({k} AS DOUBLE), {default}) END"
    return f"""q0 AS (SELECT *, {", ".join(f"{_SCORE(number(k, 5.0))} AS k{i}" for i, k in enumerate(rep.KEYS))}, {_WITHIN(number("total", 30.0), 60)} AS told_total FROM {source}),
q1 AS (SELECT *, CASE WHEN {_SEEN} >= 3 THEN {_MEAN} END AS fill, {_SEEN} >= 3 AS enough FROM q0), q2 AS (SELECT *, {_SUM} AS summed FROM q1),
q AS (SELECT * EXCLUDE ({", ".join(rep.KEYS)}, total, one_line), {", ".join(f"({_FULL(i)})::BIGINT AS {k}" for i, k in enumerate(rep.KEYS))}, CASE WHEN enough AND (told_total IS NULL OR (told_total < 10 AND summed >= 20)) THEN summed ELSE coalesce(told_total, 30) END AS total, {_line_sql("one_line", "txt")} AS one_line FROM q2)"""


_FIELDS = ", ".join((*rep.KEYS, "total", "one_line"))

SQL = {
    "reply_json": f"WITH {_JSON} SELECT id, {_FIELDS} FROM js WHERE src = 'content'",
    "reply_plaintext": f"WITH {_TEXTS}, {_PLAIN} SELECT id, {_FIELDS} FROM plain WHERE src = 'content'",
    "reply_neutral": f"WITH {_TEXTS}, {_NEUTRAL} SELECT id, {_FIELDS} FROM neutral WHERE src = 'content'",
    "reply_normalise": f"WITH {_JSON}, mine AS (SELECT * FROM js WHERE src = 'content'), {_payload_sql('mine')} SELECT id, coalesce({' AND '.join(f'{k} BETWEEN 0 AND 10' for k in rep.KEYS)} AND total BETWEEN 0 AND 60, false) AS valid, {_FIELDS} FROM q",
    "reply_cascade": f"""WITH {_JSON}, {_PLAIN}, {_NEUTRAL}, every AS (SELECT id, src, ord, txt, 'json' AS how, 1 AS rank, {_FIELDS} FROM js UNION ALL SELECT id, src, ord, txt, 'plain', 2, {_FIELDS} FROM plain UNION ALL SELECT id, src, ord, txt, 'neutral', 3, {_FIELDS} FROM neutral),
      best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, ord) AS place FROM every), one AS (SELECT * FROM best WHERE place = 1), {_payload_sql('one')} SELECT r.id, how || '-' || src AS mode, {", ".join("q." + f for f in (*rep.KEYS, "total", "one_line"))} FROM r LEFT JOIN q ON r.id = q.id""",
    "one_line_sanitise": f"SELECT conv_id, turn, {_line_sql('(CASE WHEN turn % 2 = 0 THEN text END)', 'text')} AS line FROM conversations",
    "md_escape_rows": "SELECT conv_id, turn, trim(replace(replace(coalesce(role || '|' || text, ''), '|', '\\|'), chr(10), ' ')) AS cell FROM conversations",
}
