"""The whole funnel, its reports, and the sums over folders and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrank.functions import scoring, text
from lumenrank.functions.replies import KEYS
from lumenrank.operators import ranking, reports
from lumenrank.plans import adapters as ad
from lumenrank.plans import grouping, scores

LIMIT = 6


def full_pipeline(spark, d):
    """Leaders of hashes, the best of each by sharpness with a swap by composite, the share that is scored, and the crop-gated top."""
    known = ad.technical(spark, d)
    kept = grouping.dedup_only(spark, d, known).select(F.col("chosen").alias("vec_id"), "leader", "selected_by")
    df = kept.join(ad.scored(spark, d, known), "vec_id")
    cut = ranking.share_cut(df, ranking.best_first(F.col("composite"), F.col("vec_id")), scores.TOP, scores.SHARE, "technical_rank")
    top = ranking.crop_gated_top(cut, scores.TOP, F.col("crop_4x5"), F.col("final_score"), F.col("vec_id"))
    top = ranking.numbered_few(top, [F.col("crop_safe").desc(), *ranking.best_first(F.col("final_score"), F.col("vec_id"))])
    return top.select("rank", "vec_id", "leader", "selected_by", "technical_rank", "crop_safe", F.round("final_score", 6).alias("final_score"))


def _top(spark, d):
    """The crop-gated top as items with a path, a caption and a burst."""
    top = ranking.crop_gated_top(ad.scored(spark, d), scores.TOP, F.col("crop_4x5"), F.col("final_score"), F.col("vec_id"))
    top = ranking.numbered_few(top, [F.col("crop_safe").desc(), *ranking.best_first(F.col("final_score"), F.col("vec_id"))])
    path = lambda v: F.concat(F.lit("/in/set a/"), v.cast("string"), F.lit(".v1.PNG"))
    v = F.col("vec_id")
    return top.withColumns({"path": path(v), "line": F.concat(F.lit("a|b\n"), F.col("scorer")), "members": F.when(v % 2 == 0, F.array(path(v), path(v + 1))).otherwise(F.array(path(v))), "selected_by": F.when(v % 2 == 0, "sharpness").otherwise(""), "cropped": v % 4 != 1, "uncertain": v % 3 == 0, "reasons": F.when(v % 3 == 0, F.array(F.lit("subject_bbox_hits_image_edge"))).otherwise(F.array().cast("array<string>"))})


def report_rows(spark, d):
    df = reports.report_rows(_top(spark, d))
    return df.withColumns({"reasons": F.array_join("reasons", ","), "burst": F.to_json("burst")})


def report_markdown(spark, d):
    return reports.markdown(reports.report_rows(_top(spark, d)), "Selected")


def gallery_stats(spark, d):
    s = reports.gallery_stats(reports.report_rows(_top(spark, d)))
    return s.select("n", "n_uncertain", *(F.round(c, 6).alias(c) for c in ("first_score", "mean_final", "mean_technical", "mean_total")))


def gallery_rows(spark, d):
    """Documents with what is known of them elsewhere: a label and the first turn of a conversation, by id."""
    doc = ad.table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("out/"), F.col("lang"), F.lit(" "), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"))
    lab = ad.table(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    turn = ad.table(spark, d, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("caption"))
    both = doc.join(lab, F.col("doc_id") == F.col("l_id"), "left").join(turn, F.col("doc_id") == F.col("conv_id"), "left")
    return both.select("doc_id", text.quoted(F.col("file")).alias("href"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(text.markdown_cell(F.col("caption")), F.lit("")).alias("caption"), F.array_join(F.filter(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")), lambda b: b.isNotNull()), ",").alias("badges"))


def _paths(spark, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    return ad.table(spark, d, "pages").select("page_id", "url", path.alias("path"))


def folder_rollup(spark, d):
    return reports.folder_rollup(_paths(spark, d), F.col("path"), F.when(F.col("page_id") % 5 != 0, F.col("page_id") % 7), F.col("page_id"))


def breadcrumbs(spark, d):
    df = _paths(spark, d).select("page_id", text.breadcrumbs(F.col("path")).alias("c"))
    return df.select("page_id", F.array_join(F.transform("c", lambda c: F.concat(c["name"], F.lit("="), c["href"])), ";").alias("crumbs"))


def scan_filter_suffix(spark, d):
    """Pages as files: every other one a picture by its suffix."""
    ext = F.element_at(F.array(F.lit(".JPG"), F.lit(".txt"), F.lit(".webp"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    df = ad.table(spark, d, "pages").select("page_id", F.concat(F.lit("/in/p."), F.col("page_id").cast("string"), ext).alias("path")).where(text.is_picture(F.col("path")))
    return df.select("page_id", text.file_name(F.col("path")).alias("name"), text.stem(F.col("path")).alias("stem"), text.suffix(F.col("path")).alias("suffix"))


def bench_summary(spark, d):
    e = ad.table(spark, d, "events")
    runs = e.select(F.col("event_type").alias("model"), (F.col("value") + 1).alias("duration"), (F.col("user_id") % 40 + 1).alias("images"), (F.col("user_id") % 7 == 0).cast("long").alias("failed"))
    s = reports.bench_summary(runs)
    return s.select("model", "runs", "failed", *(F.round(c, 6).alias(c) for c in ("mean_seconds", "median_seconds", "seconds_an_image", "images_a_minute", "times_fastest")))


def breaker_replay(spark, d):
    e = reports.breaker(ad.table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 2)
    return e.select("event_id", "failures_in_row", "open")


QUERIES = {f.__name__: f for f in (full_pipeline, report_rows, report_markdown, gallery_stats, gallery_rows, folder_rollup, breadcrumbs, scan_filter_suffix, bench_summary, breaker_replay)}

_TOP = f"""{ad.SCORED_SQL}, top0 AS (SELECT *, crop_4x5 >= 6 AS crop_safe, row_number() OVER (ORDER BY (crop_4x5 >= 6)::INT DESC, final_score DESC, vec_id) AS rank FROM scored),
top AS (SELECT *, vec_id || '.v1.PNG' AS filename, vec_id || '.v1' AS stem, vec_id % 4 <> 1 AS cropped, vec_id % 3 = 0 AS uncertain, 'a\\|b ' || scorer AS one_line FROM top0 WHERE rank <= {scores.TOP})"""
_NO = "lpad(rank::VARCHAR, greatest(2, len(rank::VARCHAR))::INT, '0')"
_ROWS = f"""{_TOP}, rows AS (SELECT rank, filename, round_even(final_score, 4) AS final_score, round_even(composite, 4) AS technical_composite, total, one_line, CASE WHEN cropped THEN {_NO} || '_cropped_' || stem || '.jpg' END AS output_cropped, CASE WHEN cropped THEN {_NO} || '_hd_' || stem || '.jpg' END AS output_hd, {_NO} || '_full_' || stem || '.PNG' AS output_full, uncertain, CASE WHEN uncertain THEN 'subject_bbox_hits_image_edge' ELSE '' END AS reasons,
  CASE WHEN vec_id % 2 = 0 THEN '{{"count":2,"selected_by":"sharpness","members":["' || filename || '","' || (vec_id + 1) || '.v1.PNG"]}}' END AS burst FROM top)"""
_PATH = "paths AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages)"
_FILE = "files AS (SELECT page_id, 'p.' || page_id AS s, ['.JPG', '.txt', '.webp', ''][page_id % 4 + 1] AS e FROM pages)"

SQL = {
    "full_pipeline": f"""WITH RECURSIVE {grouping.LEADER_SQL}, {ad.SCORED_SQL},
      j AS (SELECT leader, c.vec_id, composite, row_number() OVER (PARTITION BY leader ORDER BY round(lap_energy, 6) DESC, c.vec_id) AS place FROM clusters c JOIN metrics m ON m.vec_id = c.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY composite DESC, (place = 1)::INT DESC, vec_id) AS best_place FROM j), o AS (SELECT leader, max(CASE WHEN place = 1 THEN vec_id END) AS rep, max(CASE WHEN best_place = 1 THEN vec_id END) AS chosen, count(*) AS n FROM r GROUP BY leader),
      k AS (SELECT s.*, o.leader, CASE WHEN rep <> chosen THEN 'technical' WHEN n > 1 THEN 'sharpness' ELSE '' END AS selected_by, row_number() OVER (ORDER BY s.composite DESC, s.vec_id) AS technical_rank FROM o JOIN scored s ON s.vec_id = o.chosen),
      c2 AS (SELECT *, crop_4x5 >= 6 AS crop_safe FROM k WHERE technical_rank <= greatest({scores.TOP}, trunc((SELECT count(*) FROM k) * {scores.SHARE}))),
      f AS (SELECT *, row_number() OVER (ORDER BY crop_safe::INT DESC, final_score DESC, vec_id) AS rank FROM c2) SELECT rank, vec_id, leader, selected_by, technical_rank, crop_safe, round(final_score, 6) AS final_score FROM f WHERE rank <= {scores.TOP}""",
    "report_rows": f"WITH {_ROWS} SELECT * FROM rows",
    "report_markdown": f"""WITH {_ROWS}, h AS (SELECT * FROM (VALUES (-3, '## Selected'), (-2, '| Rank | File | Score | Technical | Model | Caption | Output |'), (-1, '| --- | --- | --- | --- | --- | --- | --- |')) AS v(line_no, line))
      SELECT line_no::BIGINT AS line_no, line FROM h UNION ALL SELECT rank, '| ' || rank || ' | ' || filename || ' | ' || format('{{:.4f}}', final_score) || ' | ' || format('{{:.4f}}', technical_composite) || ' | ' || coalesce(total::VARCHAR, '') || ' | ' || replace(one_line, '|', '\\|') || ' | ' || coalesce(output_cropped, '') || ' |' FROM rows""",
    "gallery_stats": f"WITH {_ROWS} SELECT count(*) AS n, count(*) FILTER (uncertain) AS n_uncertain, round(arg_min(final_score, rank), 6) AS first_score, round(avg(final_score), 6) AS mean_final, round(avg(technical_composite), 6) AS mean_technical, round(avg(total), 6) AS mean_total FROM rows",
    "gallery_rows": """SELECT d.doc_id, 'out/' || lang || '%20' || d.doc_id || '.jpg' AS href, coalesce(quality, -1) AS quality, coalesce(trim(replace(replace(c.text, '|', '\\|'), chr(10), ' ')), '') AS caption, array_to_string(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda b: b IS NOT NULL), ',') AS badges
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0""",
    "folder_rollup": f"""WITH {_PATH}, s AS (SELECT page_id, parts, unnest(range(len(parts))) AS i, CASE WHEN page_id % 5 <> 0 THEN page_id % 7 ELSE 0 END AS images FROM paths)
      SELECT array_to_string(parts[1:i], '/') AS parent, parts[i + 1] AS child, count(*) AS galleries, sum(images)::BIGINT AS images, arg_min(array_to_string(parts, '/'), page_id) AS thumbnail FROM s GROUP BY 1, 2""",
    "breadcrumbs": f"WITH {_PATH} SELECT page_id, array_to_string(list_transform(parts, lambda p, i: p || '=' || repeat('../', len(parts) - i)), ';') AS crumbs FROM paths",
    "scan_filter_suffix": f"WITH {_FILE} SELECT page_id, s || e AS name, s AS stem, lower(e) AS suffix FROM files WHERE lower(e) IN ('.jpg', '.webp')",
    "bench_summary": """WITH r AS (SELECT event_type AS model, value + 1 AS duration, user_id % 40 + 1 AS images, (user_id % 7 = 0)::INT AS failed FROM events),
      m AS (SELECT model, count(*) AS runs, sum(failed)::BIGINT AS failed, avg(duration) AS a, quantile_cont(duration, 0.5) AS b, avg(duration / images) AS c, avg(60 * images / duration) AS d FROM r GROUP BY model)
      SELECT model, runs, failed, round(a, 6) AS mean_seconds, round(b, 6) AS median_seconds, round(c, 6) AS seconds_an_image, round(d, 6) AS images_a_minute, round(c / min(c) OVER (), 6) AS times_fastest FROM m""",
    "breaker_replay": """WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
      f AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS failures_in_row FROM i)
      SELECT event_id, failures_in_row, max(failures_in_row) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 2 AS open FROM f""",
}
