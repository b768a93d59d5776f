"""The smaller steps between stages over the tables: reuse, tags, requests, cache entries, scopes, benchmark sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrank.functions import text
from lumenrank.operators import caches, ranking, reports
from lumenrank.plans import adapters as ad
from lumenrank.plans import scores
from lumenrank.sources import files, scorers


def stage0_reuse(spark, d):
    """Orders as source files in the order of their names, order lines as copies made of them."""
    src = ad.table(spark, d, "orders").select(F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"), (F.col("o_orderkey") % 97).cast("double").alias("mtime"))
    work = ad.table(spark, d, "lineitem").select(F.concat(F.lit("/in/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("path"), (F.col("l_partkey") % 97).cast("double").alias("mtime"))
    out = caches.fresh(ranking.numbered(src, [text.file_name(F.col("path")), F.col("path")], "ord"), work)
    return out.select("path", "ord", "reusable", F.concat(F.lit("/work/"), text.stem(F.col("path")), F.lit(".png")).alias("work_path"))


def exif_times(spark, d):
    stamp = F.when(F.col("o_orderkey") % 7 == 0, "no time").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    return ad.table(spark, d, "orders").select("o_orderkey", F.round(files.exif_time(stamp, (F.col("o_orderkey") % 100).cast("string")), 6).alias("seconds"))


def exif_summaries(spark, d):
    """Order lines as the tags of a picture; some are missing."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    t = F.struct(F.lit("Maker").alias("make"), F.when(n % 2 == 0, "MAKER One").otherwise("Two").alias("model"), F.when(n % 3 == 0, "").otherwise("50mm lens").alias("lens"), q.alias("focal"), (n - 2 + F.lit(0.5)).alias("f_number"), F.when(n == 5, 2.5).otherwise(F.col("l_discount")).alias("exposure"), (F.col("l_suppkey") % 3 * 100).alias("iso"), F.lit("").alias("taken"))
    return ad.table(spark, d, "lineitem").withColumn("t", t).select("l_orderkey", "l_linenumber", files.exif_summary(F.col("t")).alias("summary"))


def request_bodies(spark, d):
    """Each turn of a conversation as a picture to be rated."""
    df = ad.table(spark, d, "conversations")
    body = scorers.claude_request(F.concat(F.lit("model-"), F.col("role")), text.base64_text(F.col("text").cast("binary")), F.lit("Rate this."), F.when(F.col("turn") % 2 == 0, "a dog"))
    return df.select("conv_id", "turn", body.alias("body"))


def vision_cache_entries(spark, d):
    docs = ad.table(spark, d, "documents").select(F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("source_sha256"))
    scored = ad.table(spark, d, "labels").select(F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("toxic") == 0, F.col("quality")).alias("vision"))
    return caches.vision_entries(scored, docs, "m", F.sha2(F.lit("prompt"), 256))


def cached_and_fresh(spark, d):
    """Metrics, half of them as if they came from a cache, in the order of input."""
    df = ad.technical(spark, d).select(F.col("vec_id").alias("ord"), F.round("composite", 6).alias("composite"))
    hit = lambda odd: df.where(F.col("ord") % 2 == odd).withColumn("cached", F.lit(bool(odd)))
    return caches.cached_then_fresh(hit(1), hit(0))


def burst_scope(spark, d):
    """The items whose bursts are looked at again: twice the wanted ones, or half of all."""
    df = ad.technical(spark, d).select("vec_id", "composite")
    return ranking.share_cut(df, ranking.best_first(F.col("composite"), F.col("vec_id")), 2 * scores.TOP, 0.5, "technical_rank").select("vec_id", "technical_rank")


def output_versions(spark, d):
    name = lambda kind, is_there: F.when(is_there, F.concat(F.lit(f"{kind}_"), F.col("doc_id").cast("string"))).otherwise("")
    k = F.col("doc_id")
    return ad.table(spark, d, "documents").select("doc_id", F.array_join(reports.versions(name("cropped", k % 2 == 0), name("hd", k % 3 == 0), F.when(k % 5 == 0, "full")), ",").alias("versions"))


def _bench(spark, d):
    line = F.when(F.col("user_id") % 5 == 0, "Vision scoring FAILED: x").when(F.col("user_id") % 7 == 0, "technical-only").otherwise("fine")
    return ad.table(spark, d, "events").select(F.col("event_type").alias("mode"), (F.col("user_id") % 3).alias("run"), (F.col("user_id") % 3 * 10 + F.length("event_type")).cast("double").alias("duration"), F.col("value").alias("final_score"), line.alias("line"))


def bench_modes(spark, d):
    s = reports.bench_modes(_bench(spark, d))
    return s.select("mode", "runs", *(F.round(c, 6).alias(c) for c in ("mean_seconds", "seconds_an_image", "images_a_minute", "mean_failed", "mean_score", "median_score")))


def failed_in_bench(spark, d):
    return _bench(spark, d).groupBy("mode", "run").agg(F.count_if(reports.failed_in_bench(F.col("line"))).alias("failed"))


QUERIES = {f.__name__: f for f in (stage0_reuse, exif_times, exif_summaries, request_bodies, vision_cache_entries, cached_and_fresh, burst_scope, output_versions, bench_modes, failed_in_bench)}

_RUNS = """b AS (SELECT event_type AS mode, user_id % 3 AS run, (user_id % 3 * 10 + length(event_type))::DOUBLE AS duration, value AS final_score, user_id % 5 = 0 OR user_id % 7 = 0 AS bad FROM events)"""

SQL = {
    "stage0_reuse": """WITH w AS (SELECT l_orderkey, max(l_partkey % 97) AS made FROM lineitem GROUP BY 1)
      SELECT '/in/' || o_orderkey || '.jpg' AS path, row_number() OVER (ORDER BY o_orderkey || '.jpg') AS ord, coalesce(made >= o_orderkey % 97, false) AS reusable, '/work/' || o_orderkey || '.png' AS work_path FROM orders LEFT JOIN w ON l_orderkey = o_orderkey""",
    "exif_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(epoch_us(date_trunc('second', o_orderdate)) / 1e6 + ('0.' || (o_orderkey % 100))::DOUBLE, 6) END AS seconds FROM orders",
    "exif_summaries": """WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber AS n, l_quantity AS q, CASE WHEN l_linenumber = 5 THEN 2.5 ELSE l_discount END AS e, l_suppkey % 3 * 100 AS iso FROM lineitem)
      SELECT l_orderkey, l_linenumber, concat_ws(', ', CASE WHEN n % 2 = 0 THEN 'MAKER One' ELSE 'Maker Two' END, CASE WHEN n % 3 <> 0 THEN '50mm lens' END, CASE WHEN q > 0 THEN round_even(q, 0)::BIGINT || 'mm' END, CASE WHEN n >= 2 THEN format('f/{:.1f}', n - 2 + 0.5::DOUBLE) END,
        CASE WHEN e >= 1 THEN format('{:.1f}s', e) WHEN e > 0 THEN '1/' || round_even(1 / e, 0)::BIGINT || 's' END, CASE WHEN iso > 0 THEN 'ISO ' || iso END) AS summary FROM t""",
    "request_bodies": """SELECT conv_id, turn, '{"model":"model-' || role || '","max_tokens":300,"messages":[{"role":"user","content":[{"type":"image","source":{"type":"base64","media_type":"image/png","data":"' || base64(encode(text)) || '"}},{"type":"text","text":"Rate this.' || CASE WHEN turn % 2 = 0 THEN ' Detected: a dog' ELSE '' END || '"}]}]}' AS body FROM conversations""",
    "vision_cache_entries": "SELECT 'p/' || doc_id || '.vision.json' AS key, sha256(text) AS source_sha256, 'm' AS model, sha256('prompt') AS prompt_sha256, quality AS vision FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 AND quality IS NOT NULL",
    "cached_and_fresh": f"WITH {ad.METRIC_SQL} SELECT vec_id AS ord, round(composite, 6) AS composite, vec_id % 2 = 1 AS cached FROM metrics",
    "burst_scope": f"WITH {ad.METRIC_SQL}, r AS (SELECT vec_id, row_number() OVER (ORDER BY composite DESC, vec_id) AS technical_rank FROM metrics) SELECT vec_id, technical_rank FROM r WHERE technical_rank <= greatest({2 * scores.TOP}, trunc((SELECT count(*) FROM metrics) * 0.5))",
    "output_versions": "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'cropped_' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN 'hd_' || doc_id END, CASE WHEN doc_id % 5 = 0 THEN 'full' END) AS versions FROM documents",
    "bench_modes": f"""WITH {_RUNS}, r AS (SELECT mode, run, max(duration) AS duration, count(*) AS n, count(*) FILTER (bad) AS failed, avg(final_score) AS m, quantile_cont(final_score, 0.5) AS q FROM b GROUP BY mode, run)
      SELECT mode, count(*) AS runs, round(avg(duration), 6) AS mean_seconds, round(avg(duration / n), 6) AS seconds_an_image, round(avg(60 * n / duration), 6) AS images_a_minute, round(avg(failed), 6) AS mean_failed, round(avg(m), 6) AS mean_score, round(avg(q), 6) AS median_score FROM r GROUP BY mode""",
    "failed_in_bench": f"WITH {_RUNS} SELECT mode, run, count(*) FILTER (bad) AS failed FROM b GROUP BY mode, run",
}
