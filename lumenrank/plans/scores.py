"""Ranking, cuts, caches, blends and sums of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrank.functions import numeric, scoring, text
from lumenrank.functions.replies import KEYS
from lumenrank.operators import caches, ranking, reports
from lumenrank.plans import adapters as ad

TOP, SHARE = 10, 0.5


def _order(score):
    return ranking.best_first(F.col(score), F.col("vec_id"))


def rank_technical(spark, d):
    return ranking.numbered(ad.technical(spark, d).select("vec_id", "composite"), _order("composite"))


def score_summary(spark, d):
    df = ad.technical(spark, d)
    s = reports.summary(df, F.col("composite"))
    return s.select("n", *(F.round(c, 6).alias(c) for c in ("lowest", "highest", "mean", "median", "spread")))


def metric_means(spark, d):
    m = reports.metric_means(ad.technical(spark, d))
    return m.select(*(F.round(c, 6).alias(c) for c in scoring.WEIGHTS))


def score_histogram(spark, d):
    return reports.histogram(ad.technical(spark, d), F.col("composite"))


def candidate_funnel(spark, d):
    return ranking.share_cut(ad.technical(spark, d).select("vec_id", "composite"), _order("composite"), TOP, SHARE)


def final_score_blend(spark, d):
    return ad.scored(spark, d).select("vec_id", "scorer", "total", scoring.gate(F.col("crop_4x5")).alias("gate"), F.round("final_score", 6).alias("final_score"))


def failure_fallbacks(spark, d):
    why = F.when(~F.col("available"), "technical_only").when(F.col("failed"), "failed").when(F.col("total").isNull(), "default_total").otherwise("scored")
    return ad.scored(spark, d).select("vec_id", why.alias("outcome"), F.round("final_score", 6).alias("final_score"))


def scoring_counters(spark, d):
    df = failure_fallbacks(spark, d)
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome").isin("scored", "default_total")).alias("scored"), F.count_if(F.col("outcome") == "technical_only").alias("unavailable"))


def crop_gated_topn(spark, d):
    df = ranking.crop_gated_top(ad.scored(spark, d), TOP, F.col("crop_4x5"), F.col("final_score"), F.col("vec_id"))
    return df.select("vec_id", "crop_safe", F.round("final_score", 6).alias("final_score"))


def clip_scores(spark, d):
    logits = F.transform(F.slice("embedding", 1, 6), lambda x: 4 * x.cast("double"))
    p = scoring.clip_payload(logits)
    return ad.table(spark, d, "embeddings").select("vec_id", *(p[k].alias(k) for k in (*KEYS, "total")))


def _items(spark, d):
    """Documents as items: a path, a time of change, and the hashes that caches go by."""
    sha = F.sha2("text", 256)
    return ad.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), (F.col("n_chars") / 8).alias("mtime"), sha.alias("source_sha256"), F.sha2(F.concat(F.lit("prompt "), F.col("lang")), 256).alias("prompt_sha256"), F.element_at(F.array(F.lit("model-a"), F.lit("model-b")), (F.col("doc_id") % 2 + 1).cast("int")).alias("model"))


def _technical_cache(items):
    """Entries of two thirds of the items; a quarter of those is stale."""
    stale = F.when(F.col("doc_id") % 4 == 1, F.col("mtime") + 1).otherwise(F.col("mtime"))
    return items.where("doc_id % 3 <> 0").select("path", stale.alias("mtime"), F.round(F.col("mtime") % 1, 6).alias("scores"))


def _vision_cache(items):
    return items.where("doc_id % 5 < 2").select("source_sha256", "prompt_sha256", F.lit("model-a").alias("model"), F.length("source_sha256").alias("vision"))


def tech_cache_lookup(spark, d):
    items = _items(spark, d)
    return caches.technical_lookup(items, _technical_cache(items)).select("doc_id", caches.technical_key(F.col("path")).alias("entry"), "scores", "hit")


def vision_cache_lookup(spark, d):
    items = _items(spark, d)
    cache = _vision_cache(items)
    lax = caches.vision_lookup(items, cache, strict=False).select("doc_id", F.col("hit").alias("lax_hit"))
    strict = caches.vision_lookup(items, cache, strict=True).select(F.col("doc_id").alias("d"), F.col("hit").alias("strict_hit"))
    return lax.join(strict, F.col("doc_id") == F.col("d")).drop("d")


def uncached_cost(spark, d):
    items = _items(spark, d)
    return caches.cost(items, _vision_cache(items), ["source_sha256", "prompt_sha256"]).withColumn("cost", F.round("cost", 6))


def cache_to_do(spark, d):
    items = _items(spark, d)
    return caches.to_do(items, _vision_cache(items), ["source_sha256", "prompt_sha256"]).select("doc_id", "path")


def cache_update(spark, d):
    """The technical cache with entries of this run in place of stale and missing ones, counted by age."""
    items = _items(spark, d)
    cache = _technical_cache(items)
    hits = caches.technical_lookup(items, cache)
    fresh = hits.where(~F.col("hit")).select("path", "mtime", F.lit(-1.0).alias("scores"))
    out = caches.added(cache, fresh, ["path"])
    return out.groupBy((F.col("scores") == -1).alias("fresh")).agg(F.count("*").alias("entries"), F.countDistinct("path").alias("paths"))


def content_sha256(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def exact_duplicate_groups(spark, d):
    df = content_sha256(spark, d).groupBy("sha256").agg(F.array_sort(F.collect_list("doc_id")).alias("members"), F.count("*").alias("n"))
    return df.where("n > 1").select("sha256", "members", "n", (F.col("n") - 1).alias("removed"))


def _sizes(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", (100 + F.col("n_chars") % 4000).alias("w"), (100 + F.col("doc_id") * 37 % 4000).alias("h"))


def resized_dims(spark, d):
    return _sizes(spark, d).select("doc_id", numeric.shrunk(F.col("w"), F.col("h"), 1920).alias("work"), numeric.shrunk(F.col("w"), F.col("h"), 1024, 1).alias("sent")).select("doc_id", F.col("work.w").alias("work_w"), F.col("work.h").alias("work_h"), F.col("sent.w").alias("sent_w"), F.col("sent.h").alias("sent_h"))


def padded_dims(spark, d):
    return _sizes(spark, d).select("doc_id", numeric.fitted(F.col("w"), F.col("h"), 1080, 1440).alias("f")).select("doc_id", "f.w", "f.h", "f.x", "f.y")


QUERIES = {f.__name__: f for f in (rank_technical, score_summary, metric_means, score_histogram, candidate_funnel, final_score_blend, failure_fallbacks, scoring_counters, crop_gated_topn, clip_scores, tech_cache_lookup, vision_cache_lookup, uncached_cost, cache_to_do, cache_update, content_sha256, exact_duplicate_groups, resized_dims, padded_dims)}

_OUTCOME = "CASE WHEN NOT available THEN 'technical_only' WHEN failed THEN 'failed' WHEN total IS NULL THEN 'default_total' ELSE 'scored' END"
_ITEMS = "items AS (SELECT doc_id, '/in/' || doc_id || '.jpg' AS path, n_chars / 8.0::DOUBLE AS mtime, sha256(text) AS source_sha256, sha256('prompt ' || lang) AS prompt_sha256, CASE doc_id % 2 WHEN 0 THEN 'model-a' ELSE 'model-b' END AS model FROM documents)"
_TECH = f"{_ITEMS}, cache AS (SELECT path, CASE WHEN doc_id % 4 = 1 THEN mtime + 1 ELSE mtime END AS mtime, round(mtime % 1, 6) AS scores FROM items WHERE doc_id % 3 <> 0)"
_VISION = f"{_ITEMS}, cache AS (SELECT DISTINCT source_sha256, prompt_sha256, 'model-a' AS model FROM items WHERE doc_id % 5 < 2)"
_DIMS = "s AS (SELECT doc_id, 100 + n_chars % 4000 AS w, 100 + doc_id * 37 % 4000 AS h FROM documents)"


def _shrunk_sql(limit: int, least: int, name: str) -> str:
    scale = f"(CASE WHEN greatest(w, h) > {limit} THEN {limit}.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END)"
    return ", ".join(f"greatest(trunc({c} * {scale})::BIGINT, {least}) AS {name}_{c}" for c in "wh")


_CLIP = "c0 AS (SELECT vec_id, list_transform(embedding[1:6], lambda v: exp(4 * v::DOUBLE)) AS e FROM embeddings), c1 AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM c0), c AS (SELECT vec_id, p, (p[1] + p[2] + p[3] + p[4]) / 4 - (p[5] + p[6]) / 2 AS o FROM c1)"

SQL = {
    "rank_technical": f"WITH {ad.METRIC_SQL} SELECT vec_id, composite, row_number() OVER (ORDER BY composite DESC, vec_id) AS rank FROM metrics",
    "score_summary": f"WITH {ad.METRIC_SQL} SELECT count(composite) AS n, round(min(composite), 6) AS lowest, round(max(composite), 6) AS highest, round(avg(composite), 6) AS mean, round(quantile_cont(composite, 0.5), 6) AS median, round(stddev_pop(composite), 6) AS spread FROM metrics",
    "metric_means": f"WITH {ad.METRIC_SQL} SELECT {', '.join(f'round(avg(coalesce({m}, 0)), 6) AS {m}' for m in scoring.WEIGHTS)} FROM metrics",
    "score_histogram": f"WITH {ad.METRIC_SQL}, c AS (SELECT least(floor(composite * 10), 9)::INT AS bin, count(*) AS n FROM metrics WHERE composite BETWEEN 0 AND 1 GROUP BY 1), b AS (SELECT unnest(range(10))::INT AS bin) SELECT b.bin, b.bin / 10.0::DOUBLE AS low, coalesce(n, 0) AS n, repeat('#', floor(coalesce(n, 0) * 30.0::DOUBLE / (SELECT max(n) FROM c))::INT) AS bar FROM b LEFT JOIN c ON b.bin = c.bin",
    "candidate_funnel": f"WITH {ad.METRIC_SQL}, r AS (SELECT vec_id, composite, row_number() OVER (ORDER BY composite DESC, vec_id) AS rank FROM metrics) SELECT vec_id, composite, rank FROM r WHERE rank <= greatest({TOP}, trunc((SELECT count(*) FROM metrics) * {SHARE}))",
    "final_score_blend": f"WITH {ad.SCORED_SQL} SELECT vec_id, scorer, total, ({ad.GATE_SQL})::DOUBLE AS gate, round(final_score, 6) AS final_score FROM scored",
    "failure_fallbacks": f"WITH {ad.SCORED_SQL} SELECT vec_id, {_OUTCOME} AS outcome, round(final_score, 6) AS final_score FROM scored",
    "scoring_counters": f"WITH {ad.SCORED_SQL}, o AS (SELECT {_OUTCOME} AS outcome FROM scored) SELECT count(*) AS n, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome IN ('scored', 'default_total')) AS scored, count(*) FILTER (outcome = 'technical_only') AS unavailable FROM o",
    "crop_gated_topn": f"WITH {ad.SCORED_SQL}, r AS (SELECT vec_id, crop_4x5 >= 6 AS crop_safe, final_score FROM scored ORDER BY 2 DESC, final_score DESC, vec_id LIMIT {TOP}) SELECT vec_id, crop_safe, round(final_score, 6) AS final_score FROM r",
    "clip_scores": f"WITH {_CLIP} SELECT vec_id, trunc(p[1] * 30 + 3)::BIGINT AS subject_clarity, trunc(p[1] * 20 + 3)::BIGINT AS lighting, trunc(p[3] * 20 + 3)::BIGINT AS color_pop, trunc(p[4] * 20 + 3)::BIGINT AS emotion, trunc(o * 20 + 5)::BIGINT AS scroll_stop, 5::BIGINT AS crop_4x5, least(greatest(trunc(o * 120 + 30), 0), 60)::BIGINT AS total FROM c",
    "tech_cache_lookup": f"WITH {_TECH} SELECT doc_id, i.path || '.techscore.json' AS entry, scores, scores IS NOT NULL AS hit FROM items i LEFT JOIN cache c ON i.path = c.path AND i.mtime = c.mtime",
    "vision_cache_lookup": f"WITH {_VISION} SELECT doc_id, EXISTS (SELECT 1 FROM cache c WHERE c.source_sha256 = i.source_sha256 AND c.prompt_sha256 = i.prompt_sha256) AS lax_hit, EXISTS (SELECT 1 FROM cache c WHERE c.source_sha256 = i.source_sha256 AND c.prompt_sha256 = i.prompt_sha256 AND c.model = i.model) AS strict_hit FROM items i",
    "uncached_cost": f"WITH {_VISION}, m AS (SELECT i.doc_id, c.model IS NULL AS miss FROM items i LEFT JOIN cache c USING (source_sha256, prompt_sha256)) SELECT count(*) AS items, count(*) FILTER (miss) AS uncached, round((count(*) FILTER (miss)) * 0.005::DOUBLE, 6) AS cost FROM m",
    "cache_to_do": f"WITH {_VISION} SELECT doc_id, path FROM items i WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.source_sha256 = i.source_sha256 AND c.prompt_sha256 = i.prompt_sha256)",
    "cache_update": f"WITH {_TECH}, f AS (SELECT i.path FROM items i LEFT JOIN cache c ON i.path = c.path AND i.mtime = c.mtime WHERE c.path IS NULL), u AS (SELECT path, false AS fresh FROM cache WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT path, true FROM f) SELECT fresh, count(*) AS entries, count(DISTINCT path) AS paths FROM u GROUP BY fresh",
    "content_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "exact_duplicate_groups": "SELECT sha256(text) AS sha256, list(doc_id ORDER BY doc_id) AS members, count(*) AS n, count(*) - 1 AS removed FROM documents GROUP BY 1 HAVING count(*) > 1",
    "resized_dims": f"WITH {_DIMS} SELECT doc_id, {_shrunk_sql(1920, 0, 'work')}, {_shrunk_sql(1024, 1, 'sent')} FROM s",
    "padded_dims": f"WITH {_DIMS}, f AS (SELECT doc_id, greatest(trunc(w * least(1080.0::DOUBLE / w, 1440.0::DOUBLE / h))::BIGINT, 1) AS a, greatest(trunc(h * least(1080.0::DOUBLE / w, 1440.0::DOUBLE / h))::BIGINT, 1) AS b FROM s) SELECT doc_id, a AS w, b AS h, floor((1080 - a) / 2.0)::BIGINT AS x, floor((1440 - b) / 2.0)::BIGINT AS y FROM f",
}
