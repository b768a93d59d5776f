"""The whole selection on a folder of pictures: scan, resize, group, score, rank, crop, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.functions import pixels as px
from lumenrank.functions import scoring, text
from lumenrank.functions.replies import PAYLOAD
from lumenrank.operators import caches, crop, dedup, pictures, ranking, reports
from lumenrank.sources import files, galleries, scorers
from lumenrank.sources.shared import materialise

HASH_WORDS = 4


@dataclass
class Options:
    """What a run may be told. make_call makes a client in each task; without one the technical score ranks alone."""

    top: int = 10
    share: float = 0.5
    all_scored: bool = False
    limit: int = 1920
    out_w: int = 1080
    out_h: int = 1440
    scorer: str = "ollama"
    model: str = "qwen2.5vl:7b"
    account: str = text.DEFAULT_CONTEXT
    max_edge: int = 1024
    crop_first: bool = False
    make_call: Callable[[], scorers.Call] | None = None
    call_options: dict = field(default_factory=dict)
    subjects: DataFrame | None = None  # (path, box, kind, facing): what a detector found


def prepared(spark: SparkSession, folder: str, work: str, limit: int = 1920) -> DataFrame:
    """(path, ord, mtime, taken, height, width, channels, data): pictures as they are meant to be seen, resized once.

    work keeps what was made; a source not newer than its copy is not decoded again. ord is the place by name; the
    source's path is the key from end to end, so pictures that only differ in their extension stay apart.
    """
    listed = ranking.numbered(files.pictures(spark, folder), [text.file_name(F.col("path")), F.col("path")], "ord")
    done = files.work(spark, work)
    state = caches.fresh(listed, done) if done is not None else listed.withColumn("reusable", F.lit(False))
    todo = materialise(state, "scan")
    decoded = files.rasters(spark, folder).join(files.tags(spark, folder).withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "left").drop("p")
    made = decoded.join(todo.where("not reusable").select("path", F.col("mtime")), "path")
    made = pictures.resized(made, limit, "orientation").where("error is null").drop("error")
    made.write.mode("append").parquet(f"{work}/pictures")
    newest = files.work(spark, work).groupBy("path").agg(F.max_by(F.struct("taken", "height", "width", "channels", "data"), "mtime").alias("x"))
    return todo.select("path", "ord", "mtime").join(newest, "path").select("path", "ord", "mtime", "x.*")


def _likeness(a, b) -> tuple[float, float | None]:
    return px.match_share(list(a.descriptors), list(b.descriptors)), px.correlation(list(a.histogram), list(b.histogram))


def deduplicated(pics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique, bursts). unique: (path, ord, place), one picture of each burst, in the order in which bursts begin; bursts: (chain, path, ord, is_rep).

    First near-equal hashes: the sharpest of each group goes on. Then bursts among these, by time and likeness. Pictures
    whose hash fails are left out.
    """
    f = materialise(pictures.features(pics.select("path", "ord", "taken", "height", "width", "channels", "data")).where("hash is not null").drop("height", "width", "channels", "error"), "features")
    edges = dedup.hamming_pairs(f, "ord", "hash", HASH_WORDS).select("a", "b")
    led = dedup.leaders(f.select("ord"), edges)
    sharp = f.select("path", F.col("ord").alias("o"), "quick_sharpness").join(led, F.col("o") == F.col("ord"))
    best = ranking.best_of_group(sharp, "leader", F.col("quick_sharpness"), F.col("o"), F.col("o")).select(F.col("best").alias("kept"))
    kept = f.join(best, F.col("ord") == F.col("kept")).drop("kept", "hash")
    # seconds in groups' own order: groups come in the order of their leaders
    kept = kept.join(led.select(F.col("ord").alias("x"), "leader"), F.col("ord") == F.col("x")).drop("x")
    timed = dedup.sessions(kept, F.col("taken"), F.col("leader"))
    chained = materialise(dedup.chains(timed.drop("ord", "gap_seconds").withColumnRenamed("leader", "ord"), "session_id", "ord long, session_id long, chain long", _likeness), "chains")
    members = kept.select("path", "ord", "leader", "taken", "quick_sharpness").join(chained.select(F.col("ord").alias("l"), "chain"), F.col("leader") == F.col("l"))
    rep = ranking.first_of_group(members, ["chain"], [F.col("quick_sharpness").desc(), F.col("taken").asc_nulls_last(), F.col("leader")])
    bursts = materialise(rep.select("chain", "path", "ord", (F.col("place") == 1).alias("is_rep"), "taken", "leader"), "bursts")
    unique = ranking.numbered(bursts.where("is_rep").join(bursts.groupBy(F.col("chain").alias("c")).agg(F.min(F.struct(F.col("taken").isNull(), "taken", "leader")).alias("begin")), F.col("chain") == F.col("c")).select("chain", "path", "ord", "begin"), [F.col("begin")], "place")
    return unique.drop("begin"), bursts.select("chain", "path", "ord", "is_rep")


def _measured(pics: DataFrame, subjects: DataFrame | None) -> DataFrame:
    """Technical metrics of pictures, written once."""
    rows = pics.select("path", "height", "width", "channels", "data")
    if subjects is not None:
        rows = rows.join(subjects.select(F.col("path").alias("p"), "box"), F.col("path") == F.col("p"), "left").drop("p")
    return materialise(pictures.technical(rows, "box" if subjects is not None else None).where("error is null").drop("error", "channels"), "technical")


def swapped(ranked: DataFrame, bursts: DataFrame, pics: DataFrame, scope: int, subjects: DataFrame | None = None) -> DataFrame:
    """ranked (path, ord, chain, technical_rank, metrics) with the best member of each burst among the first scope rows in place of its representative; members and selected_by are added.

    A member takes over only if its composite is greater. Bursts beyond the scope keep the sharpest.
    """
    size = bursts.groupBy(F.col("chain").alias("b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("m"))
    base = ranked.join(size, F.col("chain") == F.col("b")).drop("b").withColumn("members", F.when(F.col("n") > 1, F.col("m.path")).otherwise(F.array("path"))).drop("m")
    again = base.where((F.col("n") > 1) & (F.col("technical_rank") <= scope)).select(F.col("chain").alias("c"))
    others = bursts.where("not is_rep").join(again, F.col("chain") == F.col("c"), "left_semi").select(F.col("path").alias("p"), F.col("ord").alias("o"), "chain")
    metrics = _measured(pics.join(others.select("p"), F.col("path") == F.col("p"), "left_semi"), subjects)
    rivals = others.join(metrics, F.col("p") == F.col("path")).drop("p").select("chain", F.struct("composite", (-F.col("o")).alias("k"), "path", F.col("o").alias("ord"), "height", "width", *(F.col(m) for m in pictures.METRICS[:-1])).alias("r"))
    best = rivals.groupBy(F.col("chain").alias("c")).agg(F.max("r").alias("r"))
    both = base.join(best, F.col("chain") == F.col("c"), "left").drop("c")
    better = F.coalesce(F.col("r.composite") > F.col("composite"), F.lit(False))
    cols = {k: F.when(better, F.col(f"r.{k}")).otherwise(F.col(k)) for k in ("path", "ord", "height", "width", *pictures.METRICS)}
    by = F.when(better, "technical").when(F.col("n") > 1, "sharpness").otherwise("")
    return both.select("chain", "members", by.alias("selected_by"), *(v.alias(k) for k, v in cols.items()))


def _subject(df: DataFrame, subjects: DataFrame | None) -> DataFrame:
    """df with a subject box, kind and facing: what a detector found, or the middle of the frame."""
    if subjects is not None:
        s = subjects.select(F.col("path").alias("sp"), F.col("box").alias("sb"), F.col("kind").alias("sk"), F.col("facing").alias("sf"))
        df = df.join(s, F.col("path") == F.col("sp"), "left").drop("sp")
    else:
        df = df.withColumns({"sb": F.lit(None).cast("struct<x: bigint, y: bigint, w: bigint, h: bigint>"), "sk": F.lit(None).cast("string"), "sf": F.lit(None).cast("string")})
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    middle = {"x": F.floor(w / 4), "y": F.floor(h / 4), "w": F.floor(w / 2), "h": F.floor(h / 2)}
    return df.withColumns({"img_w": w, "img_h": h, "kind": F.coalesce("sk", F.lit("fallback")), "facing": F.coalesce("sf", F.lit("head-on")), **{f"s_{k}": F.coalesce(F.col("sb")[k], v).cast("long") for k, v in middle.items()}}).drop("sb", "sk", "sf")


def windows(df: DataFrame, subjects: DataFrame | None, ratio: float) -> DataFrame:
    """df (path, height, width) with the crop window, its doubts, and debug, what led to it, as JSON."""
    df = crop.doubts(crop.chosen(_subject(df, subjects), ratio))
    debug = F.to_json(F.struct(F.col("chosen").alias("selected_candidate"), F.array("crop_x", "crop_y", "crop_w", "crop_h").alias("crop_window_xywh"), F.array("s_x", "s_y", "s_w", "s_h").alias("expanded_bbox_xywh"), "kind", "facing", "shot", "mode", "candidates", "min_gap_px", "gap_px_threshold", F.col("uncertain").alias("uncertain_crop"), F.col("reasons").alias("uncertain_crop_reasons")))
    return df.withColumn("debug", debug)


def judged(cut: DataFrame, pics: DataFrame, o: Options) -> DataFrame:
    """cut with mode, error, vision and final_score: replies of the model, or the technical score alone where there is none to ask."""
    if o.make_call is None:
        return cut.withColumns({"mode": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "vision": F.lit(None).cast(PAYLOAD), "final_score": F.col("composite")})
    rows = cut.select(F.col("path").alias("p")).join(pics, F.col("p") == F.col("path")).drop("p")
    if o.crop_first:  # the model sees the crop; a picture that cannot be cut is sent whole
        cut_out = pictures.cropped(windows(rows, o.subjects, o.out_w / o.out_h), o.out_w, o.out_h)
        items = cut_out.select("path", text.base64_text(F.col("image")).alias("payload")).where("payload is not null")
    else:
        items = pictures.payload(rows.select("path", "height", "width", "channels", "data"), o.max_edge).select("path", "payload")
    said = scorers.scored(materialise(items, "payloads"), o.make_call, F.lit(o.model), F.lit(o.account), F.lit(o.max_edge), **o.call_options)
    said = said.select(F.col("path").alias("p"), "mode", "error", "vision")
    both = cut.join(said, F.col("path") == F.col("p"), "left").drop("p")
    final = scoring.final_score(F.col("composite"), F.col("vision.total"), F.col("vision.crop_4x5"), F.lit(o.scorer), F.col("vision").isNull(), F.lit(True))
    return both.withColumn("final_score", final)


def select(spark: SparkSession, folder: str, out: str, work: str, options: Options | None = None) -> dict[str, DataFrame]:
    """Run all stages and write pictures, debug files, reports and a gallery to out. Returns the tables of each stage: unique, bursts, ranked, scored, top, report."""
    o = options or Options()
    pics = materialise(prepared(spark, folder, work, o.limit), "pictures")
    unique, bursts = deduplicated(pics)
    unique = materialise(unique, "unique")
    reps = _measured(pics.join(unique.select(F.col("path").alias("p")), F.col("path") == F.col("p"), "left_semi"), o.subjects)
    ranked = ranking.numbered(unique.select(F.col("path").alias("p"), "ord", "chain", "place").join(reps, F.col("p") == F.col("path")).drop("p"), ranking.best_first(F.col("composite"), F.col("place")), "technical_rank")
    ranked = materialise(ranked, "ranked")
    n = ranked.count()
    again = materialise(swapped(ranked, bursts, pics, max(2 * o.top, int(n * 0.5)), o.subjects), "swapped")
    order = ranking.best_first(F.col("composite"), F.col("ord"))
    cut = again if o.all_scored else ranking.share_cut(again, order, o.top, o.share, "technical_rank").drop("technical_rank")
    scored = materialise(judged(cut, pics, o), "scored")
    gated = o.make_call is not None and o.scorer in scoring.GATED_SCORERS
    best = ranking.best_first(F.col("final_score"), F.col("ord"))
    if gated:
        top = ranking.crop_gated_top(scored, o.top, F.col("vision.crop_4x5"), F.col("final_score"), F.col("ord"))
        best = [F.col("crop_safe").desc(), *best]
    else:
        top = scored.orderBy(*best).limit(o.top)
    top = materialise(ranking.numbered_few(top, best), "top")
    shot = windows(top.select("path", "height", "width"), o.subjects, o.out_w / o.out_h)
    images = pictures.cropped(shot.join(pics.select(F.col("path").alias("p"), "channels", "data"), F.col("path") == F.col("p")).drop("p"), o.out_w, o.out_h)
    images = materialise(images.select(F.col("path").alias("p"), "hd", "image", "fallback", "debug", "uncertain", "reasons"), "crops")
    rows = top.join(images, F.col("path") == F.col("p"), "left").drop("p")
    doubt = F.when(F.col("fallback").isNotNull(), F.array_append(F.coalesce("reasons", F.array().cast("array<string>")), F.col("fallback"))).otherwise(F.col("reasons"))
    rows = rows.withColumns({"total": F.col("vision.total"), "line": F.col("vision.one_line"), "cropped": F.col("image").isNotNull(), "reasons": doubt, "uncertain": F.coalesce(F.size(doubt) > 0, F.lit(True))})
    report = reports.report_rows(rows, ".png")
    files.write_files(rows.select(F.explode(F.array(F.struct(text.ranked_name(F.col("rank"), "cropped", text.stem(F.col("path")), ".png").alias("name"), F.col("image").alias("content")), F.struct(text.ranked_name(F.col("rank"), "hd", text.stem(F.col("path")), ".png").alias("name"), F.col("hd").alias("content")), F.struct(F.concat(text.ranked_name(F.col("rank"), "cropped", text.stem(F.col("path")), ".json")).alias("name"), F.col("debug").cast("binary").alias("content")))).alias("f")).select("f.*").where("content is not null"), out)
    files.write_report(report, out)
    galleries.write_markdown(report, scored, out, folder, o.scorer if o.make_call else None)
    galleries.write_gallery(report, out, "..")
    return {"unique": unique, "bursts": bursts, "ranked": again, "scored": scored, "top": top, "report": report}


def dedup_only(spark: SparkSession, folder: str, out: str, work: str, options: Options | None = None) -> DataFrame:
    """One picture of each burst, best by technical score whatever its place, cropped; no ranking. (place, path, chain, members, selected_by, fallback), in the order in which bursts begin."""
    o = options or Options()
    pics = materialise(prepared(spark, folder, work, o.limit), "pictures")
    unique, bursts = deduplicated(pics)
    unique = materialise(unique, "unique")
    reps = _measured(pics.join(unique.select(F.col("path").alias("p")), F.col("path") == F.col("p"), "left_semi"), o.subjects)
    ranked = unique.select(F.col("path").alias("p"), "ord", "chain", F.col("place").alias("technical_rank")).join(reps, F.col("p") == F.col("path"), "left").withColumn("path", F.coalesce("path", "p")).drop("p")
    best = swapped(ranked, bursts, pics, 1 << 40, o.subjects).join(unique.select(F.col("chain").alias("u"), "place"), F.col("chain") == F.col("u")).drop("u")
    best = materialise(best, "dedup-only")
    shot = windows(best.select("path", "height", "width"), o.subjects, o.out_w / o.out_h).join(pics.select(F.col("path").alias("p"), "channels", "data"), F.col("path") == F.col("p")).drop("p")
    images = materialise(pictures.cropped(shot, o.out_w, o.out_h).select(F.col("path").alias("p"), "image", "fallback"), "crops")
    rows = best.join(images, F.col("path") == F.col("p"), "left").drop("p")
    files.write_files(rows.where("image is not null").select(text.ranked_name(F.col("place"), "unique", text.stem(F.col("path")), ".png").alias("name"), F.col("image").alias("content")), out)
    table = rows.select("place", "path", "chain", "members", "selected_by", "fallback")
    galleries.write_dedup_gallery(table, out)
    return table
