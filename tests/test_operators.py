"""Operators against plain loops, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lumenrank.__main__ import main
from lumenrank.operators import caches, crop, dedup, ranking, reports
from lumenrank.operators import detections as det
from lumenrank.sources import files
from lumenrank.streaming import sessions as stream


def walk(n, edges):
    near = {frozenset(e) for e in edges}
    leads, out = [], {}
    for i in range(n):
        out[i] = next((q for q in leads if frozenset((i, q)) in near), None)
        if out[i] is None:
            leads.append(i)
            out[i] = i
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaders_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(60)]
    nodes = spark.range(n).select(F.col("id").alias("ord"))
    got = {r.ord: r.leader for r in dedup.leaders(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == walk(n, [e for e in edges if e[0] != e[1]])


def test_leaders_empty(spark):
    nodes = spark.range(0).select(F.col("id").alias("ord"))
    assert dedup.leaders(nodes, spark.createDataFrame([], "a long, b long")).count() == 0


def test_hamming_pairs_lose_nothing(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(256) for _ in range(8)]
    full = [b ^ sum(1 << rng.randrange(256) for _ in range(rng.randrange(7))) for b in base for _ in range(6)] + base[:2]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(i, [signed(h >> (64 * w) & (2**64 - 1)) for w in range(4)]) for i, h in enumerate(full)] + [(999, None)]
    got = {(r.a, r.b): r.distance for r in dedup.hamming_pairs(spark.createDataFrame(rows, "id long, words array<long>"), "id", "words", 4).collect()}
    want = {(i, j): (full[i] ^ full[j]).bit_count() for j in range(len(full)) for i in range(j) if (full[i] ^ full[j]).bit_count() <= 8}
    assert got == want and want


def test_sessions_at_the_gap(spark):
    times = [0.0, 3.0, 6.0, 9.5, 3599.0, 3601.5, 7200.0, 20000.0, None]
    df = spark.createDataFrame(list(enumerate(times)), "ord long, t double")
    got = {r.ord: r.session_id for r in dedup.sessions(df, F.col("t"), F.col("ord")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4, 7: 5, 8: 0}


def test_near_duplicate_rules():
    assert dedup.near_duplicate(3.0, 0.25, 0.60) and not dedup.near_duplicate(3.01, 0.25, 0.99)
    assert not dedup.near_duplicate(1.0, 0.24, 0.99) and not dedup.near_duplicate(1.0, 0.5, None)
    assert dedup.near_duplicate(None, 0.25, 0.92) and not dedup.near_duplicate(None, 0.25, 0.91)


def test_chains_follow_the_last_member(spark):
    rows = [(1, i, t, v) for i, (t, v) in enumerate([(0.0, 0.0), (1.0, 30.0), (2.0, 60.0), (2.5, 0.0), (9.0, 60.0)])] + [(2, 9, 50.0, 1.0), (3, 10, None, 0.0), (3, 11, None, 5.0), (3, 12, None, 50.0)]
    df = spark.createDataFrame(rows, "s long, ord long, seconds double, value double")
    out = dedup.chains(df, "s", "ord long, s long, chain long", lambda a, b: (0.5, 1 - abs(a.value - b.value) / 100))
    assert {r.ord: r.chain for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 9: 9, 10: 10, 11: 10, 12: 12}


def test_numbered_and_cut(spark):
    rows = [(i, (i * 7) % 5 / 5) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, s double")
    got = [r.id for r in ranking.numbered(df, ranking.best_first(F.col("s"), F.col("id"))).orderBy("rank").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert ranking.share_cut(df, ranking.best_first(F.col("s"), F.col("id")), 3, 0.25).count() == 12
    assert ranking.numbered(df.where("id < 0"), [F.col("id")]).count() == 0


def test_crop_gate_prefers_safe(spark):
    df = spark.createDataFrame([("a", 54, 9, 0.0), ("b", 58, 5, 1.0), ("c", 50, 8, 2.0)], "n string, total long, crop long, ord double").withColumn("final", F.col("total") / 60.0)
    top = ranking.crop_gated_top(df, 2, F.col("crop"), F.col("final"), F.col("ord"))
    assert [r.n for r in top.collect()] == ["a", "c"]
    assert {r.n for r in ranking.crop_gated_top(df, 3, F.col("crop"), F.col("final"), F.col("ord")).collect()} == {"a", "b", "c"}


def test_swap_needs_more(spark):
    df = spark.createDataFrame([(1, 1, 0.5, True), (1, 2, 0.5, False), (2, 3, 0.4, True), (2, 4, 0.6, False), (2, 5, 0.6, False), (3, 6, None, True)], "g int, id long, s double, rep boolean")
    got = {r.g: (r.rep, r.chosen, r.selected_by) for r in ranking.swapped(df, "g", "id", F.col("rep"), F.col("s"), F.col("id")).collect()}
    assert got == {1: (1, 1, "sharpness"), 2: (3, 4, "technical"), 3: (6, 6, "")}


def crop_of(spark, img_w, img_h, box, kind, facing, ratio=0.75):
    df = spark.createDataFrame([(img_w, img_h, *box, kind, facing)], "img_w long, img_h long, s_x long, s_y long, s_w long, s_h long, kind string, facing string")
    return crop.doubts(crop.chosen(df, ratio)).first()


def test_crop_windows(spark):
    r = crop_of(spark, 1200, 800, (500, 200, 200, 300), "", "head-on")
    assert (r.crop_w, r.crop_h, r.crop_y) == (600, 800, 0)
    r = crop_of(spark, 1000, 400, (100, 40, 800, 320), "", "right")
    assert (r.chosen, r.crop_x) == ("ideal", 350) and "subject_larger_than_crop" in r.reasons
    r = crop_of(spark, 800, 1200, (180, 0, 440, 1180), "rider_motorcycle", "head-on")
    assert (r.chosen, r.crop_y) == ("top_preserve", 0)
    r = crop_of(spark, 750, 1000, (10, 10, 100, 100), "", "left")
    assert (r.chosen, r.crop_x, r.crop_y, r.crop_w, r.crop_h) == ("no_crop", 0, 0, 750, 1000)


def test_crop_bounds(spark):
    df = spark.createDataFrame([(1000, 427, 300, 100, 200, 100, "", "left")], "img_w long, img_h long, s_x long, s_y long, s_w long, s_h long, kind string, facing string")
    r = crop.candidates(df).first()
    assert (r.crop_w, r.gap_px, r.bound_lo, r.bound_hi) == (320, 9, 189, 291)
    assert all(189 <= c["start"] <= 291 for c in r.candidates)


DETECTED = "image long, img_w long, img_h long, ord long, x long, y long, w long, h long, cls_id int, conf double"


def test_rider_and_motorcycle_join(spark):
    person, near, far = (1, 1200, 800, 2, 300, 200, 180, 400, 0, 0.9), (1, 1200, 800, 1, 330, 350, 280, 300, 3, 0.82), (2, 1200, 800, 1, 900, 100, 180, 180, 3, 0.95)
    df = spark.createDataFrame([person, near, (2, *person[1:]), far], DETECTED)
    got = {r.image: r for r in det.merged_subjects(df, "image", ["img_w", "img_h"]).collect()}
    assert tuple(got[1])[3:9] == (300, 200, 310, 450, "rider_motorcycle", 0.9)
    assert got[2].kind == "person"
    assert det.merged_subjects(df.where("image > 5"), "image", ["img_w", "img_h"]).count() == 0


def test_caches(spark):
    items = spark.createDataFrame([("a", 1.0, "s1", "p", "m"), ("b", 2.0, "s2", "p", "m"), ("c", 3.0, "s3", "p", "m")], "path string, mtime double, source_sha256 string, prompt_sha256 string, model string")
    tech = spark.createDataFrame([("a", 1.0, 0.5), ("a", 1.0, 0.7), ("b", 2.0000001, 0.5), ("c", 3.0, None)], "path string, mtime double, scores double")
    assert {r.path: r.scores for r in caches.technical_lookup(items, tech).collect()} == {"a": 0.7, "b": None, "c": None}
    vis = spark.createDataFrame([("s1", "p", "m", 1), ("s2", "p", "other", 2), ("s3", "q", "m", 3)], "source_sha256 string, prompt_sha256 string, model string, vision int")
    assert {r.path: r.hit for r in caches.vision_lookup(items, vis, True).collect()} == {"a": True, "b": False, "c": False}
    assert {r.path: r.hit for r in caches.vision_lookup(items, vis, False).collect()} == {"a": True, "b": True, "c": False}
    row = caches.cost(items, vis, ["source_sha256", "prompt_sha256"]).first()
    assert (row["items"], row.uncached, row.cost) == (3, 1, 0.005)
    fresh = items.select("path", "mtime", F.lit(9.0).alias("scores")).where("path = 'a'")
    assert sorted(tuple(r) for r in caches.added(tech, fresh, ["path"]).where("path = 'a'").collect()) == [("a", 1.0, 9.0)]


def test_reports_of_nothing(spark):
    df = spark.createDataFrame([], "composite double")
    assert reports.summary(df, F.col("composite")).first().n == 0
    h = reports.histogram(df, F.col("composite")).collect()
    assert len(h) == 10 and all(r.n == 0 and r.bar == "" for r in h)


def test_histogram_closes_at_one(spark):
    df = spark.createDataFrame([(1.0,), (0.95,), (0.0,), (1.5,)], "c double")
    assert {r.bin: r.n for r in reports.histogram(df, F.col("c")).collect() if r.n} == {0: 1, 9: 2}


def test_leaders_of_long_chains(spark):
    """A path of a thousand items is walked, not decided link by link; rounds give the same."""
    n = 1000
    nodes = spark.range(n + 2).select(F.col("id").alias("ord"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.ord: r.leader for r in dedup.leaders(nodes, edges).collect()}
    assert got == {i: i - i % 2 for i in range(n)} | {n: n, n + 1: n + 1}
    few = edges.where("a < 9 or a between 100 and 102")
    assert sorted(dedup.leaders(nodes, few, walked=5).collect()) == sorted(dedup.leaders(nodes, few).collect())


def test_rows_without_a_time_are_kept(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 11.0), (3, None), (4, 99.0), (5, None)], "ord long, t double")
    got = {r.ord: (r.session_id, r.gap_seconds) for r in dedup.sessions(df, F.col("t"), F.col("ord")).collect()}
    assert got == {1: (1, None), 2: (1, 1.0), 3: (0, None), 4: (2, 88.0), 5: (0, None)}


def test_fresh_and_entries(spark):
    src = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "path string, mtime double")
    work = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("b", 3.0)], "path string, mtime double")
    assert {r.path: r.reusable for r in caches.fresh(src, work).collect()} == {"a": True, "b": False, "c": False}
    both = caches.cached_then_fresh(spark.createDataFrame([(3,), (1,)], "ord long"), spark.createDataFrame([(2,)], "ord long"))
    assert [r.ord for r in both.collect()] == [1, 2, 3]
    scored = spark.createDataFrame([("a", 1), ("b", None)], "path string, vision int")
    items = spark.createDataFrame([("a", "s1"), ("b", "s2")], "path string, source_sha256 string")
    assert [tuple(r) for r in caches.vision_entries(scored, items, "m", F.sha2(F.lit("p"), 256)).drop("prompt_sha256").collect()] == [("a.vision.json", "s1", "m", 1)]


def test_bench_modes(spark):
    rows = [("x", 1, 4.0, 0.5, "fine"), ("x", 1, 4.0, 0.7, "Vision scoring failed: no"), ("y", 1, 1.0, 0.2, "ok"), ("y", 2, 3.0, 0.4, "technical-only")]
    df = spark.createDataFrame(rows, "mode string, run int, duration double, final_score double, line string")
    got = reports.bench_modes(df).collect()
    assert [(r.mode, r.runs, r.seconds_an_image, r.mean_failed) for r in got] == [("x", 1, 2.0, 1.0), ("y", 2, 2.0, 0.5)]
    assert got[0].mean_score == pytest.approx(0.6) and got[1].median_score == pytest.approx(0.3)
    lines = [r.line for r in reports.bench_markdown(reports.bench_modes(df), "mode").orderBy("line_no").collect()]
    assert lines[2].startswith("| x | 1 | 2.00 | 30.00 | 4.00") and len(lines) == 4


def test_client_limits():
    """So many in flight, none after failures in a row, waits that double, one less after a rate limit."""
    import threading

    from lumenrank.sources import scorers

    flying, most, lock, waits = 0, 0, threading.Lock(), []

    def call(item):
        nonlocal flying, most
        with lock:
            flying += 1
            most = max(most, flying)
        threading.Event().wait(0.01)
        with lock:
            flying -= 1
        if item["i"] >= 20:
            raise RuntimeError("503 temporarily unavailable" if item["i"] == 20 else "no")
        return str(item["i"])

    c = scorers.Client(call, concurrency=3, retries=2, base=1.0, breaker=6, sleep=waits.append)
    got = c.run([{"i": i} for i in range(60)])
    assert [g[0] for g in got[:20]] == [str(i) for i in range(20)] and most == c.most_in_flight == 3
    assert got[20][1].startswith("503") and waits == [1.0, 2.0] and all(g == (None, scorers.BREAKER_OPEN) for g in got[30:])
    assert sum(g[1] == "no" for g in got) in (5, 6, 7)
    limit = scorers.AdaptiveLimit()
    assert [limit.done(True), limit.done(True), limit.done(True)] == [2, 1, 1] and [limit.done(False), limit.done(False)] == [1, 2]
    adaptive = scorers.Client(lambda item: "x", adaptive=True)
    assert len(adaptive.run([{"i": i} for i in range(40)])) == 40 and adaptive.limit.now == 8


def test_request_bodies(spark):
    import json

    from lumenrank.sources import scorers

    df = spark.createDataFrame([('qwen3-vl:8b "x"', "QUJD"), ("other", "QUJD")], "model string, payload string")
    m, p, told = F.col("model"), F.col("payload"), F.lit('say "hi"')
    rows = df.select(scorers.claude_request(m, p, told, F.lit("a dog")).alias("c"), scorers.ollama_request(m, p, told, F.lit(1024)).alias("o"), scorers.ollama_request(m, p, told, F.lit(1024), compact=True).alias("o2")).collect()
    c = json.loads(rows[0].c)
    assert c["model"] == 'qwen3-vl:8b "x"' and c["max_tokens"] == 300 and c["messages"][0]["content"][1]["text"] == 'say "hi" Detected: a dog' and c["messages"][0]["content"][0]["source"]["data"] == "QUJD"
    strict, free, again = json.loads(rows[0].o), json.loads(rows[1].o), json.loads(rows[1].o2)
    assert strict["format"] == again["format"] == scorers.SCHEMA and free["format"] == "json"
    assert strict["options"] == {"temperature": 0, "num_predict": 750} and free["options"]["num_predict"] == 220 and free["stream"] is False
    assert free["messages"][0]["images"] == ["QUJD"] and 'say "hi"' in free["messages"][0]["content"] and len(again["messages"][0]["content"]) < len(free["messages"][0]["content"])


def test_named_settings(tmp_path):
    from lumenrank.sources import config

    env = {}
    assert config.api_key([{}, {"ANTHROPIC_API_KEY": " k "}], env) == "k" and env == {"ANTHROPIC_API_KEY": "k"}
    with pytest.raises(KeyError):
        config.api_key([{"ANTHROPIC_API_KEY": " "}])
    assert config.hub_token([{}, {"HUGGINGFACE_HUB_TOKEN": "t"}], env) == "t" and env["HF_TOKEN"] == "t" and config.hub_token([{}]) is None
    assert [config.claude_model(a, e) for a, e in (("m", {}), (None, {"CLAUDE_MODEL": "c", "ANTHROPIC_MODEL": " "}), (" ", {}))] == ["m", "c", config.CLAUDE_DEFAULT]
    (tmp_path / "w.pt").write_bytes(b"x")
    assert config.model_weights("w.pt", {}, str(tmp_path)) == str(tmp_path / "w.pt")
    with pytest.raises(FileNotFoundError):
        config.model_weights("v.pt", {"DETECTOR_WEIGHTS": "/nowhere"}, str(tmp_path))


def test_unicode_white_space(spark):
    """No-break and em spaces are white space, as the texts' own language has it."""
    from lumenrank.functions import text

    df = spark.createDataFrame([("\u00a0 a\u2003b\u00a0\u00a0c.\u2003Next\u00a0",)], "t string")
    got = df.select(text.one_line(F.col("t"), F.lit("")).alias("a"), text.first_sentence(F.col("t")).alias("b"), text.strip(F.col("t")).alias("c")).first()
    assert got.a == "a b c. Next" and got.b == "a\u2003b\u00a0\u00a0c." and got.c.startswith("a") and got.c.endswith("Next")


def test_breaker(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate("oeeoeee")], "u int, id long, t string")
    got = [(r.failures_in_row, r.open) for r in reports.breaker(df, "u", [F.col("id")], F.col("t") == "e", 3).orderBy("id").collect()]
    assert got == [(0, False), (1, False), (2, False), (0, False), (1, False), (2, False), (3, True)]


def test_files(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.jpg").write_bytes(b"d")
    got = files.pictures(spark, str(tmp_path), with_content=True).collect()
    assert {r.path.rsplit("/", 1)[1] for r in got} == {"b.JPG", "a.png"} and all(len(r.sha256) == 64 for r in got)
    assert files.payloads(spark, str(tmp_path)).count() == 2
    (tmp_path / "g1").mkdir()
    (tmp_path / "g1" / files.REPORT_FILE).write_text('[{"rank": 1, "output": "x.jpg"}, {"rank": 2, "output": ""}]')
    (tmp_path / "g1" / "r.md").write_text("# R\n- Input: `/photos`\n")
    assert {(r["rank"], r.output_cropped) for r in files.reports(spark, str(tmp_path)).collect()} == {(1, "x.jpg"), (2, None)}
    assert files.report_input(spark, str(tmp_path)).first().input == "/photos"


def test_exif(spark):
    one = spark.createDataFrame([("2024:02:03 04:05:06", "25"), ("bad", None)], "s string, f string")
    got = [r.v for r in one.select(files.exif_time(F.col("s"), F.col("f")).alias("v")).collect()]
    assert got == [1706933106.25, None]
    tags = F.struct(F.lit("ACME").alias("make"), F.lit("Acme X1").alias("model"), F.lit("").alias("lens"), F.lit(35.0).alias("focal"), F.lit(2.8).alias("f_number"), F.lit(0.004).alias("exposure"), F.lit(100).alias("iso"), F.lit(None).cast("string").alias("taken"))
    assert spark.range(1).select(files.exif_summary(tags).alias("v")).first().v == "Acme X1, 35mm, f/2.8, 1/250s, ISO 100"


def test_command_line(spark, tmp_path, capsys):
    assert main(["backoff_schedule", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 9
    with pytest.raises(SystemExit) as e:
        main(["nothing", "x"])
    assert e.value.code == 2 and "--rows" in capsys.readouterr().err
    assert main(["select", str(tmp_path / "none")]) == 1


def test_burst_windows_on_a_table_and_a_stream(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:{s:02d}") for s in (0, 3, 20)]
    df = spark.createDataFrame(rows, "key string, t string").select("key", F.to_timestamp("t").alias("ts"))
    assert sorted(r.shots for r in stream.burst_windows(df, "key").collect()) == [1, 2]
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.burst_windows(source, "key", delay="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.shots for r in spark.table("bursts").collect()] == [2]


def hashed(n, words, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64 * words) for _ in range(n // 5)]
    full = [rng.choice(base) ^ sum({1 << rng.randrange(64 * words) for _ in range(rng.randrange(18 * words))}) for _ in range(n)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return full, [(i, [signed(h >> (64 * w) & (2**64 - 1)) for w in range(words)]) for i, h in enumerate(full)] + [(n, None)]


@pytest.mark.parametrize("words", [1, 2])
def test_pairs_of_narrow_bands_meet_in_tiles(spark, monkeypatch, words):
    """Bands of 3 bits would join most pairs: nothing is joined by hash, no pair is lost, whatever the parts."""
    monkeypatch.setattr(dedup, "PART", 70)
    monkeypatch.setattr(dedup, "ROWS", 16)
    full, rows = hashed(300, words, 4)
    df = dedup.hamming_pairs(spark.createDataFrame(rows, "id long, words array<long>"), "id", "words", words, 20 * words)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan and "HashAggregate" not in plan
    got = {(r.a, r.b): r.distance for r in df.collect()}
    want = {(i, j): (full[i] ^ full[j]).bit_count() for j in range(300) for i in range(j) if (full[i] ^ full[j]).bit_count() <= 20 * words}
    assert got == want and want


@pytest.mark.parametrize("leading", [1000, 300, 25])
def test_leaders_of_hashes_are_those_of_all_pairs(spark, monkeypatch, leading):
    """One round, one that is just full, and several: no pair is listed, the leaders are those of a walk over all pairs."""
    monkeypatch.setattr(dedup, "LEADING", leading)
    monkeypatch.setattr(dedup, "PART", 7)
    monkeypatch.setattr(dedup, "ROWS", 16)
    full, rows = hashed(300, 1, 6)
    got = {r.ord: r.leader for r in dedup.hash_leaders(spark.createDataFrame(rows, "id long, words array<long>"), "id", "words", 1, 20).collect()}
    near = [(i, j) for j in range(300) for i in range(j) if (full[i] ^ full[j]).bit_count() <= 20]
    assert got == walk(300, near) | {300: 300}
    assert len(set(got.values())) > 50


def test_leaders_of_no_hashes(spark):
    assert dedup.hash_leaders(spark.createDataFrame([], "id long, words array<long>"), "id", "words", 1, 20).count() == 0


def test_windows_as_good_as_one_another_keep_the_order(spark):
    """Two windows mirror each other about the power points: the first of them wins, as in the SQL."""
    r = crop_of(spark, 640, 1440, (344, 413, 296, 408), "motorcycle", "right")
    assert [c.score for c in r.candidates if c.name in ("ideal", "center")] == [0.7370268092265742] * 2
    assert (r.chosen, r.crop_y) == ("ideal", 88)
