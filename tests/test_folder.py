"""The whole selection on generated PNG files, against plain loops."""

import json
import struct
import zlib

import numpy as np
import pytest

from lumenrank.functions import pixels as px
from lumenrank.operators import pictures
from lumenrank.plans import folder
from lumenrank.sources import files, galleries


def tagged(png: bytes, when: str) -> bytes:
    """A PNG file with a time in its eXIf chunk."""
    s = when.encode() + b"\0"
    tiff = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHII", 0x010F, 2, 4, int.from_bytes(b"Cam\0", "big")) + struct.pack(">HHII", 0x9003, 2, len(s), 38) + struct.pack(">I", 0)
    tiff += b"\0" * (38 - len(tiff)) + s
    chunk = struct.pack(">I", len(tiff)) + b"eXIf" + tiff + struct.pack(">I", zlib.crc32(b"eXIf" + tiff))
    return png[:33] + chunk + png[33:]


def scene(seed: int, h: int = 240, w: int = 320) -> np.ndarray:
    """Blobs of colours, sharp edges, so that scenes differ in hash, colours and corners."""
    r = np.random.default_rng(seed)
    a = np.full((h, w, 3), r.integers(0, 255, 3), float)
    for _ in range(40):
        y, x, bh, bw = (int(v) for v in (r.integers(h), r.integers(w), r.integers(8, h // 3), r.integers(8, w // 3)))
        a[y : y + bh, x : x + bw] = r.integers(0, 255, 3)
    return a.astype(np.uint8)


def blurred(a: np.ndarray) -> np.ndarray:
    return px.resampled(px.resampled(a, a.shape[0] // 2, a.shape[1] // 2), *a.shape[:2])


@pytest.fixture(scope="module")
def shots(tmp_path_factory):
    """name -> (picture, seconds after the first or none)."""
    burst = scene(2)
    out = {
        "a.png": (scene(1), 0), "a_copy.png": (blurred(scene(1)), 500),
        "b1.png": (burst, 100), "b2.png": (blurred(np.roll(burst, 30, 1)), 101), "b3.png": (np.roll(burst, 60, 1), 103),
        "b4.png": (np.roll(burst, 90, 1), 110),
        "c.png": (scene(3), None), "c2.png": (np.roll(scene(3), 25, 0), None), "d.png": (scene(4, 400, 240), 200), "e.png": (scene(5), 201), "f.png": (scene(6, 300, 700), None),
    }
    path = tmp_path_factory.mktemp("shots")
    for name, (a, t) in out.items():
        data = px.png(a)
        (path / name).write_bytes(data if t is None else tagged(data, f"2024:05:01 10:{t // 60:02d}:{t % 60:02d}"))
    (path / "broken.png").write_bytes(b"no picture")
    (path / "notes.txt").write_text("x")
    return path, out


def plain_groups(shots):
    """Representatives in the order of bursts, and bursts, by loops over pictures in the order of names."""
    names = sorted(shots)
    hashes = {n: np.array(px.perceptual_hash(shots[n][0]), np.int64).view(np.uint64) for n in names}
    leads: dict[str, list[str]] = {}
    for n in names:
        near = next((q for q in leads if int(np.bitwise_count(hashes[q] ^ hashes[n]).sum()) <= 8), None)
        leads.setdefault(near or n, []).append(n)
    kept = [max(g, key=lambda n: (px.quick_sharpness(shots[n][0]), -names.index(n))) for g in leads.values()]
    feats = {n: (px.histogram(shots[n][0]), px.descriptors(shots[n][0])) for n in kept}
    order = sorted(kept, key=lambda n: (shots[n][1] is None, shots[n][1] or 0))
    bursts: list[list[str]] = []
    for n in order:
        for g in bursts:
            t, u = shots[g[-1]][1], shots[n][1]
            if (t is None) != (u is None) or (t is not None and u - t > 3):
                continue
            r, m = px.correlation(feats[g[-1]][0], feats[n][0]), px.match_share(feats[g[-1]][1], feats[n][1])
            if m >= 0.25 and r >= (0.92 if t is None else 0.60):
                g.append(n)
                break
        else:
            bursts.append([n])
    return [max(g, key=lambda n: (px.quick_sharpness(shots[n][0]), -order.index(n))) for g in bursts], bursts


def test_groups(spark, shots, tmp_path):
    path, of = shots
    pics = folder.prepared(spark, str(path), str(tmp_path / "work")).cache()
    assert [r.path.rsplit("/", 1)[-1] for r in pics.orderBy("ord").collect()] == sorted(of)
    unique, bursts = folder.deduplicated(pics)
    want, groups = plain_groups(of)
    assert any(len(g) > 2 for g in groups) and len(want) < len(of) - 2
    assert [r.path.rsplit("/", 1)[-1] for r in unique.orderBy("place").collect()] == want
    got: dict[int, set] = {}
    for r in bursts.collect():
        got.setdefault(r.chain, set()).add(r.path.rsplit("/", 1)[-1])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_resized_once(spark, shots, tmp_path):
    path, of = shots
    work = str(tmp_path / "work")
    first = {r.path: r for r in folder.prepared(spark, str(path), work, 200).collect()}
    assert all(max(r.width, r.height) <= 200 for r in first.values()) and len(first) == len(of)
    assert folder.prepared(spark, str(path), work, 200).count() == len(of)
    assert spark.read.parquet(f"{work}/pictures").count() == len(of)  # nothing was made again


def reply(total, crop):
    return json.dumps({"message": {"content": json.dumps({"subject_clarity": 8, "lighting": 8, "color_pop": 8, "emotion": 8, "scroll_stop": 8, "crop_4x5": crop, "total": total, "one_line": "a | b"}), "thinking": ""}})


def test_whole_run(spark, shots, tmp_path):
    """Crop-safe pictures come before higher totals; a prose reply is asked for once more; reports read back as they were written."""
    path, of = shots
    good, close = reply(50, 9), reply(58, 3)
    prose = json.dumps({"message": {"content": "What a lovely picture. 7/10", "thinking": ""}})

    def make():
        def call(item):
            name = item["path"].rsplit("/", 1)[-1]
            strict = '"additionalProperties"' in item["request"]
            if name == "d.png":
                raise RuntimeError("bad request")
            if name == "e.png" and not strict:
                return prose
            return close if name == "f.png" else good

        return call

    out = tmp_path / "out"
    o = folder.Options(top=3, all_scored=True, make_call=make, model="other:1b", out_w=90, out_h=120, call_options={"base": 0.0})
    got = folder.select(spark, str(path), str(out), str(tmp_path / "work"), o)
    scored = {r.path.rsplit("/", 1)[-1]: r for r in got["scored"].collect()}
    assert scored["e.png"].mode == "json-content" and scored["e.png"].vision.total == 50
    assert scored["d.png"].vision is None and scored["d.png"].error == "bad request" and scored["d.png"].final_score == pytest.approx(0.3 * scored["d.png"].composite)
    assert scored["f.png"].final_score == pytest.approx((0.3 * scored["f.png"].composite + 0.7 * 58 / 60) * 0.15)
    top = got["top"].orderBy("rank").collect()
    safe = sorted((r for r in scored.values() if r.vision and r.vision.crop_4x5 >= 6), key=lambda r: (-r.final_score, r.ord))
    assert [r.path for r in top] == [r.path for r in safe[:3]]
    back = files.reports(spark, str(out)).orderBy("rank").collect()
    assert [r.rank for r in back] == [1, 2, 3] and all(r.one_line == "a \\| b" for r in back)
    assert [r.final_score for r in back] == [round(r.final_score, 4) for r in top]
    for r in back:
        assert (out / r.output_cropped).read_bytes()[:4] == b"\x89PNG" and (out / r.output_hd).exists()
        side = json.loads((out / r.output_cropped.replace(".png", ".json")).read_text())
        x, y, w, h = side["crop_window_xywh"]
        assert abs(w / h - 0.75) < 0.02 and side["selected_candidate"] and isinstance(side["uncertain_crop_reasons"], list)
    made = spark.read.format("image").load(str(out / back[0].output_cropped)).select("image.width", "image.height").first()
    assert (made.width, made.height) == (90, 120)
    text = (out / "selection_report.md").read_text()
    assert text.count("\n| ") == 3 + len(scored) + 4 and f"- Input: `{path}`" in text and "scored by ollama" in text
    assert files.report_input(spark, str(out)).first().input == str(path)
    page = (out / "gallery.html").read_text()
    assert page.count('class="tile"') == 3 and back[0].output_cropped in page
    galleries.rebuild(spark, str(tmp_path))
    assert (tmp_path / "index.html").read_text().count("1 galleries, 3 pictures") == 1


def test_without_a_model_and_dedup_only(spark, shots, tmp_path):
    path, of = shots
    got = folder.select(spark, str(path), str(tmp_path / "out"), str(tmp_path / "work"), folder.Options(top=2))
    ranked = sorted(got["scored"].collect(), key=lambda r: (-r.composite, r.ord))
    assert [r.path for r in got["top"].orderBy("rank").collect()] == [r.path for r in ranked[:2]]
    assert all(r.final_score == r.composite for r in ranked)
    for r in got["ranked"].collect():
        if len(r.members) > 1:
            best = max(r.members, key=lambda p: px.metrics(of[p.rsplit("/", 1)[-1]][0])["composite"])
            assert r.path == best or r.selected_by == "sharpness"
    table = folder.dedup_only(spark, str(path), str(tmp_path / "dedup"), str(tmp_path / "work")).orderBy("place").collect()
    want, groups = plain_groups(of)
    assert [sorted(p.rsplit("/", 1)[-1] for p in r.members) for r in table] == [sorted(next(g for g in groups if w in g)) for w in want]
    assert len(list((tmp_path / "dedup").glob("*_unique_*.png"))) == len(want)


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("x")
    got = folder.select(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "work"))
    assert got["report"].count() == 0


def test_metrics_agree_with_the_column_functions(spark):
    """Small pictures by both ways: what does not need the edge and line detectors is the same."""
    from lumenrank.functions import rasters as ras

    r = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(6):
        a = r.integers(0, 256, (8, 8, 3)).astype(np.uint8)
        b, g, red = (a[:, :, k].astype(float).ravel().tolist() for k in range(3))
        rows.append((i, px.gray(a).ravel().tolist(), red, g, b))
        want[i] = px.metrics(a)
    df = spark.createDataFrame(rows, "i int, gray array<double>, r array<double>, g array<double>, b array<double>")
    c = df.withColumns({"lap": ras.laplacian(df.gray, 8, 8), "sat": ras.saturation(df.r, df.g, df.b)})
    none = ras.F.lit(None).cast("array<double>")
    got = c.select("i", ras.sharpness(ras.energy(c.lap, none), 8.0).alias("sharpness"), ras.lighting(c.gray).alias("lighting"), (0.6 * ras.colourfulness(c.r, c.g, c.b) + 0.2).alias("color_harmony"), ras.aesthetic(c.gray, c.sat).alias("aesthetic"))
    for row in got.collect():
        for k in ("sharpness", "lighting", "color_harmony", "aesthetic"):
            assert row[k] == pytest.approx(want[row.i][k], abs=1e-9), k


def test_pixels():
    a = scene(9)
    assert px.picture(px.oriented(a, 6).tobytes(), 320, 240, 3).shape == (320, 240, 3)
    for o in range(1, 9):
        back = {6: 8, 8: 6}.get(o, o)
        assert (px.oriented(px.oriented(a, o), back) == a).all()
    level = np.zeros((300, 400), bool)
    level[150, 50:350] = True
    assert px.level_lines(level) == [0.0] and px.tilt_score([0.0]) == 1.0 and px.tilt_score([]) == 0.8 and px.tilt_score([7.0]) == 0.5
    tilted = np.zeros((300, 400), bool)
    x = np.arange(400)
    tilted[(100 + x * np.tan(np.deg2rad(6))).astype(int), x] = True
    assert abs(float(np.median(px.level_lines(tilted))) - 6) <= 1
    box = np.zeros((60, 80, 3), np.uint8)
    box[20:40, 30:50] = 255
    e = px.edges(px.gray(box))
    assert e.any() and not e[:15].any() and not e[25:35, 35:45].any()
    assert px.exif(tagged(px.png(a), "2024:05:01 10:00:00")) == {"make": "Cam", "original": "2024:05:01 10:00:00"}
    assert px.exif(b"") == px.exif(b"\xff\xd8\xff\xe1\0") == px.exif(px.png(a)) == {}
    assert px.padded(a, 90, 120).shape == (120, 90, 3) and px.shrunk_size(4000, 1000, 1920) == (1920, 480)


def test_crops_that_fail(spark):
    a = scene(1, 60, 80)
    rows = [("ok", 60, 80, 3, a.tobytes(), 0, 0, 30, 40), ("far", 60, 80, 3, a.tobytes(), 70, 0, 30, 40), ("short", 60, 80, 3, b"xx", 0, 0, 30, 40)]
    df = spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary, crop_x int, crop_y int, crop_w int, crop_h int")
    got = {r.path: r for r in pictures.cropped(df, 9, 12).collect()}
    assert got["ok"].fallback is None and got["ok"].image and got["far"].fallback == "crop_failed" and got["far"].image
    assert got["short"].image is None and got["short"].error
    assert {r.path: r.composite is None for r in pictures.technical(df).collect()} == {"ok": False, "far": False, "short": True}
    assert pictures.payload(df).where("payload is not null").count() == 2 and pictures.padded(df, 30, 40).where("image is not null").count() == 2
