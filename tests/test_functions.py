"""Golden vectors of column functions."""

import math

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import geometry as geo
from lumenrank.functions import numeric, rasters, scoring, text
from lumenrank.functions import replies as rep
from lumenrank.sources import config, scorers


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lit_box(*v):
    return geo.Box(*(F.lit(x) for x in v))


def test_rounding_and_casts(spark):
    assert [value(spark, numeric.half_even_int(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]
    assert value(spark, numeric.safe_number(F.lit("x"), 5)) == 5.0
    assert value(spark, numeric.clamp(F.lit(None).cast("int"), 0, 1)) is None
    assert value(spark, numeric.array_median(F.array(F.lit(4.0), F.lit(1.0)))) == 2.5
    assert value(spark, numeric.array_mean(F.array().cast("array<double>"))) is None


def test_expanded(spark):
    b = geo.expanded(lit_box(5, 6, 100, 80), F.lit(""), F.lit(140), F.lit(90))
    assert tuple(value(spark, b.struct())) == (0, 0, 117, 90)


def test_iou_distance_union(spark):
    p, m = lit_box(300, 200, 180, 400), lit_box(330, 350, 280, 300)
    assert value(spark, geo.iou(p, m)) == pytest.approx(0.3165, abs=1e-4)
    assert value(spark, geo.centre_distance(p, m, F.lit(1200), F.lit(800))) == pytest.approx(0.0888, abs=1e-4)
    assert tuple(value(spark, geo.union(p, m).struct())) == (300, 200, 310, 450)
    assert value(spark, geo.iou(lit_box(0, 0, 5, 5), lit_box(5, 5, 5, 5))) == 0


def test_placement(spark):
    assert value(spark, geo.placement(F.lit(0.5), F.lit(0.5))) == pytest.approx(0.380243, abs=1e-6)
    assert value(spark, geo.placement(F.lit(0.333), F.lit(0.283))) == pytest.approx(0.916855, abs=1e-6)


def test_blend_and_gate(spark):
    f = lambda t, total, crop, scorer="claude", failed=False, there=True: value(spark, scoring.final_score(F.lit(t), F.lit(total).cast("long"), F.lit(crop).cast("long"), F.lit(scorer), F.lit(failed), F.lit(there)))
    assert f(0.4, 54, 9) == pytest.approx(0.75)
    assert f(0.7, 36, 9) == pytest.approx(0.63)
    assert f(0.5, 48, 4) == pytest.approx(0.71 * 0.15)
    assert f(0.5, 48, 4, "clip") == pytest.approx(0.71)
    assert f(0.62, None, None, there=False) == pytest.approx(0.62)
    assert f(0.5, None, None, failed=True) == pytest.approx(0.15)
    assert f(0.5, None, None) == pytest.approx((0.15 + 0.35) * 0.15)
    assert f(0.5, 77, 9) == pytest.approx(0.15 + 0.7 * 77 / 60)  # totals over 60 are not cut here
    assert sum(scoring.WEIGHTS.values()) == pytest.approx(1)


def test_raster_metrics(spark):
    flat = F.array(*(F.lit(100.0) for _ in range(64)))
    check = F.array(*(F.lit(255.0 * ((i // 8 + i) % 2)) for i in range(64)))
    none = F.lit(None).cast("array<double>")
    assert value(spark, rasters.energy(rasters.laplacian(flat, 8, 8), none)) == 0
    assert value(spark, rasters.lighting(flat)) == 1.0
    assert value(spark, rasters.lighting(check)) == 0.0
    assert value(spark, rasters.clutter(rasters.gradient(flat, 8, 8), none, 100)) == 1.0
    assert value(spark, rasters.aesthetic(flat, F.array(F.lit(127.5)))) == pytest.approx(0.5)
    assert value(spark, rasters.background_separation(rasters.laplacian(flat, 8, 8), none)) == 0.5
    lap = value(spark, rasters.laplacian(check, 8, 8))
    assert lap[0] == 4 * 255 and all(abs(v) == 4 * 255 for v in lap)
    inside = value(spark, rasters.mask(F.lit(1), F.lit(2), F.lit(2), F.lit(3), 8, 8))
    assert sum(inside) == 6 and inside[2 * 8 + 1] == 1 and inside[8 + 1] == 0


def test_text(spark):
    assert value(spark, text.markdown_cell(F.lit("bike|shot.jpg\nx "))) == "bike\\|shot.jpg x"
    assert value(spark, text.markdown_cell(F.lit(None).cast("string"))) == ""
    assert value(spark, text.one_line(F.lit('"unclosed'), F.lit(""))) == "unclosed"
    assert value(spark, text.one_line(F.lit(None).cast("string"), F.lit("A. B"))) == "A."
    assert value(spark, text.one_line(F.lit(""), F.lit(""))) == text.DEFAULT_LINE
    assert value(spark, text.ranked_name(F.lit(103), "hd", F.lit("a"), ".jpg")) == "103_hd_a.jpg"
    assert value(spark, text.quoted(F.lit("a b/ü*~"))) == "a%20b/%C3%BC%2A~"
    assert value(spark, text.stem(F.lit("/x/a.b.JPG"))) == "a.b" and value(spark, text.suffix(F.lit("/x/a.b.JPG"))) == ".jpg"


def test_replies(spark):
    rows = [(1, "8/10 subject clarity: 8/10 lighting: 7/10 color pop: 8/10 emotion: 7/10 scroll stop: 8/10 crop 4x5: 9/10 TOTAL: 47", None), (2, "no numbers", None), (3, None, None), (4, "[1]", '{"subject_clarity": 1, "lighting": 2, "emotion": 3}')]
    df = rep.with_parsed(spark.createDataFrame(rows, "id int, c string, t string"), "c", "t")
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["payload"]["total"] == 47 and got[1]["mode"] == "plain-content"
    assert got[2]["payload"]["total"] == 30 and got[2]["payload"]["emotion"] == 5 and got[2]["mode"] == "neutral-content"
    assert got[3]["payload"] is None and got[3]["mode"] is None
    assert got[4]["mode"] == "json-thinking" and got[4]["payload"]["crop_4x5"] == 2 and got[4]["payload"]["total"] == 12


def test_env(spark):
    lines = "# c\n\nexport A = 'x y'\nB=1=2\nbad\nA=\"z\"\n=v\n"
    assert config.parse_env(lines) == {"A": "z", "B": "1=2"}
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines.splitlines())], "file string, line_no int, line string")
    assert {r["key"]: r["value"] for r in config.env_rows(df).collect()} == {"A": "z", "B": "1=2"}
    assert config.resolve("K", [{"K": " "}, {"K": "2"}, {"K": "3"}]) == "2"
    assert config.resolve("K", [{}], "d") == "d"
    with pytest.raises(KeyError):
        config.resolve("K", [{}], required=True)


def test_scorers(spark):
    waits, calls = [], []

    def flaky(item):
        calls.append(item)
        if len(calls) < 3:
            raise RuntimeError("503 temporarily unavailable")
        return "ok"

    assert scorers.with_retries(flaky, {}, 2, 0.5, waits.append) == ("ok", None) and waits == [0.5, 1.0]
    assert scorers.with_retries(lambda i: 1 / 0, {}, 5, 0.5, waits.append)[0] is None and len(waits) == 2
    df = spark.createDataFrame([("a",), ("b",)], "item_id string")
    got = {r.item_id: (r.reply, r.error) for r in scorers.replies(df, scorers.replay({"a": "{}"})).collect()}
    assert got == {"a": ("{}", None), "b": (None, "no stored reply")}

    def ping(name):
        if name != "c":
            raise RuntimeError("not_found_error: model")

    assert scorers.first_working(["a", "b", "c"], ping) == "c"
    limit = scorers.AdaptiveLimit()
    assert limit.done(True) == 2 and [limit.done(False) for _ in range(4)][-1] == 3


def test_margins_and_tilt(spark):
    assert value(spark, geo.tilt_score(F.lit(2.0))) == 1.0
    assert value(spark, geo.tilt_score(F.lit(None).cast("double"))) == 0.8
    assert value(spark, geo.tilt_angle(F.lit(-10.0), F.lit(0.5))) == pytest.approx(math.degrees(math.atan2(0.5, 10)), abs=1e-9)
    assert value(spark, geo.tilt_angle(F.lit(1.0), F.lit(1.0))) is None
