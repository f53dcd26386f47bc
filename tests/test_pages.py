import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell import queries
from inkwell.functions import exprs, tables
from inkwell.operators import alignment, geometry, images, layout, terms
from inkwell.plans import providers, translate
from inkwell.sources import archives
from inkwell.sources.images import numbered, read_images
from inkwell.sources.options import JobOptions
from inkwell.streaming.terms import running_counts


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("v")).first()["v"]


def png(picture):
    """A PNG file of an RGB picture."""
    height, width, _ = picture.shape
    raw = b"".join(b"\0" + picture[y].tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("text,want", [("  a　", "a"), (" \tb c\n", "b c"), ("", ""), ("\x1c", "")])
def test_strip_is_unicode_aware(spark, text, want):
    assert one(spark, exprs.strip(F.col("t")), t=text) == want == text.strip()


@pytest.mark.parametrize("text", ["a  b\tc", "　田中 さん\x85x", " ", "é²¼ b"])
def test_tokens_equal_python_split(spark, text):
    assert one(spark, exprs.tokens(F.col("t")), t=text) == text.split()


@pytest.mark.parametrize("name,want", [("a.jpg", "a"), ("a.tar.gz", "a.tar"), (".hidden", ".hidden"), ("plain", "plain"), ("..x", "..x")])
def test_stem(spark, name, want):
    import os

    assert one(spark, exprs.stem(F.col("t")), t=name) == want == os.path.splitext(name)[0]


@pytest.mark.parametrize("raw,want", [('```json\n["a"]\n```', '["a"]'), ("```[1]```  ", "[1]"), ("[2]\n", "[2]"), ("```json```", "")])
def test_unfenced(spark, raw, want):
    assert one(spark, exprs.unfenced(F.col("t")), t=raw) == want


@pytest.mark.parametrize("answer,want", [("Yuki-Burobu", "Yuki-Burobu"), ("'yuki-burobu'", "Yuki-Burobu"), ("Font: Best match: ARIAL narrow", "arial"), ("none of them", "animeace_"), ("Font: mangat", "mangat")])
def test_picked_font(spark, answer, want):
    assert one(spark, exprs.picked_font(F.col("t")), t=answer) == want


def meant(answer):
    text = answer.strip().translate({34: None, 39: None}).strip()
    for prefix in tables.ANSWER_PREFIXES:
        if text.lower().startswith(prefix.lower()):
            text = text[len(prefix) :].strip()
    low = text.lower()
    return text if text in tables.FONTS else next((f for f in tables.FONTS if low in f.lower() or f.lower() in low), tables.DEFAULT_FONT)


def test_picked_fonts_keep_the_text_once(spark):
    heads = ("", "Font: ", "FONT:", "best match: 'i recommend ", "The best matching font is Best match: Font: I recommend ", "I recommend Font: ", "\u3000\x1c\"Font:  ")
    answers = [h + t + e for h in heads for t in (*tables.FONTS, *[f.upper() for f in tables.FONTS], "", " ", "é", "wingdings 7", "x" * 5000) for e in ("", ' "\n', " regular")]
    df = spark.createDataFrame([*[(a,) for a in answers], (None,)], "t string").select("t", exprs.picked_font(F.col("t")).alias("font"))
    assert {r["t"]: r["font"] for r in df.collect()} == {a: meant(a) for a in answers} | {None: tables.DEFAULT_FONT}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3


def test_wrap_equals_textwrap(spark):
    import random
    import textwrap

    rng = random.Random(2)
    rows = [(" ".join("x" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 25))), rng.randrange(1, 30)) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, n int")
    for r in df.select("t", "n", layout.wrapped(F.col("t"), F.col("n")).alias("a"), layout.wrapped_raw("t", "n").alias("b")).collect():
        want = textwrap.fill(r["t"], r["n"], break_long_words=False, break_on_hyphens=False)
        assert r["a"] == want == r["b"]


def greedy(boxes, limit=0.5):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        def iou(k):
            i = max(0, min(b[3], k[3]) - max(b[1], k[1])) * max(0, min(b[4], k[4]) - max(b[2], k[2]))
            u = (b[3] - b[1]) * (b[4] - b[2]) + (k[3] - k[1]) * (k[4] - k[2]) - i
            return i / u if u > 0 else 0
        if all(iou(k) < limit for k in kept):
            kept.append(b)
    return kept


def test_suppression_and_overlaps_match_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = []
    for page in range(40):
        for o in range(int(rng.integers(1, 12))):
            x, y, w, h = (int(v) for v in (*rng.integers(0, 60, 2), *rng.integers(0, 40, 2)))
            rows.append((page, o, x, y, x + w, y + h, float(rng.integers(0, 4)) / 4))
    boxes = spark.createDataFrame(rows, "page long, ord int, x1 int, y1 int, x2 int, y2 int, conf double")
    got = {}
    for r in geometry.suppressed(boxes).orderBy("page", "rank").collect():
        got.setdefault(r["page"], []).append(r["ord"])
    for page in range(40):
        assert got[page] == [b[0] for b in greedy([r[1:] for r in rows if r[0] == page])]
    pairs = {(r["page"], r["a"], r["b"]) for r in geometry.overlapping(boxes, 0.3).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and len(greedy([a[1:], b[1:]], 0.3)) == 1}
    assert pairs == want


def test_gutters_need_ten_rows_and_strict_limits(spark):
    mean = [245.0] * 20 + [246.0] * 9 + [100.0] + [14.0] * 10 + [15.0] * 3 + [250.0] * 11
    rows = spark.createDataFrame([(1, y, m) for y, m in enumerate(mean)], "page int, y int, mean double")
    assert sorted((r["start"], r["end"], r["center"]) for r in geometry.gutters(rows).collect()) == [(30, 40, 35), (43, 54, 48)]


def test_terms_count_each_pattern(spark):
    rows = [(1, 0, "山田先生 Hanako は"), (1, 1, "Tanaka-san éTanaka"), (2, 0, None), (2, 1, "")]
    got = {r["term"]: r["n"] for r in terms.counts(terms.hits(spark.createDataFrame(rows, "page long, bubble long, text string"))).collect()}
    assert got == {"山田": 2, "山田先生": 1, "Hanako": 2, "Tanaka": 1, "Tanaka-san": 1, "éTanaka": 1}


def test_batches_follow_pages(spark):
    pages = spark.createDataFrame([(i * 3,) for i in range(57)], "page long")
    got = {r["page"]: (r["number"], r["batch"]) for r in terms.batches(pages).collect()}
    assert got == {i * 3: (i, i // 10) for i in range(57)}


def test_alignment_statuses(spark):
    bubbles = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "page long, bubble long, text string")
    answers = spark.createDataFrame([(1, ["A"])], "page long, texts array<string>")
    rows = lambda df: sorted((r["page"], r["bubble"], r["translated"], r["status"]) for r in df.withColumn("translated", F.coalesce("translated", F.lit("-"))).collect())
    assert rows(alignment.with_fallback(bubbles, answers)) == [(1, 0, "A", "answer"), (1, 1, "-", "missing"), (2, 0, "c", "fallback")]
    assert rows(alignment.reconciled(bubbles, answers)) == [(1, 0, "A", "answer"), (1, 1, "b", "padded"), (2, 0, "c", "padded")]
    assert rows(alignment.strict(bubbles, answers)) == [(1, 0, "a", "fallback"), (1, 1, "b", "fallback"), (2, 0, "c", "fallback")]


def test_unknown_translator_is_refused():
    with pytest.raises(ValueError, match="Invalid translation method."):
        providers.translator("abc")


class Moody:
    def __init__(self, errors, short=False):
        self.errors, self.short, self.calls = list(errors), short, 0

    def translate_single(self, text):
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    def translate_batch(self, texts):
        self.calls += 1
        if self.errors:
            raise RuntimeError(self.errors.pop(0))
        return [t.upper() for t in texts][: -1 if self.short else None]


@pytest.mark.parametrize(
    "service,want",
    [(Moody([]), ["batch", "blank", "batch"]), (Moody(["503"]), ["batch", "blank", "batch"]), (Moody(["429"]), ["quota", "blank", "quota"]), (Moody([], short=True), ["single", "blank", "source"])],
)
def test_failure_ladder(service, want):
    waits = []
    got = providers.with_ladder(service, ["good", " 　", "bad"], sleep=waits.append)
    assert [s for _, s in got] == want and got[1][0] == " 　"
    assert waits == ([0.5, 1.0] if service.short else [0.5] if want[0] == "batch" and service.calls == 2 else [])


def test_options_have_defaults():
    o = JobOptions.of({"selected_translator": "Opus-mt model", "selected_font": "Yuki-Burobu", "selected_language": "Klingon", "context_memory": "on", "custom_prompt": "  be kind "})
    assert (o.translator, o.font, o.source, o.target, o.style, o.context_memory, o.split_long) == ("hf", "Yuki-Burobu", "ja", "vi", "be kind", True, False)
    assert JobOptions.of({"selected_font": "AnimeAce"}).font == "animeace_"


def picture():
    p = np.full((120, 160, 3), 255, np.uint8)
    p[20:70, 30:110] = 10
    p[40:45, 50:60] = 255
    p[100:104, 5:9] = 0
    return p


def test_pages_from_files_to_lines(spark, tmp_path):
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(png(picture()))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    pages = numbered(read_images(spark, str(tmp_path)))
    assert sorted((r["page"], r["name"], r["height"], r["width"]) for r in pages.collect()) == [(0, "a", 120, 160), (1, "b", 120, 160)]
    boxes = spark.createDataFrame([(0, 0, 28.0, 18.0, 112.0, 71.0, 0.9), (1, 0, 0.0, 80.0, 20.0, 119.0, 0.7)], "page long, ord int, x1 double, y1 double, x2 double, y2 double, conf double")
    found = translate.detect(pages, boxes)
    assert sorted((r["page"], r["ord"], r["is_dark"], r["x1"]) for r in found.collect()) == [(0, 0, 0, 28.0), (1, 0, 1, 30.0), (1, 1, 0, 0.0)]
    texts = translate.recognise(images.cut_out(pages, found), lambda h, w, data: f"a box of {w} by {h}")
    done = translate.translate(texts, "gemini", "fr", wait=False)
    assert {r["status"] for r in done.collect()} == {"batch"}
    lines = translate.lettered(done, found).collect()
    assert {(r["page"], r["bubble"]) for r in lines} == {(0, 0), (1, 0), (1, 1)} and {r["ink"] for r in lines if (r["page"], r["bubble"]) == (1, 0)} == {"white"}


def test_pixel_operators():
    p = picture()
    shade = images.grey(p)
    assert shade[0, 0] == 255 and shade[20, 30] == 10
    kept = images.regions(images.cleaned(shade <= images.DARK))
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in kept if r["w"] > 20] == [(30, 20, 80, 50)]
    out, dark, box = images.erase(p[20:70, 30:110])
    assert dark and box == (0, 0, 80, 50) and not out.any()
    out, dark, _ = images.erase(p)
    assert not dark and (out[0:15] == 255).all() and (images.swapped(p)[0, 0] == p[0, 0]).all()


def test_row_profiles(spark):
    p = picture()
    df = spark.createDataFrame([(3, 120, 160, bytearray(p.tobytes()))], "page long, height int, width int, data binary")
    got = {r["y"]: r["mean"] for r in images.row_profiles(df).collect()}
    assert got[0] == 255.0 and abs(got[25] - (80 * 255 + 80 * 10) / 160) < 1e-9 and len(got) == 120


def test_pictures_are_never_broadcast(spark, tmp_path):
    # a file of few bytes a picture: Spark's estimate of the pictures is small, whatever they come to
    spark.range(300).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    df = queries.cut_out_boxes(spark, str(tmp_path))
    got = {r["page"]: (r["height"], r["width"], r["bytes"], r["digits"]) for r in df.collect()}
    assert got == {k: (8 + k % 15, 10 + k % 18, (8 + k % 15) * (10 + k % 18) * 3, f"{k % 40:02X}" * ((8 + k % 15) * (10 + k % 18) * 3)) for k in range(300)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not [line for line in exchanges if "data" in line]


def test_cut_out_leaves_pages_without_boxes(spark):
    p = picture()
    pages = spark.createDataFrame([(k, 120, 160, bytearray(p.tobytes())) for k in range(3)], "page long, height int, width int, data binary")
    boxes = spark.createDataFrame([(2, 1, 30.0, 20.0, 31.0, 22.0, 1), (2, 0, 0.0, 0.0, 1.0, 1.0, 0), (1, 0, 200.0, 0.0, 210.0, 5.0, 0)], "page long, ord int, x1 double, y1 double, x2 double, y2 double, is_dark int")
    got = sorted((r["page"], r["bubble"], r["height"], r["width"], bytes(r["data"]), r["force_dark"]) for r in images.cut_out(pages, boxes).collect())
    assert got == [(2, 0, 1, 1, b"\xff" * 3, False), (2, 1, 2, 1, b"\x0a" * 6, True)]


def test_archives(spark):
    body = json.dumps([{"name": "x", "data": "aGk="}, {"data": "eW8="}])
    out = archives.zipped(archives.listed(spark.createDataFrame([(1, body)], "job long, images string"))).first()["archive"]
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"x_translated.jpg": b"hi", "image_2_translated.jpg": b"yo"}


def test_prompt_and_tables():
    text = providers.prompt(["一"], "ja", "xx", "formal", "CONTEXT\n")
    assert text.startswith("CONTEXT\nTranslate the texts below from Japanese to English.") and tables.STYLE_PRESETS["formal"] in text and text.endswith('["一"]')


def test_running_counts_of_a_stream(spark, tmp_path):
    rows = [(1, 0, "Hanako met Hanako"), (2, 0, "Tanaka met Hanako")]
    spark.createDataFrame(rows, "page long, bubble long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("page long, bubble long, text string").parquet(f"{tmp_path}/in")
    q = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        q.processAllAvailable()
        assert {r["term"]: r["n"] for r in spark.table("running").collect()} == {"Hanako": 6, "met": 2, "Tanaka": 2}
    finally:
        q.stop()


def test_batches_of_many_pages_with_columns(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    pages = spark.range(120_000).selectExpr("id * 7 % 1200007 AS page", "concat('text ', id) AS text", "id AS other")
    want = pages.selectExpr("page", "text", "other", "row_number() OVER (ORDER BY page) - 1 AS w").cache()
    try:
        for n in ("1", "8", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            wrong = terms.batches(pages).join(want.withColumnRenamed("text", "t"), ["page", "other"]).where("number <> w OR batch <> floor(w / 10) OR text <> t")
            assert terms.batches(pages).count() == 120_000 and wrong.isEmpty()
            one = terms.batches(pages.select("page")).join(want, "page").where("number <> w")
            assert one.isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def png_of(picture, colour):
    """A PNG file of a grey (0) or RGBA (6) picture."""
    height, width = picture.shape[:2]
    raw = b"".join(b"\0" + picture[y].tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_grey_and_alpha_images_are_kept(spark, tmp_path):
    rng = np.random.default_rng(3)
    grey, alpha = rng.integers(0, 256, (7, 5), np.uint8), rng.integers(0, 256, (6, 4, 4), np.uint8)
    alpha[..., 3] = 255
    (tmp_path / "g.png").write_bytes(png_of(grey, 0))
    (tmp_path / "a.png").write_bytes(png_of(alpha, 6))
    (tmp_path / "c.png").write_bytes(png(alpha[..., :3].copy()))
    got = {r["name"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3) for r in read_images(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "c", "g"]
    assert np.array_equal(got["g"], np.repeat(grey[..., None], 3, 2))
    assert np.array_equal(got["a"], alpha[..., 2::-1]) and np.array_equal(got["c"], got["a"])


def test_an_empty_folder_has_no_images(spark, tmp_path):
    assert read_images(spark, str(tmp_path)).collect() == []


def flood(mask, corners):
    label, k = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        k += 1
        label[y, x], left = k, [(y, x)]
        while left:
            a, b = left.pop()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    c, d = a + i, b + j
                    if (corners or not i * j) and 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not label[c, d]:
                        label[c, d] = k
                        left.append((c, d))
    return label


def test_regions_match_flood_fill():
    rng = np.random.default_rng(8)
    for _ in range(150):
        mask = rng.random((rng.integers(1, 18), rng.integers(1, 18))) < rng.random()
        label = flood(mask, True)
        assert np.array_equal(images.labelled(mask), label)
        want = []
        for k in range(1, label.max() + 1):
            ys, xs = np.nonzero(label == k)
            want.append((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1))
        assert [(r["x"], r["y"], r["w"], r["h"]) for r in images.regions(mask)] == want
        outside = flood(np.pad(~mask, 1, constant_values=True), False) == 1
        assert np.array_equal(images._filled(mask), ~outside[1:-1, 1:-1])


def test_masks_grow_and_shrink_by_the_ellipse():
    rng = np.random.default_rng(4)
    around = [(y - 2, x - 2) for y in range(5) for x in range(5) if images.ELLIPSE[y][x]]
    for _ in range(40):
        mask = rng.random(tuple(rng.integers(1, 14, 2))) < rng.random()
        height, width = mask.shape
        for grow, meet in ((True, any), (False, all)):
            want = [[meet(mask[y + a, x + b] for a, b in around if 0 <= y + a < height and 0 <= x + b < width) for x in range(width)] for y in range(height)]
            assert np.array_equal(images._morph(mask, grow), np.array(want, bool))


def test_colours_are_swapped():
    p = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert images.swapped(p)[1, 2].tolist() == p[1, 2].tolist()[::-1] != p[1, 2].tolist()


def test_long_pages_are_shown_in_parts(spark):
    def boxer():
        """A detector that sees dark boxes of ten rows or more."""
        from inkwell.operators import images as im

        def see(height, width, data):
            found = im.regions(im.grey(im.pixels(height, width, data)) < 100)
            return [(r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"], 0.9, 0) for r in found if r["h"] >= 10]

        return see

    plain = np.full((300, 200, 3), 128, np.uint8)
    plain[50:90, 20:80] = 0
    tiled = np.full((4000, 200, 3), 128, np.uint8)  # no gutters: overlapping tiles, so a box may be seen twice
    tiled[1320:1480, 10:60] = 0
    tiled[3900:3960, 10:60] = 0
    cut = np.full((4000, 200, 3), 128, np.uint8)
    cut[1500:1540] = 255
    cut[700:800, 30:90] = 0
    cut[2900:3000, 30:90] = 0
    rows = [(k, *p.shape[:2], bytearray(p.tobytes())) for k, p in enumerate((plain, tiled, cut))]
    pages = spark.createDataFrame(rows, "page long, height int, width int, data binary")
    got = sorted((r["page"], r["y1"], r["y2"]) for r in translate.found_boxes(pages, boxer, "boxer").collect())
    assert got == [(0, 50, 90), (1, 1320, 1480), (1, 3900, 3960), (2, 700, 800), (2, 2900, 3000)]


def test_flags_of_a_detector_may_be_null(spark):
    boxes = spark.createDataFrame([(0, 0, 1.0, 1.0, 9.0, 9.0, 0.5, None), (0, 1, 20.0, 1.0, 29.0, 9.0, 0.5, 1)], "page long, ord int, x1 double, y1 double, x2 double, y2 double, conf double, is_dark int")
    pages = spark.createDataFrame([], "page long, height int, width int, data binary")
    for dark in (False, True):
        assert sorted((r["x1"], r["is_dark"]) for r in translate.detect(pages, boxes, dark).collect()) == [(1.0, 0), (20.0, 1)]


class Busy:
    def __init__(self, *errors):
        self.errors, self.calls = list(errors), 0

    def __call__(self, height, width, data):
        self.calls += 1
        if self.errors:
            raise RuntimeError(self.errors.pop(0))
        return f"{height}x{width}"


@pytest.mark.parametrize("errors,want,waits", [((), ("2x3", None), [0.3]), (("HTTP 503",), ("2x3", None), [0.3, 3.0]), (("no",), ("", "no"), [0.3]), (("429",) * 9, ("", "429"), [0.3, 3.0, 6.0, 12.0, 24.0])])
def test_reading_is_tried_again(errors, want, waits):
    slept = []
    assert providers.read_text(Busy(*errors), (2, 3, b""), sleep=slept.append, chance=lambda: 0.5) == want
    assert slept == pytest.approx(waits)


def test_reading_in_batches():
    class Whole(Busy):
        def process_batch(self, crops):
            return [None if c[0] == 1 else "seen" for c in crops]

    crops = [(1, 1, b""), (2, 2, b"")]
    assert providers.read_texts(Whole(), crops) == [("", None), ("seen", None)]
    assert providers.read_texts(Busy(), crops, sleep=lambda _: None) == [("1x1", None), ("2x2", None)] and providers.read_texts(Busy(), []) == []


class Pages(Moody):
    def __init__(self, answer, **more):
        super().__init__([], **more)
        self.answer, self.seen = answer, []

    def translate_pages_batch(self, pages, context):
        self.seen.append(context)
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


def test_ladder_of_pages():
    pages = {"p": ["a", "b"], "q": ["c"], "r": ["d"]}
    service = Pages({"p": ["A"], "q": ["C", "X"]})
    assert providers.with_page_ladder(service, pages, "CONTEXT") == {"p": [("A", "pages"), ("b", "padded")], "q": [("C", "pages")], "r": [("d", "fallback")]}
    assert service.seen == ["CONTEXT"]
    assert providers.with_page_ladder(Pages(RuntimeError("no")), pages) == {n: [(t.upper(), "batch") for t in x] for n, x in pages.items()}
    assert providers.with_page_ladder(Pages(["no object"], short=True), {"p": ["good", "bad"]}, sleep=lambda _: None) == {"p": [("GOOD", "single"), ("bad", "source")]}
    assert providers.with_page_ladder(Moody([]), {"p": ["x"]}) == {"p": [("X", "batch")]}


def test_page_batches_carry_terms(spark):
    class Echo(providers.StubTranslator):
        def translate_pages_batch(self, pages, context):
            return {n: [context + t for t in x] for n, x in pages.items()}

    providers.register("echo", Echo)
    rows = [(page, b, "Hanako met Tanaka" if b else " ") for page in range(4) for b in range(2)] + [(9, 0, " ")]
    import unittest.mock as mock

    with mock.patch.dict(providers._kept, clear=True):
        from inkwell.plans.providers import translate_page_groups

        context = "---\nCONTEXT MEMORY:\nKEY TERMS (translate consistently):\n  Hanako (×4)\n---\n"
        import pandas as pd

        frame = pd.DataFrame({"batch": 1, "page": [2, 2], "bubble": [1, 0], "text": ["Hanako", None], "prompt": context})
        got = translate_page_groups("echo", "en", wait=False)(frame)
        assert got["translated"].tolist() == [context, context + "Hanako"] and set(got["status"]) == {"pages"}
    done = translate.translate_pages(spark.createDataFrame(rows, "page long, bubble long, text string"), "gemini", "fr", 2, wait=False).collect()
    assert len(done) == 9 and {(r["page"], r["status"]) for r in done} == {(p, "pages") for p in range(4)} | {(9, "blank")}


def test_providers_are_kept_and_fall_back():
    providers.clear_cache()
    made = []
    for _ in range(2):
        providers.cached("k", lambda: made.append(1) or "v")
    assert made == [1]

    class Fonts:
        def load(self, path, size):
            if path == "gone":
                raise OSError
            return path, size

        def default(self, size):
            return "default", size

    assert providers.font(Fonts(), "a", 12) == ("a", 12) and providers.font(Fonts(), "gone", 9) == ("default", 9)

    class Down:
        def models(self):
            raise OSError

        def probe(self):
            raise OSError

    assert providers.model_names(Down(), ["m"]) == ["m"] and not providers.answers(Down())


def test_other_prompts():
    text = providers.pages_prompt({"p1": ["一"]}, "zh", "en", "", "CONTEXT\n")
    assert text.startswith("CONTEXT\n") and text.endswith('{\n  "p1": [\n    "一"\n  ]\n}') and "from Chinese to English" in text
    assert providers.single_prompt("一", "ja", "en").endswith("\n一") and all(f in providers.font_prompt() for f in tables.FONTS)
    assert "[TERMS]" in providers.extraction_prompt()


def test_timers_and_settings():
    from inkwell.plans.timers import Timers
    from inkwell.sources.options import Settings

    ticks = iter([0.0, 2.0, 5.0, 6.0])
    timers = Timers(lambda: next(ticks))
    with timers.phase("read", 4):
        pass
    with timers.phase("write"):
        pass
    assert timers.rows() == [("read", 2.0, 4, 2.0, 0.5), ("write", 1.0, 0, 0.0, None), ("total", 3.0, 4, 4 / 3, 0.75)]
    settings = Settings.of({"VERBOSE_LOG": "1", "GEMINI_API_KEY": "k"})
    assert settings.verbose and settings.key_for(JobOptions.of({})) == "k" and settings.key_for(JobOptions.of({"gemini_api_key": " j "})) == "j"


def test_archives_with_a_folder(spark):
    body = json.dumps([{"name": "x", "data": "aGk="}])
    out = archives.zipped(archives.listed(spark.createDataFrame([(1, body)], "job long, images string")), "png", "in/")
    assert [(r["job"], r["i"], r["name"], bytes(r["data"])) for r in archives.contents(out).collect()] == [(1, 0, "in/x_translated.png", b"hi")]
    assert spark.createDataFrame([("aGk=",)], "t string").select(archives.decoded(F.col("t")).alias("v")).first()["v"] == b"hi"


def test_target_languages_have_defaults(spark):
    df = spark.createDataFrame([("xx",), ("en",)], "lang string")
    got = [tuple(r) for r in df.select(exprs.lookup(F.col("lang"), tables.LANGUAGE_NAMES, F.lit("English")), exprs.lookup(F.col("lang"), tables.NLLB_CODES, F.lit("eng_Latn"))).collect()]
    assert got == [("English", "eng_Latn"), ("English", "eng_Latn")]


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    schema = "page long, bubble long, text string, at timestamp"
    folder = tmp_path / "late"
    for k, rows in enumerate(([(1, 0, "Hanako", "2024-01-01 10:10:00")], [(2, 0, "Tanaka", "2024-01-01 15:00:00")], [(3, 0, "Hanako", "2024-01-01 10:20:00"), (4, 0, "Tanaka", "2024-01-01 15:05:00")])):
        spark.createDataFrame(rows, "page long, bubble long, text string, at string").selectExpr("page", "bubble", "text", "CAST(at AS TIMESTAMP) AS at").coalesce(1).write.mode("append").parquet(str(folder))
        if not k:
            stream = spark.readStream.schema(schema).parquet(str(folder))
            q = running_counts(stream, "at").writeStream.outputMode("update").format("memory").queryName("late").start()
        q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("late").collect():
        got[r["term"], str(r["window"]["start"])] = max(r["n"], got.get((r["term"], str(r["window"]["start"])), 0))
    assert got == {("Hanako", "2024-01-01 10:00:00"): 2, ("Tanaka", "2024-01-01 15:00:00"): 4}
