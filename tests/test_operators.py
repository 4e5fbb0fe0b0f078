import json
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pii_lens.functions import boxes as box_fn, text as text_fn
from pii_lens.operators import boxes as box_op, detect, lint, measure, pages, pixels, providers, replies, track, words
from pii_lens.operators.replies import parse_replies
from pii_lens.plans import catalog
from pii_lens.sources import files

WORD = "page_id long, pos int, text string, left int, top int, width int, height int"


def page(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], WORD)


def boxes_of(df):
    return sorted(tuple(r)[1:] for r in df.select("page_id", "left", "top", "width", "height").collect())


@pytest.mark.parametrize(
    "label, personal",
    [("Bank Account Number", True), ("Bank Name", False), ("Branch Code", False), ("Policyholder Name", True), ("Mobile Number", True), ("Driving Licence No", True), ("customer_name", True), ("Amount", False), ("Date", False), ("A/C No.", True), ("मोबाइल", True)],
)
def test_label_decision(spark, label, personal):
    df = spark.createDataFrame([(label,)], "x string").select(text_fn.is_pii_label(text_fn.label_norm(F.col("x"))).alias("p"))
    assert df.first()["p"] is personal


def test_label_norm_joins_single_characters(spark):
    rows = spark.createDataFrame([("A/C No.",), ("No 5",), ("Tempat/Tgl Lahir",), ("",)], "x string").select(text_fn.label_norm(F.col("x")).alias("n")).collect()
    assert [r["n"] for r in rows] == ["ac no", "no5", "tempat tgl lahir", ""]


def test_a_value_stands_right_or_beneath(spark):
    far = page(spark, ("Folio", 20, 50, 50, 10), ("77-31", 191, 52, 60, 10), ("Branch", 20, 90, 60, 10), ("Kandy", 100, 90, 50, 10))
    assert boxes_of(words.label_values(far)) == []  # 121 from the label's edge: over 12 heights
    near = page(spark, ("Folio", 20, 50, 50, 10), ("77-31", 190, 52, 60, 10), ("rev.", 400, 49, 30, 10))
    assert boxes_of(words.label_values(near)) == [(190, 49, 240, 13)]  # what follows a value in its row belongs to it
    assert boxes_of(words.label_values(near, scale=4)) == [(47, 12, 60, 3)]
    below = page(spark, ("Nominee", 300, 40, 90, 12), ("Ruwan", 309, 60, 60, 12), ("Perera", 380, 61, 70, 12), ("17", 40, 60, 20, 12))
    assert boxes_of(words.label_values(below)) == [(309, 60, 141, 13)]
    pair = page(spark, ("PNR", 5, 5, 30, 10), ("Q4Z9", 50, 5, 40, 10), ("Ticket", 120, 5, 50, 10), ("0098", 180, 5, 40, 10))
    assert boxes_of(words.label_values(pair)) == [(50, 5, 40, 10), (180, 5, 40, 10)]
    assert boxes_of(words.label_values(page(spark))) == []


def test_values_move_with_the_page_and_scale_down(spark):
    rows = page(spark, ("UPI", 12, 30, 30, 10), ("lena@bank", 60, 31, 90, 10), ("Guardian", 12, 80, 80, 10), ("Ola", 110, 80, 30, 10), ("Berg", 150, 82, 40, 10))
    base = boxes_of(words.label_values(rows))
    assert len(base) == 2
    assert boxes_of(words.label_values(words.shifted(rows, 333, 71))) == [(x + 333, y + 71, w, h) for x, y, w, h in base]
    assert boxes_of(words.label_values(words.scaled(rows, 3), scale=3)) == base


def test_reading_order_follows_drifting_rows(spark):
    # Two lines that fall by two pixels a word; a blank stands between them.
    first, second = ([(f"{k}{i}", 40 * i, y + 2 * i, 30, 10) for i in range(6)] for k, y in (("a", 10), ("b", 30)))
    order = words.reading_order(page(spark, *second, ("  ", 0, 0, 500, 500), *first)).orderBy("nth").collect()
    rows = [*second, ("  ",), *first]
    assert [rows[r["pos"]][0] for r in order] == [f"a{i}" for i in range(6)] + [f"b{i}" for i in range(6)]


def test_full_width_labels_and_blank_words(spark):
    raw = page(spark, ("\uff30\uff21\uff2e", 10, 10, 30, 10), (" ", 45, 10, 5, 10), (None, 47, 10, 5, 10), ("Q1", 60, 10, 20, 10)).withColumn("variant", F.lit(0))
    read = pages.ordered(raw)
    assert sorted((r["pos"], r["text"]) for r in read.collect()) == [(0, "PAN"), (1, "Q1")]
    assert boxes_of(pages.label_boxes(read)) == [(60, 10, 20, 10)]


def test_veto(spark):
    schema = "page_id long, pos int, label string, left int, top int, width int, height int"
    region = spark.createDataFrame([(1, 100, 200, 200, 30)], "page_id long, left int, top int, width int, height int")
    rows = [(1, 0, "PERSON", 100, 200, 200, 30), (1, 1, "IN_PAN", 100, 200, 200, 30), (1, 2, "PERSON", 220, 200, 200, 30), (1, 3, "PERSON", 200, 200, 200, 30), (1, 4, "PERSON", 140, 200, 200, 30), (1, 5, "PERSON", 100, 200, 0, 0)]
    kept = {r["pos"] for r in box_op.veto(spark.createDataFrame(rows, schema), region).collect()}
    assert kept == {1, 2, 5}
    assert box_op.veto(spark.createDataFrame(rows, schema), region.limit(0)).count() == 6


def test_block_merge_is_the_closure_of_nearness(spark):
    schema = "page_id long, label string, left int, top int, width int, height int"
    rng = random.Random(5)
    rows = [("LOCATION", rng.randrange(300), rng.randrange(300), rng.randrange(5, 60), rng.randrange(8, 20)) for _ in range(40)]

    def closure(items):
        """All rectangles take in all that is near them, until none changes."""
        m = sorted(h for *_, h in items)[len(items) // 2]
        rects = {(x, y, x + w, y + h) for _, x, y, w, h in items}
        gap = lambda a, b, k: max(a[k], b[k]) - min(a[k + 2], b[k + 2])
        while True:
            groups = [[b for b in rects if gap(a, b, 1) <= 1.6 * m and gap(a, b, 0) <= 0.5 * m] for a in rects]
            grown = {(min(r[0] for r in g), min(r[1] for r in g), max(r[2] for r in g), max(r[3] for r in g)) for g in groups}
            if grown == rects:
                return sorted((a, b, c - a, d - b) for a, b, c, d in rects)
            rects = grown

    df = spark.createDataFrame([(p, *rows[i]) for p in range(3) for i in rng.sample(range(40), 40)], schema)
    got = box_op.merge_blocks(df)
    for p in range(3):
        assert boxes_of(got.where(f"page_id = {p}")) == closure(rows)


def test_spans_have_offsets_in_code_points(spark):
    df = spark.createDataFrame([(1, "é😀 a@b.co, c@d.org"), (2, None), (3, "")], "doc_id long, text string")
    rows = detect.detect(df, catalog.named("email")).orderBy("span_start").collect()
    assert [(r["doc_id"], r["span_start"], r["span_end"]) for r in rows] == [(1, 3, 9), (1, 11, 18)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_redaction_joins_overlaps(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "keep"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 6, 7), (3, 0, 1)], "doc_id long, span_start int, span_end int")
    assert {r["doc_id"]: r["redacted"] for r in detect.redact_by(df, spans).collect()} == {1: "a[#]f[#]h", 2: "keep", 3: None}


def test_detection_and_redaction_move_no_row(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert exchanges(detect.detect(df)) == 0 and exchanges(detect.redact(df)) == 0


def test_spans_and_redaction_of_long_texts(spark):
    # More spans than a running sum keeps in a block, and more runs than are cut out at once; astral characters count as one.
    unit = "\U0001f600 mail k%d@host.org, "
    text = "".join(unit % k for k in range(700))
    df = spark.createDataFrame([(1, text), (1, text), (None, ""), (2, None)], "doc_id long, text string").withColumns({"score": F.lit("x"), "found": F.lit(1)})
    rs = catalog.named("email")
    want = [(m.start(), m.end()) for m in re.finditer(r"k\d+@host\.org", text)]
    got = [(r["span_start"], r["span_end"]) for r in detect.detect(df, rs).collect()]
    assert sorted(got) == sorted(want * 2) and len(want) == 700
    out = sorted((r["doc_id"] or 0, r["redacted"]) for r in detect.redact(df.where("doc_id is null or doc_id = 1"), rs).collect())
    assert out == [(0, "")] + [(1, re.sub(r"k\d+@host\.org", "[#]", text))] * 2
    assert detect.detect(df.limit(0), rs).count() == 0 and detect.redact(df.limit(0), rs).count() == 0


def test_context_is_found_however_long_the_words_between(spark):
    long = "z" * 3000
    rows = [(1, f"ifsc {long} ABCD0123456"), (2, f"ifsc a b c d e {long} ABCD0123456"), (3, f"{long}ifsc ABCD0123456"), (4, "x" * 500 + " ifsc a b c d ABCD0123456")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in detect.detect(df, catalog.named("ifsc")).collect()}
    assert got == {1: 1.0, 2: 0.7, 3: 0.7, 4: 1.0}


def test_gstin_check_character(spark):
    df = spark.createDataFrame([(1, "27AAPFU0939F1ZV"), (2, "27AAPFU0939F1ZW")], "doc_id long, text string")
    assert [r["doc_id"] for r in detect.detect(df, catalog.named("gstin")).collect()] == [1]
    assert not any(r.name == "aadhaar_tolerant" for r in catalog.registry(True)) and len(catalog.registry()) == len(catalog.RECOGNIZERS)


def test_checksums(spark):
    rows = spark.createDataFrame([("2363",), ("2364",), ("",)], "x string").select(text_fn.verhoeff_ok(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in rows] == [True, False, False]


def test_replies(spark):
    def parse(content):
        df = spark.createDataFrame([(1, content, 1000, 500)], "page_id long, content string, page_w int, page_h int")
        return [tuple(r)[1:] for r in parse_replies(df).collect()]

    one = '{"items": [{"text": "x", "kind": "name", "box": [%s]}]}'
    assert parse(one % "0.25, 0.5, 0.5, 1.0") == [("vlm_name", 250, 250, 250, 250, None)]
    assert parse(one % "100, 200, 300, 1001")[0][1:3] == (100, 100)  # over the longer side: thousandths
    assert parse("```json\n" + one % "10, 20, 30, 40" + "\n```") == [("vlm_name", 10, 20, 20, 20, None)]
    assert parse("So: " + one % "30, 40, 10, 20" + " done") == [("vlm_name", 10, 20, 20, 20, None)]
    assert parse(one % "10, 20, 30") == [] and parse(one % "10, 20, 10, 20") == []
    assert parse("nothing")[0][-1] == "no JSON in reply"


def test_governance(spark):
    roots, held = {"holdout": "/d/holdout", "documents": "/d/documents"}, ["holdout"]
    for target in ("holdout", "/d/holdout", "/d/holdout/images", "/d/holdout/"):
        with pytest.raises(track.HeldOutCorpusError):
            track.refuse_tuning(target, roots, held, "a sweep")
    for target in ("documents", "/d/documents", "/d/holdouts", "unknown"):
        track.refuse_tuning(target, roots, held, "a sweep")
    keys = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "4"), ("b", "5")], "corpus string, file string")
    run = spark.createDataFrame([("3",), ("4",), ("1",)], "file string")
    track.check_matches(run, keys, "b")
    with pytest.raises(track.CorpusMismatchError, match="'b'"):
        track.check_matches(run, keys, "a")
    track.check_matches(run.limit(0), keys, "a")


def test_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (40, 60, 3), dtype=np.uint8)
    solid = pixels.redacted(image, [(10, 10, 30, 20)])
    assert not solid[10:20, 10:30].any() and (solid[:10] == image[:10]).all()
    assert pixels.covered(image, image, (0, 0, 5, 5)) == 0.0 and pixels.covered(image, image, (5, 5, 5, 9)) is None
    with pytest.raises(ValueError):
        pixels.redacted(image, [], "sparkle")
    (tmp_path / "a.png").write_bytes(pixels.png(image))
    got = files.images(spark, str(tmp_path)).first()
    assert (pixels.array(bytes(got["data"]), 40, 60, 3) == image).all()
    plain = {"exif_tags": 0, "has_gps": False, "has_thumbnail": False, "orientation": 1, "info_keys": []}
    assert pixels.metadata(pixels.png(image)) == plain
    ink = np.zeros((20, 20), bool)
    ink[2:5, 2:5] = ink[5:8, 5:8] = True  # touch at a corner
    ink[12:14, 12:18] = True
    assert len(pixels.parts(ink)) == 2


def test_tolerant_lines_and_corpus(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"corpus": "a", "recall_floor_pct": 90.0}\n\nnot json\n{"corpus": "a"}\n{"corpus": "b", "recall_floor_pct": 1.0}\n')
    assert files.history(spark, str(tmp_path / "h.jsonl"), "a").count() == 1
    (tmp_path / "annotations.json").write_text('{"_meta": {"held_out": true}, "p.png": {"source": "s", "visual": {"face": 1}, "pii": [{"field": "f", "text": "t"}]}}')
    meta, pages = files.corpus(spark, str(tmp_path / "annotations.json"))
    assert meta["held_out"] and files.items(pages).first()["tier"] == "core"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    from pii_lens.streaming.detect import documents, write_spans

    df = spark.createDataFrame([(i, f"mail a{i}@b.org now") for i in range(20)], "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    rs = catalog.named("email")
    write_spans(documents(spark, str(tmp_path / "in"), "doc_id long, text string", 1), str(tmp_path / "out"), str(tmp_path / "c"), rs, once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, detect.allowed(detect.detect(df, rs)).collect()))


def test_a_page_is_covered_from_its_words(spark, tmp_path):
    white = np.full((200, 500, 3), 255, np.uint8)
    rows = [("p.png", 0, 0, "mail", 10, 20, 40, 10), ("p.png", 0, 1, "a@b.org", 60, 20, 70, 10), ("p.png", 1, 0, "mail", 10, 20, 40, 10), ("p.png", 1, 1, "a@b.org", 60, 20, 70, 10), ("p.png", 0, 2, "Folio", 10, 120, 50, 10), ("p.png", 0, 3, "7-1", 80, 120, 30, 10)]
    read = spark.createDataFrame(rows, "page_id string, variant int, pos int, text string, left int, top int, width int, height int")
    protected = spark.createDataFrame([("p.png", 0, 0, 500, 200)], "page_id string, left int, top int, width int, height int")
    found = pages.regions(read, catalog.named("email"), protected=protected)
    assert sorted(map(tuple, found.collect())) == [("p.png", "EMAIL_ADDRESS", 60, 20, 70, 10), ("p.png", "labelled_value", 80, 120, 30, 10)]
    half = pages.regions(read, catalog.named("email"), factors=spark.createDataFrame([("p.png", 2)], "page_id string, factor int"))
    assert boxes_of(half) == [(30, 10, 35, 5), (40, 60, 15, 5)]
    (tmp_path / "in").mkdir()
    for name in ("p.png", "q.png"):
        (tmp_path / "in" / name).write_bytes(pixels.png(white))
    images = files.images(spark, str(tmp_path / "in"))
    broken = spark.createDataFrame([("r.png", 500, 200, 3, b"short")], "name string, width int, height int, nChannels int, data binary")
    done = pixels.write_images(pixels.render(images.unionByName(broken), pages.to_cover(found, images)), str(tmp_path / "out")).collect()
    assert {(r["name"], r["status"], r["regions"]) for r in done} == {("p.png", "processed", 2), ("q.png", "no_pii_found", 0), ("r.png", "failed", 0)}
    out = {r["name"]: pixels.array(bytes(r["data"]), 200, 500, 3) for r in files.images(spark, str(tmp_path / "out")).collect()}
    assert (out["q.png"] == 255).all() and not out["p.png"][20:30, 60:130].any() and (out["p.png"][60:100] == 255).all()
    framed = pixels.annotate(images, pages.to_cover(found, images).withColumn("verdict", F.lit("leaked"))).where("name = 'p.png'").first()
    assert framed["status"] == "processed" and framed["png"] is not None
    with pytest.raises(ValueError):
        pixels.render(images, pages.to_cover(found, images), "sparkle")


def test_signatures_variants_and_turned_pages(spark):
    page_ = np.full((300, 700, 3), 240, np.uint8)
    t = np.linspace(0, 6 * np.pi, 2500)
    for dx in range(2):  # one looping stroke above the cue
        page_[(150 + 25 * np.sin(t)).astype(int) + dx, (250 + 100 * t / 18 + 25 * np.cos(t)).astype(int)] = 10
    box = pixels.signature(page_, (280, 200, 80, 12))
    assert box and box[0] <= 240 and box[0] + box[2] >= 350 and box[1] < 150 < box[1] + box[3]
    assert pixels.signature(np.full((300, 700, 3), 240, np.uint8), (280, 200, 80, 12)) is None and pixels.signature(page_, (5000, 5000, 10, 10)) is None
    images = spark.createDataFrame([("s", 700, 300, 3, page_.tobytes())], "name string, width int, height int, nChannels int, data binary")
    cues = spark.createDataFrame([("s", "Signature:", 280, 200, 80, 12), ("s", "total", 0, 0, 9, 9)], "name string, text string, left int, top int, width int, height int")
    assert [tuple(r)[1:] for r in pixels.signatures(images, cues).collect()] == [box]
    size = pixels.measured(images)
    assert size.first()["factor"] == 1 and size.first()["error"] is None
    copies = pixels.variant_rows(images, size).orderBy("variant").collect()
    assert [(r["variant"], r["height"], r["nChannels"]) for r in copies] == [(0, 300, 3), (1, 300, 1), (2, 300, 1)]
    assert set(copies[2]["data"]) <= {0, 255} and len(pixels.variants(page_, 2, union=False)[0]) == 600
    flat = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    assert pixels.enlarged(np.full((4, 5, 1), 9, np.uint8), 3).shape == (12, 15, 1) and (pixels.enlarged(np.full((4, 5, 1), 9, np.uint8), 3) == 9).all()
    assert pixels.upright(flat, 6)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]] and pixels.upright(flat, 3)[:, :, 0].tolist() == [[5, 4, 3], [2, 1, 0]]
    assert pixels.upright(flat, 8)[:, :, 0].tolist() == [[2, 5], [1, 4], [0, 3]] and pixels.upright(flat, 1) is not None
    ink = np.zeros((9, 40), bool)
    ink[4, 20] = True
    assert pixels.thickened(ink).sum() == 11 * 7


def test_metadata_of_a_photograph(spark):
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    first = struct.pack("<H", 2) + entry(0x0112, 3, 1, 6) + entry(0x8825, 4, 1, 99) + struct.pack("<I", 8 + 2 + 24 + 4)
    second = struct.pack("<H", 1) + entry(0x0201, 4, 1, 200) + struct.pack("<I", 0)
    exif = b"Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + first + second
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xfe" + struct.pack(">H", 6) + b"note" + b"\xff\xda"
    want = {"exif_tags": 2, "has_gps": True, "has_thumbnail": True, "orientation": 6, "info_keys": ["comment"]}
    assert pixels.metadata(jpeg) == want and pixels.metadata(b"")["exif_tags"] == 0 and pixels.metadata(jpeg[:40])["orientation"] in (1, 6)
    files_ = spark.createDataFrame([("a.jpg", jpeg), ("b.png", None)], "path string, content binary")
    assert {r["path"]: r["orientation"] for r in pixels.described(files_).collect()} == {"a.jpg": 6, "b.png": 1}


def test_a_failing_configuration_is_a_row(spark):
    def score(config):
        if config["bad"]:
            return spark.range(1).select(F.raise_error(F.lit("no")).cast("double").alias("recall_floor_pct"))
        return spark.range(1).select(F.lit(config["x"]).alias("recall_floor_pct"))

    configs = {"a": {"bad": False, "x": 50.0}, "b": {"bad": True}, "c": {"bad": False, "x": 70.0}}
    got = track.sweep(spark, configs, score, "documents", {"holdout": "/d/h"}, ["holdout"]).collect()
    assert [(r["config"], r["recall_floor_pct"], r["error"] is None) for r in got] == [("c", 70.0, True), ("a", 50.0, True), ("b", None, False)]
    with pytest.raises(track.HeldOutCorpusError):
        track.sweep(spark, configs, score, "/d/h/x", {"holdout": "/d/h"}, ["holdout"])
    assert track.sweep(spark, {}, score, "documents", {}, []).count() == 0
    assert [r["error"] is None for r in track.suite(spark, {n: (lambda c=c: score(c)) for n, c in configs.items()}).collect()] == [True, False, True]
    assert [r[0] for r in track.first_of(spark.range(9), ["id"], 2).collect()] == [0, 1] and track.first_of(spark.range(9), ["id"], None).count() == 9
    with pytest.raises(RuntimeError, match="no input /nowhere; no names provider 'x'"):
        track.prerequisites(spark, ["/nowhere"], [("names", "x")])
    track.prerequisites(spark, ["/root/testdata"])


def test_folders_corpora_and_sinks(spark, tmp_path):
    image = pixels.png(np.zeros((3, 4, 3), np.uint8))
    for name in ("b.PNG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(image)
    assert [r["path"].rsplit("/", 1)[1] for r in files.image_files(spark, str(tmp_path)).collect()] == ["a.png", "b.PNG"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.image_files(spark, str(tmp_path / "none"))
    for corpus in ("one", "two"):
        (tmp_path / "all" / corpus).mkdir(parents=True)
        (tmp_path / "all" / corpus / "annotations.json").write_text('{"_meta": {}, "p.png": {"pii": []}, "r.png": {"pii": []}}')
    assert files.catalog(spark, str(tmp_path / "all")) == ["one", "two"]
    with pytest.raises(FileNotFoundError, match="one, two"):
        files.load(spark, str(tmp_path / "all"), "three")
    _, held = files.load(spark, str(tmp_path / "all"), "two")
    assert files.existing(held, spark.createDataFrame([("r.png",), ("r.png",)], "filename string")).count() == 1
    out = str(tmp_path / "corpus")
    files.write_corpus({"licence": "ö"}, held.select("filename", "pii"), out)
    meta, again = files.corpus(spark, out)
    assert meta == {"licence": "ö"} and again.count() == 2
    lines = str(tmp_path / "lines")
    for day in ("1", "2"):
        files.append_history(spark.createDataFrame([("r" + day, "one", 9.0, True)], "run string, corpus string, recall_floor_pct double, held_out boolean"), lines)
    assert {r["run"] for r in files.history(spark, lines, "one").collect()} == {"r1", "r2"} and files.json_lines(spark, lines, "run string").count() == 2
    results = spark.createDataFrame([("processed", 1.5, {"PAN": 2, "UPI": 1}, {"face": 1}), ("failed", 0.25, None, None), ("processed", 1.0, {"PAN": 1}, {})], "status string, duration_seconds double, entities map<string,long>, visual_regions map<string,long>")
    read = lambda path: json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    files.write_summary(results, str(tmp_path / "summary"), {"run": "x"})
    body = read(str(tmp_path / "summary"))
    assert body["totals"] == {"images": 3, "processed": 2, "no_pii_found": 0, "failed": 1, "entities": 4, "visual_regions": 1} and body["entities_by_type"] == {"PAN": 3, "UPI": 1} and body["duration_seconds"] == 2.75
    (tmp_path / "s.json").write_text('{"results": [{"filename": "a", "visual_regions": {"face": 2}}, {"filename": "b", "visual_regions": null}]}')
    assert [tuple(r) for r in files.detections(spark, [str(tmp_path / "not"), str(tmp_path / "s.json")]).collect()] == [("a", "face", 2)] and files.detections(spark, []).count() == 0
    sets = measure.by_sets(spark.createDataFrame([("p", "PAN", "core", "redacted"), ("p", None, None, "leaked")], "page_id string, expected_type string, tier string, verdict string"))
    files.write_score(spark, {"k": 1}, sets, str(tmp_path / "score"))
    score = read(str(tmp_path / "score"))
    assert score["recall_floor_pct"] == 50.0 and score["by_image"] == {"p": {"redacted": 1, "leaked": 1, "unverifiable": 0}} and "(no recognizer)" in score["by_type"]


def test_a_report_says_what_it_leaves_out(spark):
    from pii_lens.plans import report

    table = spark.range(500).select("id")
    assert report.section("t", table).count("<tr>") == 501 and "more rows" not in report.section("t", table)
    assert "<p>490 more rows</p>" in report.section("t", table, 10) and "more rows" not in report.section("t", table, 500)
    assert "<polyline" in report.sparkline([0.0, 1.0]) and report.sparkline([1.0]) == "" and "2 times" in report.held_out_banner(1, 2, 2)
    assert "&lt;b&gt;" in report.render("<b>", {"t": table.limit(1)})


def test_texts_that_hold_each_other(spark):
    schema = "id long, page long, text string"
    rng = random.Random(3)
    made = lambda n: [(i, rng.randrange(3), "".join(rng.choice("ab-C") for _ in range(rng.randrange(0, 14)))) for i in range(n)]
    a, b = made(120) + [(120, None, "abab"), (121, 0, None)], made(8) + [(9, 0, None)]
    plain = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower())
    want = sorted(i for i, p, t in a if not any(p is not None and p == q and plain(t) and plain(u) and (plain(t) in plain(u) or plain(u) in plain(t)) for _, q, u in b))
    got = sorted(r["id"] for r in measure.unlike(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect())
    assert got == want and 5 < len(want) < 120


def test_upper_median_counts_repeated_and_null_values(spark):
    rows = [("x", v) for v in (5, 1, 1, 9)] + [("y", 3), ("y", None), ("z", None)]
    got = box_op.upper_median(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()
    assert {r["k"]: r["upper_median"] for r in got} == {"x": 5, "y": 3}


def test_locate_broadcasts_no_table(spark):
    from pii_lens.plans import registry

    plan = registry.row_locate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    items = spark.createDataFrame([(1, "a", "Asha Rao"), (1, "b", "nobody"), (2, "a", "Rao")], "page_id long, item string, text string")
    told = page(spark, ("ASHA", 0, 0, 40, 20), ("rao,", 50, 0, 30, 20), ("x", 0, 90, 9, 20), ("Rao", 5, 60, 30, 20), (None, 0, 0, 9, 9))
    got = sorted(tuple(r) for r in words.locate(told, items).select("page_id", "item", "left", "top", "width", "height").collect())
    assert got == [(1, "a", 0, 0, 80, 20), (1, "a", 5, 60, 30, 20)]
