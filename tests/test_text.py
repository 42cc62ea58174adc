"""Text, vector and payload functions against plain Python and literal cases."""

import base64
import random
import re
import struct
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from kilnflow.functions import payload, text, vectors

ALPHABET = list("abcXYZ019 _-/!?.,;\t\n&<>") + [
    "é", "ñ", "東", "京", "²", "½", "Ⅷ", "٣", "́", " ", " ", "　", "\x1c", "\x85", "😀", "ß",
]


def samples():
    rng = random.Random(11)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 90))) for _ in range(400)]
    return made + ["", "!!!", "  Café — a/b_c-d 東京 x²!", "a" * 49 + "!!b"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(s,) for s in samples()], "s string")


def both(frame, column):
    return [(r[0], r[1]) for r in frame.select("s", column).collect()]


@pytest.mark.parametrize("n", [50, 30])
def test_slugify(frame, n):
    for s, got in both(frame, text.slugify("s", n)):
        kept = "".join(c for c in s[:n] if c.isalnum() or c in " -_").strip().replace(" ", "_")
        assert got == (kept or "generated_image")


def test_slugify_cases(spark):
    cases = {
        "  Café — a/b_c-d 東京 x²!": "Café__ab_c-d_東京_x²",
        "!!!": "generated_image",
        "": "generated_image",
        "a" * 49 + "!!b": "a" * 49,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in rows.select("s", text.slugify("s")).collect()} == cases


def test_strip(frame):
    assert all(got == s.strip() for s, got in both(frame, text.strip("s")))


def test_session_key(frame):
    for s, got in both(frame, text.session_key("s")):
        assert got == re.sub(r"[^\w\s-]", "", s or "generation").strip().replace(" ", "_")


def test_dated_key(spark):
    row = spark.range(1).select(
        text.session_key(F.lit("my study"), F.lit("2025-10-18").cast("date")),
        text.all_steps_key(F.lit("A Heron"), F.lit("2025-10-18").cast("date")),
    ).first()
    assert tuple(row) == ("my_study_20251018", "a_allsteps_20251018")


def test_token_count(frame):
    assert all(got == len(s.split()) for s, got in both(frame, text.token_count("s")))


def test_preview(frame):
    assert all(got == s[:50] + "..." for s, got in both(frame, text.prompt_preview("s")))


def test_escape(frame):
    for s, got in both(frame, text.escape_markup("s")):
        assert got == s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace(" ", "&nbsp;")


def test_normalize_base(spark):
    def expected(path):
        parts, seen, kept = PurePosixPath(path).parts, False, []
        for p in parts:
            if p == "outputs" and seen:
                continue
            seen = seen or p == "outputs"
            kept.append(p)
        cleaned = PurePosixPath(*kept)
        return "outputs" if cleaned.name == "outputs" else str(cleaned)

    paths = ["outputs/x/outputs", "/data/outputs", "out/y", "outputs", "", ".", "/", "//a/b", "///a",
             "a//b/./c/", "outputs/outputs", "outputs/a/outputs/b", "/outputs/outputs/x", "./outputs/"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0]: r[1] for r in rows.select("p", text.normalize_base("p")).collect()}
    assert got == {p: expected(p) for p in paths}


def test_labels_and_sizes(spark):
    row = spark.range(1).select(
        text.size_label(F.lit("1024x768")), text.seed_label(F.lit(0)), text.seed_label(F.lit(7)),
        text.seed_label(F.lit(None).cast("int")),
        text.parse_size(F.lit("64x32"))["width"], text.parse_size(F.lit("64xzz"))["height"],
        text.parse_size(F.lit("64"))["height"],
        text.step_of_total_name(F.lit(5), F.lit(1234)), text.steps_name(F.lit("a"), F.lit(123456), 4),
        text.session_path(F.lit("outputs"), F.lit("s"), F.lit("f.png"), F.lit("images")),
        text.session_path(F.lit("outputs"), F.lit("s"), F.lit("f.png"), F.lit("other")),
    ).first()
    assert list(row) == [
        "1024×768", "random", "7", "random", 64, None, None, "step_005_of_1234.png",
        "a_123456steps.png", "outputs/s/images/f.png", "outputs/s/f.png",
    ]


def test_vectors(spark):
    row = spark.createDataFrame(
        [([1.0, 2.0], [3.0, 6.0])], "u array<double>, t array<double>"
    ).select(
        vectors.guidance_blend("u", "t").alias("blend"),
        vectors.quantize_u8(F.array(F.lit(-2.0), F.lit(0.0), F.lit(2.0))).alias("levels"),
        vectors.quantize_u8(F.array(F.lit(2.0)), 4.0).alias("scaled"),
        vectors.split_pair(vectors.join_pair("u", "t")).alias("halves"),
        vectors.pixel_diff(F.array(*map(F.lit, [1, 2, 3, 4])), F.array(*map(F.lit, [1, 2, 3, 5]))).alias("one"),
        vectors.pixel_diff("u", "u").alias("same"),
        vectors.pixel_diff("u", F.array(F.lit(1.0))).alias("unequal"),
    ).first()
    assert row["blend"] == [16.0, 32.0]
    assert row["levels"] == [0, 128, 255] and row["scaled"] == [191]
    assert row["halves"]["first"] == [1.0, 2.0] and row["halves"]["second"] == [3.0, 6.0]
    assert tuple(row["one"]) == (25.0, False)
    assert tuple(row["same"]) == (0.0, True)
    assert tuple(row["unequal"]) == (None, False)


def test_payloads(spark):
    long = bytes(range(256)) * 3
    rows = spark.createDataFrame(
        [("data:image/png;base64,aGk=",), ("aGk=",), ("data:image/png;base64,aGk=,zz",), ("%%%",)], "p string"
    )
    got = [None if r[0] is None else bytes(r[0]) for r in rows.select(payload.decode_payload("p")).collect()]
    assert got == [b"hi", b"hi", b"hi", None]
    one = spark.createDataFrame([(bytearray(long),)], "c binary")
    assert one.select(payload.encode_payload("c")).first()[0] == base64.b64encode(long).decode()


def test_png_header(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 1024, 70000) + b"\x08\x02"
    rows = spark.createDataFrame([(bytearray(png),), (bytearray(b"\xff\xd8" + png),), (bytearray(b""),)], "c binary")
    got = [tuple(r[0]) for r in rows.select(payload.image_size("c")).collect()]
    assert got == [(1024, 70000), (None, None), (None, None)]
