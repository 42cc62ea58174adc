"""Odd tables for every operator: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from kilnflow.llm import bpe, exact, language, licenses, mixing, neardup, pii, quality, shards, topk

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("Digest", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("a", T.StringType()),
        T.StructField("class_id", T.StringType()),
        T.StructField("times", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)
LONG = "word " * 60_000 + "x" * 50_000 + " 1" * 20_000


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), *["x"] * 1, 7, *["y"] * 6)


ROWS = [
    row(1, None),
    row(2, ""),
    row(3, " \n\t"),
    row(4, "one two three", source=None),
    row(5, "one two  three"),
    row(5, "one two  three"),
    row(6, "onetwothree", lang=None),
    row(None, "no id at all", lang=None, source=None),
    row(7, LONG),
    row(8, LONG),
    row(-9, "é日本 🎉 mixed TEXT, 123!", lang="fr", source="t"),
    row(2**62, "a@b.co +1 (168) 555-5254 10.0.0.1 card 4111 1111 1111 1111"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 0, 0), (2, 0, 0), (4, 1, 0), (5, None, 0), (None, 1, 0), (6, 1, 1), (7, 1, 0), (7, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_exact(odd, empty):
    out = exact.exact_dedup(odd).collect()
    assert len(out) == len(ROWS)
    of = {}
    for r in out:
        of.setdefault(r.doc_id, []).append(r)
    nothing = hashlib.sha256(b"").hexdigest()
    # White space only is the longest of the empty ones.
    assert {r.keep_id for i in (1, 2, 3) for r in of[i]} == {3}
    assert {r.text_sha256 for i in (1, 2, 3) for r in of[i]} == {nothing}
    assert {(r.keep_id, r.group_size) for i in (4, 5, 6) for r in of[i]} == {(5, 4)}
    assert sorted(r.kept for r in of[5]) == [False, True]
    assert [r.kept for r in of[None]] == [True]
    assert [r.keep_id for r in of[8]] == [7]
    assert exact.exact_dedup(empty).count() == 0


def test_exact_stage(odd, empty):
    out = exact.drop_copies(odd)
    assert out.columns == odd.columns
    kept = sorted((r.doc_id is None, r.doc_id) for r in out.collect())
    assert kept == [(False, i) for i in (-9, 3, 5, 7, 2**62)] + [(True, None)]
    assert exact.drop_copies(empty).count() == 0


def test_exact_keeps_across_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    later = spark.createDataFrame([(1, "ab"), (2, "new")], "doc_id long, text string")
    index = exact.open_index(spark, path, 4)
    assert {r.keep_id for r in exact.exact_dedup(first, index).collect()} == {5, 6}
    again = exact.open_index(spark, path, 4)
    decided = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_dedup(later, again).collect()}
    assert decided == {1: (5, False), 2: (2, True)}
    # A batch that is run again decides the same and adds nothing.
    decided = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_dedup(later, again).collect()}
    assert decided == {1: (5, False), 2: (2, True)}
    assert again.read().count() == 3


def test_exact_index_is_not_moved(spark, tmp_path):
    index = exact.open_index(spark, str(tmp_path / "index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    exact.exact_dedup(spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")), index)
    new = spark.range(9).select(exact.digest(F.col("id").cast("string")).alias("digest")).distinct()
    plan = new.join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    right = plan[plan.index("digest_index"):]
    assert "Exchange" not in plan[plan.index("SortMergeJoin"):].split("Scan")[-1] and "Bucketed: true" in right


def test_mixing(odd, empty):
    out = mixing.mixture(odd).collect()
    assert len(out) == len(ROWS)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    assert all(r.size == 0 for r in out if r.doc_id in (1, 2, 3))
    stage = mixing.mixed(odd)
    assert stage.columns == odd.columns
    times = {}
    for r in stage.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    rows = {}
    for r in out:
        rows[r.doc_id] = rows.get(r.doc_id, 0) + (r.taken // r.size if r.size else 0)
    assert times == {k: v for k, v in rows.items() if v}
    assert mixing.mixture(empty).count() == mixing.mixed(empty).count() == 0


def test_shards(odd, empty):
    out = shards.assign(odd, shards.planned(40), shards.planned(41)).collect()
    assert len(out) == len(ROWS)
    slots = {}
    for r in out:
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (1, 2)} == {(16, 0)}
    assert shards.assign(empty, shards.planned(40), shards.planned(41)).count() == 0


def test_pii(odd, empty):
    out = pii.personal_data(odd).collect()
    assert len(out) == len(ROWS)
    (found,) = [r for r in out if r.doc_id == 2**62]
    assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == (1, 1, 1, 0)
    assert found.spans.startswith("email:0:6,ip:")
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in out if r.doc_id in (1, 2, 3))
    assert pii.personal_data(empty).count() == 0


def test_licenses(odd, empty):
    assert licenses.licensed(odd).count() == licenses.licensed(empty).count() == 0
    assert licenses.licensed(odd, {}).count() == 0


def test_quality(odd, empty, labels):
    model = quality.train_outside(odd, labels)
    out = quality.scored(odd, model, "p")
    assert out.columns == [*odd.columns, "p"]
    assert all(0 <= r.p <= 1 for r in out.collect()) and out.count() == len(ROWS)
    assert quality.good(odd, labels).columns == odd.columns
    # Nothing to learn from: one score for all, above the threshold.
    none = quality.train(empty, labels.limit(0))
    assert {r.p for r in quality.scored(odd, none, "p").collect()} == {0.5}
    assert quality.good(empty, labels).count() == 0


def test_language(odd, empty):
    profiles = language.learn(odd)
    out = {r.doc_id: r for r in language.predicted(odd, profiles).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3))
    assert out[-9].lang_pred == "fr"
    assert language.predicted(odd, language.learn(empty)).filter("lang_pred <> 'und'").count() == 0
    assert language.predicted(empty, profiles).count() == 0


def test_tokens(odd, empty):

    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = {r.doc_id: r for r in bpe.digests(odd, path, P.PATTERN).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (out[1].n_tokens, out[1].ids_sha256, out[1].decoded_sha256) == (0, nothing, nothing)
    assert out[7].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.digests(empty, path, P.PATTERN).count() == 0
    back = bpe.decoded(bpe.encoded(odd, path, P.PATTERN), path, P.PATTERN)
    assert {(r.doc_id, bytes(r.bytes).decode()) for r in back.collect()} == {(r[0], r[1] or "") for r in ROWS}


def test_near(odd, empty):
    out = neardup.near_classes(odd).collect()
    assert len(out) == len(ROWS)
    of = {r.doc_id: r.class_id for r in out}
    assert of == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, None: None, 7: 7, 8: 7, -9: -9, 2**62: 2**62}
    stage = neardup.one_of_each(odd)
    assert stage.columns == odd.columns
    assert sorted(str(r.doc_id) for r in stage.collect()) == sorted(map(str, [1, 4, 6, None, 7, -9, 2**62]))
    assert neardup.near_classes(empty).count() == neardup.one_of_each(empty).count() == 0


def test_near_stage_keeps_one_of_repeated_rows(spark):
    rows = [row(1, "a b c d e f"), row(1, "a b c d e f"), row(2, "a b c d e f"), row(3, "other words here")]
    out = neardup.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_top_k(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]),
        (5, [nan, 1.0]), (6, [inf, 0.0]), (None, [9.0, 9.0]), (7, [0.25]), (8, []), (0, [1.0, 0.0]), (9, [-1.0, -1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit(1) for c in ("label", "pack", "score", "near", "v", "query_id")}
    )
    out = [tuple(r) for r in topk.top_k(table).orderBy("query_id", "rank").collect()]
    of_0 = sorted(r[1:] for r in out if r[0] == 0)
    # Two rows have id 0: each is a query, with its own ranks.
    assert of_0 == sorted(2 * [(1, 1, 65536), (2, 2, 65536), (3, 50, 32768), (4, 7, 16384), (5, 8, 0)])
    assert [r[2:] for r in out if r[0] == 50] == [(0, 32768), (0, 32768), (1, 32768), (2, 32768), (7, 8192)]
    assert topk.top_k(table.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, empty, labels, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        out = stage(spark, docs, str(tmp_path))
        assert name == "tokens" or out.columns == docs.columns
        assert out.count() <= 2 * len(ROWS)


def test_top_k_of_repeated_queries(spark):
    rows = [(0, [1.0]), (0, [1.0])] + [(i, [1.0 - i / 10]) for i in range(1, 6)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.rank, r.vec_id) for r in out) == sorted(2 * [(i, i) for i in range(1, 6)])


@pytest.mark.parametrize("pattern", [r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"])
def test_classes_of_every_code_point(pattern):
    """The vocabulary's library takes the same code points as letters, numbers and signs."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ranks = {bytes([i]): i for i in range(256)}
    seen = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)
    assert "".join(bpe.Splitter(pattern)(every)) == bytes(seen).decode()


def test_newer_letters_are_encoded_as_by_the_library(spark):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [int(r.split("-")[0], 16) for r in f"{bpe.NEWER_LETTERS} {bpe.NEWER_NUMBERS}".split()]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 !{chr(c)}?" for c in odd]
    out = bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in out.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
