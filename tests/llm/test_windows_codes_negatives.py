"""Hard negatives, vector codes and chat windows against brute force, and on odd tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnflow.llm import chat, codes, negatives

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, embedding array<float>, label int, `at` string, Score string, codes string, slot int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, n, "x", "y", "z", 1) for i, v, n in rows], VECTORS).repartition(3)


def whole(vector):
    return [int(np.floor(np.float64(np.float32(x)) * 256)) for x in vector]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]


def negatives_by_force(rows):
    kept = [(i, (n + 1) % 10 if i % 7 == 0 else n, whole(v)) for i, v, n in usable(rows) if i is not None and n is not None]
    out = Counter()
    for i, n, v in kept:
        if i % negatives.EVERY:
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), j, m) for j, m, w in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == n][: negatives.POSITIVES]:
            fit = [(a, k) for a, k, m in scored if m != n and 50 * s >= 100 * a >= 95 * s]
            for rank, (a, k) in enumerate(fit[: negatives.NEGATIVES], 1):
                out[(i, j, rank, k, -s, -a)] += 1
    return out


def clustered(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 10))
        v = (centres[label % 5] + rng.normal(size=width) * 0.7) * scale * rng.uniform(0.5, 2)
        rows.append((i, v.astype(np.float32).tolist(), label))
    return rows


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 40)
    monkeypatch.setattr(negatives, "TILE", 3)
    rows = clustered(700, 8, 1)
    # A vector that a third of the rows share, ties, and repeated ids.
    rows += [(1000 + i, [0.5] * 8, i % 10) for i in range(300)]
    rows += [(50, rows[50][1], rows[50][2]), (100, rows[7][1], 3), (3, rows[3][1], rows[3][2])]
    out = Counter(tuple(r) for r in negatives.hard_negatives(table_of(spark, rows)).collect())
    assert out == negatives_by_force(rows) and len(out) > 100


def test_hard_negatives_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (50, [0.0, 0.0], 1), (100, [-1.0, 0.5, 0.25], 2), (1, [1.0, 0.1], 1), (2, [0.8, 0.1], 2),
        (3, None, 1), (4, [None, 1.0], 1), (5, [NAN, 1.0], 1), (6, [INF, 1.0], 2), (8, [0.7], None), (9, [0.7], 2),
        (None, [1.0, 0.0], 1), (7, [0.9, 0.0], 0), (14, [0.6, 0.0], 9), (10, [], 1), (11, [0.75, 0.0], 3), (11, [0.75, 0.0], 3),
        (-50, [0.5, 0.5], -3),
    ]
    out = Counter(tuple(r) for r in negatives.hard_negatives(table_of(spark, rows)).collect())
    assert out == negatives_by_force(rows) and out
    assert negatives.hard_negatives(table_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("width,low", [(2, 0.9), (16, 0.3), (64, 0.1)])
def test_no_candidate_is_lost(width, low):
    rng = np.random.default_rng(width)
    rows = rng.integers(-90, 90, (500, width))
    rows[:5] = 0
    bucket = negatives.Bucket(np.arange(500), np.zeros(500, np.int64), rows, np.empty(0))
    asked = np.concatenate([rows[::9], np.zeros((1, width), np.int64)])
    lengths = np.linalg.norm(asked.astype(float), axis=1)
    need = low * lengths * bucket.longest + rng.normal(size=len(asked))
    got = np.zeros((len(asked), 500), bool)
    for some, found in bucket.candidates(asked, lengths, need):
        got[np.ix_(some, found)] = True
    assert got[asked @ rows.T >= need[:, None]].all()
    assert width > 2 or got.mean() < 0.5


def codes_by_force(rows):
    kept = usable(rows)
    width = -(-max(len(v) for _, v, _ in kept) // codes.PARTS) * codes.PARTS
    data = np.array([whole(v) + [0] * (width - len(v)) for _, v, _ in kept], object)
    w = width // codes.PARTS
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, list(kept[i][1])))
    parts = data.reshape(len(kept), codes.PARTS, w)
    books = parts[order[: codes.ENTRIES]].transpose(1, 0, 2).copy()

    def assign():
        d = ((parts[:, :, None, :] - books[None]) ** 2).sum(3)
        best = np.array([[min(range(len(x)), key=lambda e: (x[e], e)) for x in row] for row in d])
        return best, np.array([[d[i, p, best[i, p]] for p in range(codes.PARTS)] for i in range(len(kept))], object)

    for _ in range(codes.ROUNDS):
        best, _ = assign()
        for p in range(codes.PARTS):
            for e in set(best[:, p]):
                mine = parts[best[:, p] == e, p]
                books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    best, far = assign()
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    total = defaultdict(int)
    for (_, _, n), f in zip(kept, far):
        total[n] += int(f.sum())
    return Counter(
        (i, "".join(f"{c:02x}" for c in b), int(f.sum()), total[n], digest) for (i, _, n), b, f in zip(kept, best, far)
    )


@pytest.mark.parametrize("few_labels", [True, False])
def test_codes_against_brute_force(spark, monkeypatch, few_labels):
    monkeypatch.setattr(codes, "FEW_LABELS", 100 if few_labels else 1)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 32) / 8 + rng.integers(0, 2)).tolist(), i % 4) for i in range(150)]
    rows += [(500 + i, [0.25] * 32, None) for i in range(60)]
    out = Counter(tuple(r) for r in codes.coded_vectors(table_of(spark, rows)).collect())
    assert out == codes_by_force(rows)


def test_codes_of_odd_rows(spark):
    rows = [
        (3, [0.5] * 20, 1), (3, [0.25] * 20, 1), (1, [], None), (None, [0.75] * 17, None), (2, None, 1), (4, [NAN] * 16, 1),
        (5, [None] * 16, 1), (6, [1e30] * 16, 2), (6, [1e30] * 16, 2), (7, [-0.001] * 3, 5),
    ]
    data = table_of(spark, rows)
    out = codes.coded_vectors(data)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    clipped = [(i, None if v is None else [None if x is None else min(x, 2.0**44) for x in v], n) for i, v, n in rows]
    assert Counter(tuple(r) for r in out.collect()) == codes_by_force(clipped)
    assert codes.coded_vectors(data.limit(0)).count() == 0
    one = codes.coded_vectors(data.filter("vec_id = 7")).collect()
    assert [(r.code, r.error) for r in one] == [("00" * 16, 0)]


def test_trie_shares_prefixes_of_any_shape(monkeypatch):
    monkeypatch.setattr(codes, "LEAVES", 8)
    rng = np.random.default_rng(0)
    for n, width, values in ((1, 4, 3), (400, 4, 2), (900, 3, 9), (300, 1, 50), (200, 5, 2**40)):
        rows, entries = (rng.integers(-values, values + 1, (m, width)) for m in (n, 7))
        trie = codes.Trie(rows)
        best, far = trie.nearest(entries)
        d = ((rows.astype(object)[:, None] - entries.astype(object)) ** 2).sum(2)
        assert (best[trie.of] == d.argmin(1)).all() and (far[trie.of] == d.min(1)).all()
        sums = np.zeros((7, width), object)
        np.add.at(sums, best[trie.of], rows.astype(object))
        assert (trie.sums(best, 7) == sums).all()


TURNS = "conv_id long, turn long, role string, text string, part string, `window` int, Kind string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b") for r in rows], TURNS).repartition(3)


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(x for role, x in turns if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for role, x in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


HARD = ["", "\n", "\\", "\\\\</turn>", "</turn>\n<turn role=\"assistant\">\n", "\n</turn>\n", "<turn", "\\<turn x\\", "é 日本 🎉 </turn>\\"]

ODD = [
    *[(1, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(HARD)],
    (2, 0, "system", "be kind"), (2, 1, "user", "word " * 3000), (2, 2, "assistant", "</turn> " * 800), (2, 3, "user", "ok"),
    (3, 0, None, None), (3, None, 'a"\\\n</turn>', "before all"), (3, 1, "assistant", None), (3, 1, "assistant", "x"),
    (3, 1, "assistant", "x"), (None, 0, "user", "no id"), (None, 0, "assistant", "none"), (4, 5, "assistant", "late"),
    (4, 6, "system", "late rules"), (4, 7, "assistant", "again"), (-7, 0, "user", chat.PROBE[1]),
    *[(9, i, ("user", "assistant", "system")[i % 3], f"turn {i} " + "w " * (i % 11)) for i in range(120)],
]


@pytest.mark.parametrize("rows_per_part", [None, 6])
def test_chat_windows_read_back(spark, rows_per_part):
    data = conversations(spark, ODD)
    if rows_per_part:
        spark.conf.set("spark.kilnflow.rowsPerChunk", rows_per_part)
    try:
        made = chat.windows(data, budget=60, history=16).cache()
        out = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made).collect()}
        rows = made.orderBy("conv_id", "part", "window").collect()
    finally:
        spark.conf.unset("spark.kilnflow.rowsPerChunk")
    assert out == expected(ODD)
    assert rows_per_part is None or max(r.part for r in rows) > 2
    said, system = defaultdict(list), {}
    for r in rows:
        context = list(chat.turns_in(r.text[: r.fresh_from]))
        own = list(chat.turns_in(r.text, r.fresh_from))
        assert r.tokens == sum(chat.token_count(x) for _, x in context + own)
        assert r.tokens <= 60 or len(own) == 1
        # What is repeated is the system turn, then turns right before these; the mask is on none of it.
        if r.conv_id in system:
            assert context[0] == system[r.conv_id]
            context = context[1:]
        before = [t for t in said[r.conv_id] if t != system.get(r.conv_id)]
        assert before[len(before) - len(context) :] == context
        assert sum(chat.token_count(x) for _, x in context) <= 16
        assert all(t["start"] > r.fresh_from for t in r.targets)
        texts = [chat.unescaped(r.text[t["start"] : t["end"]]) for t in r.targets]
        assert texts == [x for role, x in own if role == "assistant"]
        said[r.conv_id] += own
        first = next((t for t in said[r.conv_id] if t[0] == "system"), None)
        if first:
            system[r.conv_id] = first
    assert any(r.fresh_from for r in rows)


def test_chat_windows_of_nothing(spark):
    empty = conversations(spark, ODD).limit(0)
    assert chat.windows(empty).count() == chat.read_back(chat.windows(empty)).count() == 0


@pytest.mark.parametrize("text", HARD)
def test_escapes_are_reversible(text):
    assert chat.unescaped(chat.escaped(text)) == text
    assert "\n</turn>\n" not in "\n" + chat.escaped(text)


def test_chat_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.PROBE[1]), (-7, 1, "assistant", chat.PROBE[1])]
    out = chat.op13_chat_windows(spark, data)
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {r.conv_id: tuple(r)[1:5] for r in out.collect()} == expected(rows)
    assert out.filter(F.col("formatted_chars") <= 0).count() == 0
