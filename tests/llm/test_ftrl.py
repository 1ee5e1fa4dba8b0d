"""The quality classifier: updates against a plain version, features, held-out labels, odd cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trellis.llm import ftrl, registry

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, key long, y int, score string, label string"


def plain_tokens(text):
    out, last = [], 0
    for c in text:
        kind = 0 if c in " \t\n\x0b\x0c\r" else 1 if c.isascii() and c.isalnum() or not c.isascii() else 2
        if kind and kind == last:
            out[-1] += c
        elif kind:
            out.append(c)
        last = kind
    return out


def test_tokens_equal_a_plain_version():
    texts = ["Ab!! c\n\nd", "", "é$$x_y", " ", "a", "!", "x\ty||z 漢字?"]
    data, offsets = ftrl.text_bytes(pa.array(texts))
    starts, ends, first = ftrl.tokens(data, offsets)
    got = [[bytes(data[i:j]).decode() for i, j in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [plain_tokens(t) for t in texts]


def test_rows_equal_counts_of_grams():
    """Each gram has one bucket wherever it stands; values are scaled logarithms of counts."""
    texts = ["a b a b a", "", "!! x x x", None, "b a"]
    buckets, values, at = ftrl.rows_of(pa.array(texts), ftrl.FEATURES)

    def bucket(words):
        found, _, _ = ftrl.rows_of(pa.array([" ".join(words)]), ftrl.FEATURES)
        own = set(found.tolist())
        for w in words:
            if len(words) > 1:
                own -= {bucket([w])}
        return (own - {ftrl._EQUAL % ftrl.FEATURES}).pop()

    for i, text in enumerate(texts):
        t = plain_tokens(text or "")
        counts = Counter(bucket([w]) for w in t)
        pairs = list(zip(t[:-1], t[1:], strict=True))
        counts.update(bucket(list(p)) for p in pairs)
        counts.update(ftrl._EQUAL % ftrl.FEATURES for a, b in pairs if a == b)
        want = {k: 1 + math.log(c) for k, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in want.values()))
        got = dict(zip(buckets[at[i] : at[i + 1]].tolist(), values[at[i] : at[i + 1]].tolist(), strict=True))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k] / norm) < 1e-6 for k in want)


def plain_updates(rows, y, epochs):
    """One coordinate at a time, as the method is usually written."""
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == "b" else ftrl.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((ftrl.BETA + math.sqrt(n[i])) / ftrl.ALPHA + ftrl.L2)

    for _ in range(epochs):
        for row, label in zip(rows, y, strict=True):
            row = {**row, "b": 1.0}
            w = {i: weight(i) for i in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row.items())))
            for i, x in row.items():
                g = (p - label) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / ftrl.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_updates_equal_a_plain_version():
    rng = random.Random(4)
    rows = [{rng.randrange(30): rng.random() for _ in range(6)} for _ in range(60)]
    y = np.array([int(sum(r) % 2) for r in rows])
    sparse = [(np.array(list(r), np.int32), np.array(list(r.values()), np.float64)) for r in rows]
    w, b = ftrl.updates(sparse, y, 30, 3)
    want = plain_updates(rows, y, 3)
    assert np.allclose(w, [want.get(i, 0.0) for i in range(30)]) and math.isclose(b, want["b"])


def test_the_query_equals_a_plain_version(spark, tmp_path):
    """Whole query over a small table: the sample is all of it, in the order of the hashes."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(50)]
    rows, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        t = [rng.choice(words) + ("" if good else rng.choice(["!!", "##"])) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(t)))
        labels.append((i, int(good), 0))
    rows += [(5, rows[8][1]), (300, None), (301, ""), (None, "abc !!"), (7, rows[7][1])]
    labels += [(5, 0, 0), (6, None, 1), (999, 1, 0), (None, 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.op11_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    assert all(r.held_out == held(r.doc_id) for r in got)
    of = {}
    for i, q, _ in labels:
        if q is not None and i is not None:
            of[i] = max(of.get(i, 0), q)
    train = {((t or ""), of[i]) for i, t in rows if i in of and not held(i)}
    keys = {r.t: r.k for r in spark.createDataFrame([(t,) for t, _ in train], "t string").selectExpr("t", "xxhash64(t) AS k").collect()}
    mixed = lambda k: (np.int64(k) * np.int64(0x5851F42D4C957F2D)) ^ np.int64(k)
    with np.errstate(over="ignore"):
        train = sorted(train, key=lambda x: (mixed(keys[x[0]]), keys[x[0]], x[1]))
    b, v, at = ftrl.rows_of(pa.array([t for t, _ in train]), ftrl.FEATURES)
    sparse = [dict(zip(b[i:j].tolist(), v[i:j].tolist(), strict=True)) for i, j in zip(at[:-1], at[1:], strict=True)]
    weights = plain_updates(sparse, [y for _, y in train], ftrl.EPOCHS)
    b, v, at = ftrl.rows_of(pa.array([t for _, t in rows]), ftrl.FEATURES)
    dots = [sum(weights.get(k, 0.0) * x for k, x in zip(b[i:j].tolist(), v[i:j].tolist(), strict=True)) + weights["b"] for i, j in zip(at[:-1], at[1:], strict=True)]
    want = sorted((str(i), 1 / (1 + math.exp(-d))) for (i, _), d in zip(rows, dots, strict=True))
    found = sorted((str(r.doc_id), r.score) for r in got)
    assert [x[0] for x in found] == [x[0] for x in want] and np.allclose([x[1] for x in found], [x[1] for x in want], atol=1e-4)


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = registry.op11_quality_classifier(spark, DIR).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_odd_cases(spark):
    odd = [(0, None), (1, ""), (2, " \n"), (3, "x " * 200_000), (4, "!" * 100_000), (None, "a"), (1, "")]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "s", "l") for i, t in odd], DOCS)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, share in (([], 0.5), ([(3, 1), (4, 1)], 1.0), ([(3, None)], 0.5), ([(1, 0)], 0.0)):
        got = ftrl.score(docs, *ftrl.train_model(docs, labels(rows))).collect()
        assert len(got) == len(odd) and all(abs(r.score - share) < 0.01 for r in got)
    model = ftrl.train_model(docs, labels([(3, 1), (4, 0), (1, 0)]))
    got = {r.doc_id: r.score for r in ftrl.score(docs, *model).collect()}
    assert got[3] > 0.5 > got[4]
    assert ftrl.score(docs.limit(0), *model).count() == 0
    assert ftrl.train_model(docs.limit(0), labels([(3, 1)]))[1] == 0.0


@pytest.mark.parametrize("sample", [20, 4000])
def test_many_copies_do_not_fill_the_sample(spark, sample):
    copies = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 100 > 1 THEN 'the same clean text' WHEN id % 2 = 0 THEN concat('clean words ', id) ELSE concat('junk !! ', id, ' !!') END AS text")
    labels = copies.selectExpr("doc_id", "cast(text NOT LIKE '%!!%' AS int) AS quality")
    chosen, sizes = ftrl.picked(copies, labels, sample)
    rows = chosen.collect()
    assert sizes == {0: 200, 1: 19_800} and len(rows) == len({(r.key, r.y) for r in rows}) and len(rows) == min(sample, 401)
    got = {r.doc_id: r.score for r in ftrl.score(copies.where("doc_id < 4"), *ftrl.train_model(copies, labels, sample=sample)).collect()}
    assert got[1] < 0.5 < got[0] and got[2] > 0.5
