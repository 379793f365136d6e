"""Whitening, Merkle manifest and decontamination against brute force, and their defined results in odd cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostlight.llm import decontaminate, fm_index, merkle, whitening
from hostlight.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op12_merkle_slot_pivot", "op13_fm_index_decontamination"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name]).df().sort_values("doc_id", ignore_index=True)
    got = QUERIES[name](spark, SF).toPandas().sort_values("doc_id", ignore_index=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


# -- whitening -------------------------------------------------------------------------------------------------


def whitened_by_hand(vectors, weights="counts", components=32):
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in vectors]
    fit = x if weights == "counts" else [list(t) for t in dict.fromkeys(map(tuple, x))]
    n, d = len(fit), len(x[0])
    s = [sum(r[i] for r in fit) for i in range(d)]
    off = [[Fraction(r[i] * n - s[i], n) for i in range(d)] for r in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in off) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    y = np.array([[float(Fraction(r[i] * n - s[i], n)) for i in range(d)] for r in x]) @ u / np.sqrt(e)
    return n, [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x], y, e / np.trace(v)


@pytest.mark.parametrize("weights", ["counts", "one"])
@pytest.mark.parametrize("hot", [False, True])
def test_whitening_by_hand(spark, weights, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(whitening, "HOT_ROWS", 3)
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(60, 5)) * [3, 2, 1, 0.5, 0.3]).round(3)
    vectors = np.concatenate([vectors, vectors[:20], np.repeat(vectors[:1], 15, axis=0)])
    df = spark.createDataFrame([(k, [float(c) for c in v], "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(df, weights=weights).toPandas().sort_values("vec_id", ignore_index=True)
    n, deviation, y, explained = whitened_by_hand(vectors, weights)
    assert got["n"].unique().tolist() == [n] and got["deviation"].tolist() == deviation
    white = np.array(got["white"].tolist())
    sign = np.sign((white * y).sum(axis=0))
    np.testing.assert_allclose(white * sign, y, atol=1e-9)
    np.testing.assert_allclose(got["explained"][0], explained, rtol=1e-9)
    assert got["identity_error"].max() < 1e-9


def test_whitening_of_the_given_vectors(spark):
    got = QUERIES["op11_whitening_multiplicity"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, y, explained = whitened_by_hand(rows["embedding"].tolist())
    white = got["whitened"].to_numpy().reshape(len(rows), 32)
    np.testing.assert_allclose(white * np.sign((white * y).sum(axis=0)), y, atol=1e-6)
    assert got["deviation"].to_numpy().reshape(len(rows), 32)[:, 0].tolist() == deviation
    np.testing.assert_allclose(got["explained"].to_numpy()[:32], explained, rtol=1e-9)
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [3.0, 0.5], None), (2, None, "b"), (3, [], "b"), (4, [nan, 1.0], "b"), (5, [inf, 1.0], "b"), (6, [None, 1.0], "b"), (7, [1e300, 1.0], "b"), (8, [1.0], "b"), (9, [-7.0, 2.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, white string")
    got = whitening.whiten(df).toPandas()
    assert sorted(got["vec_id"].fillna(-1)) == [-1, 1, 1, 9] and set(got["n"]) == {4}
    assert got["identity_error"].max() < 1e-9
    assert whitening.whiten(df.filter("vec_id = 2")).collect() == [] and whitening.whiten(df.limit(0)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(k, [2.0, float(k % 2)]) for k in range(6)], "vec_id long, embedding array<float>")).toPandas()
    assert all(abs(abs(w[0]) - 1) < 1e-12 and w[1] == 0 for w in flat["white"]) and flat["identity_error"].max() < 1e-12
    same = whitening.whiten(spark.createDataFrame([(k, [2.0, 1.0]) for k in range(3)], "vec_id long, embedding array<float>")).toPandas()
    assert all(list(w) == [0, 0] for w in same["white"]) and same["deviation"].tolist() == [0, 0, 0]


def test_deviation_beyond_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).toPandas().sort_values("vec_id")
    assert got["deviation"].isna().tolist() == [True, True, False]
    np.testing.assert_allclose([abs(w[0]) for w in got["white"]], [1.5**0.5, 1.5**0.5, 0], atol=1e-9)


# -- manifest --------------------------------------------------------------------------------------------------


def tree_by_hand(leaves, fanout):
    """Levels of digests, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[k : k + fanout])) for k in range(0, len(now), fanout)])
    return levels


def way(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        run = at - at % fanout
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        at //= fanout
    return out


def manifest_by_hand(rows, fanout=2):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(part(v) for v in (r[0], r[3], r[2], r[4], r[1])))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (ordered := sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), tree_by_hand([leaf(r) for r in ordered], fanout)) for g in names}
    top = tree_by_hand([trees[g][1][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        ordered, levels = trees[g]
        for at, r in enumerate(ordered):
            path = way(levels, at, fanout) + way(top, k, fanout)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4] + 1) if changed else r)
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], path, node, node == top[-1][0]))
    return out


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], str(r[4])))


@pytest.mark.parametrize(("fanout", "height"), [(2, 10), (2, 2), (3, 2), (4, 1)])
def test_manifest_by_hand(spark, fanout, height):
    rng = random.Random(fanout)
    rows = [(k * 3, rng.choice(["", None, "é\n🙂", "word " * k]), rng.choice(["en", "de", None, "é", ""]), rng.choice(["src1", None]), rng.choice([None, k])) for k in range(120)]
    rows += [(5, "alone", "zz", None, 1), (None, "no key", "en", "s", 2), (None, "no key too", "en", "s", 2), rows[7], rows[7]]
    df = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "'x' AS grp", "'x' AS idx", "'x' AS node", "'x' AS slot_0").repartition(5)
    got = merkle.manifest(df, tampered=merkle.one_more, fanout=fanout, height=height).collect()
    plain = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["path"]], r["folded_root"], r["verified"]) for r in got]
    assert sorted_rows(plain) == sorted_rows(manifest_by_hand(rows, fanout))
    assert 0 < sum(r["verified"] for r in got) < len(rows)


def test_manifest_of_nothing_one_row_and_one_group(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    assert merkle.manifest(none).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "a", None, None, None)], DOCUMENTS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["path"] == [] and one["leaf"] == sha("1:1---1:a")
    rows = [(k, "t", "en", "s", 1) for k in range(5)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert {r["root"] for r in got} == {r["subroot"] for r in got} and all(r["verified"] for r in got)


# -- decontamination -------------------------------------------------------------------------------------------


def test_fm_index_by_hand():
    rng = np.random.default_rng(1)
    for largest, n in ((1, 40), (3, 400), (70, 900), (5000, 3000)):
        symbols = np.concatenate([rng.integers(0, largest + 1, n), [0]])
        symbols[50:90] = symbols[:40] if n > 100 else symbols[50:90]
        if n > 300:
            symbols[200:260] = 1
        index = fm_index.FmIndex(symbols, largest)
        phrases = np.full((60, 6), -1, np.int64)
        for p in phrases:
            k, at = int(rng.integers(1, 7)), int(rng.integers(0, n - 6))
            p[6 - k :] = np.where(symbols[at : at + k] > 0, symbols[at : at + k], 1)
        low, high = index.ranges(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            p = p[p >= 0]
            want = [i for i in range(len(symbols) - len(p) + 1) if (symbols[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order_ends_at_separators():
    symbols = np.array([2, 1, 1, 1, 0, 1, 1, 1, 0, 2, 1, 0])
    order = fm_index.suffix_order(symbols, 2).tolist()
    until = lambda i: symbols[i : i + symbols[i:].tolist().index(0)].tolist()
    assert order == sorted(range(len(symbols)), key=lambda i: (until(i), i))


def contaminated_by_hand(docs, items, length=10):
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    owners = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - length + 1) if w else 0):
            owners.setdefault(tuple(w[k : k + length]), set()).add(i or "")
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in owners}:
            for at in range(len(w) - n + 1):
                if (p := tuple(w[at : at + n])) in owners:
                    hit |= {*range(at, at + n)}
                    found |= owners[p]
        out.append((k, len(w), sorted(hit), sorted(found)))
    return out


@pytest.mark.parametrize(("block", "shard"), [(100_000, 6 << 20), (7, 6 << 20), (100_000, 500)])
def test_decontamination_by_hand(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 50)
    rng = random.Random(9)
    some = lambda n: [rng.choice(["the", "An", "of", "Été", "x1", "zwölf", "🙂b", "run"]) for _ in range(n)]
    items = [(f"i{k}", " ".join(some(rng.randint(3, 25)))) for k in range(20)] + [("i3", "another text of this item"), (None, "no id, yet ten words or more of them in it here"), ("e", ""), ("n", None), ("p", "...")]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(some(rng.randint(0, 60)))) for k in range(60)]
    docs += [(100 + k, "Before. " + t.upper() + " -- after " + " ".join(some(5))) for k, (_, t) in enumerate(items[:6])]
    docs += [(200, None), (201, ""), (202, "?!"), (203, items[0][1] + " " + items[0][1]), (None, items[1][1]), (100, docs[-1][1]), (0, docs[0][1]), (300, "the " * 3000 + items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "'x' AS spans", "'x' AS same", "'x' AS key")
    b = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "'x' AS doc_id", "'x' AS words")
    got = decontaminate.located(d, b, block=block).collect()
    plain = [(r["doc_id"], r["n_words"], [k for s in r["spans"] for k in range(s["first"], s["last"] + 1)], r["items"]) for r in got]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(plain, key=order) == sorted(contaminated_by_hand(docs, items), key=order)


def test_decontamination_of_nothing_and_by_nothing(spark):
    d = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([("a", "some words")], "item_id string, text string")
    assert decontaminate.located(d.limit(0), b).collect() == []
    assert [(r["n_words"], r["spans"], r["items"]) for r in decontaminate.located(d, b.limit(0)).orderBy("doc_id").collect()] == [(2, [], []), (0, [], [])]


def test_cleaned_cuts_the_spans(spark):
    d = spark.createDataFrame([(1, "Öl. One two THREE, four! end", "a"), (2, "one two three", "b"), (3, None, "c"), (None, "x one two three four", "d")], "doc_id long, text string, hit_spans string")
    b = spark.createDataFrame([("a", "one two three four")], "item_id string, text string")
    got = decontaminate.cleaned(d, b)
    assert got.columns == d.columns
    assert {(r["doc_id"], r["text"], r["hit_spans"]) for r in got.collect()} == {(1, "Öl. ! end", "a"), (2, "one two three", "b"), (3, None, "c"), (None, "x ", "d")}


def test_production_windows(spark):
    rows = decontaminate.windows(spark.createDataFrame([(1, "A b c"), (2, " ".join(map(str, range(12))))], "item_id int, text string")).collect()
    assert sorted(len(r["words"]) for r in rows) == [3, 10, 10, 10]
    assert decontaminate.windows(spark.createDataFrame([(1, "")], "item_id int, text string")).select(F.count("*")).first()[0] == 0
