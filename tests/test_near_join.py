"""Pruned self-join of vectors: no pair lost, far fewer compared, hot cells and owners, malformed vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicegate.functions import text as T
from sluicegate.operators import near_join as N
from sluicegate.operators import vector_checks as V


def clustered(rng, n, clusters=12, d=16, noise=0.05):
    centres = rng.normal(size=(clusters, d))
    x = centres[rng.integers(clusters, size=n)] + noise * rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # copies: a third of all rows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, u, owners):
    rows = [(i, v.tolist(), None if o < 0 else f"o{o}") for i, (v, o) in enumerate(zip(u, owners, strict=True))]
    return spark.createDataFrame(rows, "ordinal long, u array<double>, owner string").repartition(5)


@pytest.mark.parametrize("cross_owner", [False, True])
@pytest.mark.parametrize(("threshold", "block"), [(0.97, 40), (0.6, 64), (-0.5, 90), (0.97, 4096)])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, block, cross_owner):
    monkeypatch.setattr(N, "CELL_ROWS", 16)
    rng = np.random.default_rng(3)
    u = clustered(rng, 300)
    owners = np.where(rng.random(300) < 0.5, 0, rng.integers(-1, 9, 300))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T > threshold, 1)), strict=True) if not cross_owner or owners[i] != owners[j]}
    got = N.near_pairs(frame(spark, u, owners), threshold, cross_owner, block).collect()
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want
    assert all(abs(r.cosine - u[r.i] @ u[r.j]) < 1e-12 or r.cosine in (1.0, -1.0) for r in got)


def test_far_fewer_pairs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 32)
    rng = np.random.default_rng(4)
    n = 2000
    centres = rng.normal(size=(40, 16))
    u = centres[np.arange(n) % 40] + 0.03 * rng.normal(size=(n, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    table = frame(spark, u, np.arange(n) % 40)
    want = int((np.triu(u @ u.T > 0.95, 1)).sum())
    assert N.near_pairs(table, 0.95, block_rows=128).count() == want
    every = n * (n - 1) // 2
    assert want <= N.near_pairs(table, 0.95, block_rows=128, tally=True).first().compared < every / 8
    # each cluster has one owner, so nearly no pair is left to compare
    assert N.near_pairs(table, 0.95, True, 128, tally=True).first().compared < every / 50
    one = frame(spark, u, np.zeros(n, int))
    assert N.near_pairs(one, 0.95, True, 128, tally=True).first().compared == 0


def test_units_are_bounded_and_whole():
    rng = np.random.default_rng(5)
    rings = [(c, r, int(rng.integers(1, 500)), r / 50, r / 50 + 0.01, 1, 2) for c in range(5) for r in range(3, 40)]
    units = N.Units.of(rings, 5, 100)
    for c, r, n, low, high, *_ in rings:
        ids = np.arange(n)
        at = units.home(np.full(n, c), np.full(n, (r + 0.5) * np.pi / N.RINGS), ids)
        assert set(units.cell[at]) == {c} and len(set(at)) <= -(-n // 75)
        assert (units.low[at] <= low).all() and (units.high[at] >= high).all()
    assert len(units.bundle) == len(units.cell) and (np.diff(units.bundle) >= 0).all()


def test_a_row_is_sent_to_a_bundle_once():
    """Where bounds prune nothing, copies grow with bundles, not with units."""
    rng = np.random.default_rng(6)
    rings = [(c, r, 30, r * np.pi / N.RINGS, (r + 1) * np.pi / N.RINGS, 1, 2) for c in range(40) for r in (60, 64, 68)]
    units = N.Units.of(rings, 40, 40, 900)
    assert len(units.cell) == 120 and len(set(units.bundle)) == 4
    angle = rng.uniform(1.4, 1.7, (50, 40))
    unit = rng.integers(120, size=50)
    args = angle.min(1), np.zeros(50, int), unit, 1.1, False
    near = units.admits(slice(0, 120), angle[:, units.cell], *args)
    reach = units.reached(angle, *args)
    assert (near.sum(1) == unit).all() and (reach.sum(1) == units.bundle[unit]).all()


@pytest.mark.parametrize("block_chars", [40, 1 << 20])
def test_lexical_similarity_in_blocks(spark, block_chars):
    texts = ["", None, "Hi", "hi", "ab", "!!! ???", "one two  three", "One two four", "Straße im März", "strasse im märz", "\U0001f600 ok \U0001f600", "ok ok", "a_b c-d ٣"]
    rows = spark.createDataFrame(list(enumerate(texts)), "ordinal long, text string")
    pairs = spark.createDataFrame([(i, j, 0.5) for i in range(len(texts)) for j in range(i + 1, len(texts))], "i long, j long, cosine double")
    form = T.lexical_form(F.col("text"))
    side = lambda s: rows.select(F.col("ordinal").alias(s), form.alias(f"f{s}"), T.words(form).alias(f"w{s}"), T.trigrams(form).alias(f"g{s}"))
    want = pairs.join(side("i"), "i").join(side("j"), "j").select("i", "j", T.lexical_similarity(*map(F.col, ("fi", "wi", "gi", "fj", "wj", "gj"))).alias("lexical"))
    got = V.with_lexical(pairs, rows, block_chars)
    assert sorted((r.i, r.j, r.lexical) for r in got.collect()) == sorted((r.i, r.j, r.lexical) for r in want.collect())
    long = spark.createDataFrame([(0, "x" * 25_000), (1, "x" * 20_000 + "y")], "ordinal long, text string")
    assert V.with_lexical(pairs.where("j = 1"), long, block_chars).first().lexical == 1.0  # of 20,000 characters
    shuffles = got._jdf.queryExecution().optimizedPlan().toString()
    assert shuffles.count("FlatMapCoGroupsInArrow") == 1 and "Join" not in shuffles  # pairs carry no text


def vectors(spark, *rows):
    return spark.createDataFrame(rows, "ordinal long, text string, embedding array<double>, owner string")


@pytest.mark.parametrize("part", [1, 3, 8192])
def test_packed_features_are_sent_not_texts(spark, monkeypatch, part):
    """Blocks hold less than half of their texts' characters, are unpacked in parts, and give what each pair gives by itself."""
    kept = []
    monkeypatch.setattr(V, "cut", lambda df, cut=V.cut: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(V, "UNPACKED", part)
    texts = [" ".join(f"word{(7 * k + 11 * w * (1 + k % 3)) % 97} ünd {w % 5}" for w in range(300)) for k in range(10)] + ["", "a", "ab", "ab "]
    rows = spark.createDataFrame(list(enumerate(texts)), "ordinal long, text string")
    pairs = spark.createDataFrame([(i, j, 0.5) for i in range(len(texts)) for j in range(i + 1, len(texts))], "i long, j long, cosine double")
    got = {(r.i, r.j): (r.cosine, r.lexical) for r in V.with_lexical(pairs, rows, 4000, text_chars=None).collect()}
    form = lambda x: " ".join(x.lower().split())
    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    grams = lambda x: {x[k : k + 3] for k in range(len(x) - 2)}
    for i, x in enumerate(map(form, texts)):
        for j, y in list(enumerate(map(form, texts)))[i + 1 :]:
            assert got.pop((i, j)) == (0.5, 1.0 if x == y else max(jaccard(set(x.split()), set(y.split())), jaccard(grams(x), grams(y))))
    assert not got
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in kept[-1].dtypes if t in ("string", "binary")]
    assert 0 < kept[-1].select(F.sum(sum(sizes, F.lit(0)))).first()[0] < sum(map(len, texts)) / 2


def test_whole_texts_are_compared(spark):
    """Texts that differ only after their first 20,000 characters."""
    rows = vectors(spark, (0, "same " * 5000, [1.0, 0.0], "x"), (1, "same " * 4000 + "other words alone " * 300, [1.0, 0.0], "y"), (2, "same " * 9000, [0.0, 1.0], "y"))
    found = V.consistency(rows).collect()
    assert [(r.i, r.j, r.lexical) for r in found] == [(0, 1, 0.25)]
    assert [r.evidence for r in V.pair_findings(rows).collect()] == ["cos_sim=1.0000, text_sim=0.2500"]
    assert V.consistency(rows, text_chars=20_000).count() == 0


def test_malformed_vectors_raise_or_are_skipped(spark):
    good = (0, "a", [1.0, 0.0], "x")
    for bad in ([], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]):
        rows = vectors(spark, good, (7, "b", bad, "y"))
        with pytest.raises(Exception, match="ordinal 7"):
            V.near_pairs(V.prepared(rows)).collect()
        assert V.prepared(rows, V.SKIP).count() == 1
    with pytest.raises(ValueError, match="dimensions must match"):
        V.near_pairs(V.prepared(vectors(spark, good, (1, "b", [1.0, 0.0, 0.0], "y"))), 0.5).collect()
    with pytest.raises(ValueError, match="threshold"):
        V.near_pairs(V.prepared(vectors(spark, good)), 1.1)
    none = vectors(spark, (0, "a", None, "x"), (1, "b", None, "y"))
    assert V.near_pairs(V.prepared(none)).count() == 0 and V.near_pairs(V.prepared(none.limit(0))).count() == 0


def test_fidelity_raises_with_the_row(spark):
    table = lambda fresh: spark.createDataFrame([(0, "a", [1.0, 0.0], [1.0, 0.0]), (1, "b", [0.0, 1.0], fresh), (2, "c", None, None)], "ordinal long, text string, embedding array<double>, fresh array<double>")
    assert V.fidelity(table([0.0, 2.0])).count() == 0
    assert [r.ordinal for r in V.fidelity(table([1.0, 0.0])).collect()] == [1]
    for bad, what in (([0.0, 1.0, 0.0], "dimensions"), ([float("nan"), 0.0], "fresh"), ([0.0, 0.0], "fresh"), ([], "fresh"), (None, "no fresh")):
        with pytest.raises(Exception, match=f"ordinal 1.*{what}|fresh embedding at ordinal 1"):
            V.fidelity(table(bad)).collect()


def test_budgets(spark):
    rows = vectors(spark, *((i, t, [1.0, 0.0], "xyx"[i]) for i, t in enumerate(("alpha", "beta", "gamma"))), (3, "none", None, "x"))
    assert V.pair_findings(rows, max_findings=3, max_comparisons=3, max_documents=4).count() == 3
    for budget in ({"max_findings": 2}, {"max_comparisons": 2}, {"max_documents": 3}):
        with pytest.raises(ValueError, match=f"{[*budget][0]} exceeded"):
            V.pair_findings(rows, **budget)
    assert V.pair_findings(rows, cross_owner=True, max_comparisons=2, max_findings=2).count() == 2
    with pytest.raises(ValueError, match="positive integer"):
        V.pair_findings(rows, max_findings=0)
