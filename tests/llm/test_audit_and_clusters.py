"""The filter audit and the clustering on small and awkward tables, against brute force and their SQL."""

import hashlib
import re
from itertools import permutations

import numpy as np
import oracle
import pytest

from sluicegate.llm import filters, lloyd, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_relational_replay", "op13_plain_lloyd"])
def test_query_equals_sql(spark, name):
    assert oracle.differences(spark, oracle.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) is None


def fails(text, later):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": later}


def audit_by_hand(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    docs = [(s or "", fails(t, i is not None and i > first[t or ""]), i in good, i in toxic) for i, t, s in rows]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if d[1][letter]]
                missed = sum(d[1][letter] for d in own) - len(gone)
                alone = sum(d[1][letter] and sum(d[1].values()) == 1 for d in own)
                left = [d for d in left if not d[1][letter]]
                removed_by[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), missed, alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "Beta", "GAMMA", "de#ta", "x", "y", "z", "ü", " "] + [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 120))) for _ in range(60)] + [None, "", " \t\n", "word " * 30000]
    rows = [(int(i), texts[int(rng.integers(len(texts)))], [None, "", "s1", "s2"][int(rng.integers(4))]) for i in rng.permutation(300)]
    rows += rows[:5] + [(None, texts[0], "s1"), (None, None, None)] + [(i, "hot copy", "s2") for i in range(300, 400)]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(0, 500, 200)] + [(None, 1, 1), (7, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, id int, bits int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filters.audit(filters.flags(docs, marks)).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == audit_by_hand(rows, labels)
    assert len(got) == 3 * 600
    assert filters.audit(filters.flags(docs.limit(0), marks)).count() == 0


def lloyd_by_hand(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [e for _, e in start[:k]]
    place = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, e in kept:
            groups[place(e)[1]].append(e)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    return [(i, *place(e)[::-1], hashlib.sha256(",".join(map(str, centroids[place(e)[1]])).encode()).hexdigest()) for i, e in kept]


def test_lloyd_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 64))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.3 * rng.normal(size=64)]) for i in range(200)]
    rows += [(7, rows[3][1]), rows[4], (None, rows[5][1]), (300, None), (301, []), (302, [0.0] * 63), (303, [None] * 64), (304, [float("nan")] * 64), (305, [float("inf")] + [0.0] * 63), (306, [0.0] * 64)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, id int, cluster string").repartition(5)
    got = lloyd.cluster(table).collect()
    want = lloyd_by_hand(rows, 8, 10)
    assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    assert all(r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in got)
    assert lloyd.cluster(table.limit(0)).count() == 0
    assert lloyd.cluster(table.where("vec_id < 3")).count() == 3
    with pytest.raises(Exception, match="beyond"):
        lloyd.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).count()
