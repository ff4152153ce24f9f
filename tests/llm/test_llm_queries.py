"""Every registered query of the training-data operators on the smallest tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quorate.llm import consensus, registry

SF = "/root/testdata/sf0.001"
FOUND = {"p1_found": {"kind", "item"}, "p2_found": {"sample_name", "category"}, "p3_found": {"message_id_a", "message_id_b"}, "p4_found": {"feature_id", "cluster_key"}, "p5_found": {"flip_id", "defect"}, "p6_found": {"table_name", "record_key"}, "p7_found": {"table_name", "record_key"}, "p9_found": {"source"}, "p10_found": {"doc_id"}}
#: Rows that must be as many as the table has.
WHOLE = {"p8_ids": "documents", "p7_texts": ("comments", "four_cell_cohort"), "p6_scores": ("comments", "flips")}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    if name in FOUND:
        assert set(df.columns) == FOUND[name] and len({tuple(r) for r in rows}) == len(rows) and all(v is not None for r in rows for v in r)
    if name in WHOLE:
        tables = [WHOLE[name]] if isinstance(WHOLE[name], str) else WHOLE[name]
        assert len(rows) == sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in tables)
    if name == "p9_report":
        assert abs(sum(r["actual_share"] for r in rows) - 1) < 1e-9
    if name == "p3_posts":
        assert all(r["n_links"] > 0 for r in rows)


def test_consensus_equals_brute_force(spark):
    rng = random.Random(12)
    votes = {}
    for i in range(40):
        t = rng.random() < 0.5
        for a in rng.sample(range(12), rng.randint(1, 8)):
            votes[f"i{i}", f"a{a}"] = float(t if rng.random() < 0.55 + 0.035 * a else not t)
    d = spark.createDataFrame([(i, a, y, n) for n, ((i, a), y) in enumerate(votes.items())], "item string, who string, y double, n int")
    items, people = consensus.discover(consensus.votes_of(d, "item", "who", F.col("y"), ["n"]))

    z = consensus.NormalDist().inv_cdf(0.025)
    quantile = lambda n: n * max(1 - 2 / (9 * n) + z * (2 / (9 * n)) ** 0.5, 1e-3) ** 3
    w, before = {a: 1.0 for _, a in votes}, float("inf")
    while True:
        mass, ones, e, n = {}, {}, {}, {}
        for (i, a), y in votes.items():
            mass[i], ones[i] = mass.get(i, 0) + w[a], ones.get(i, 0) + w[a] * y
        for (i, a), y in votes.items():
            n[a], e[a] = n.get(a, 0) + 1, e.get(a, 0) + (y - ones[i] / mass[i]) ** 2
        after = {a: quantile(n[a]) / (e[a] + consensus.BASE_ERROR * n[a]) for a in w}
        moved = sum(abs(after[a] - w[a]) for a in w) / sum(w.values())
        w = after
        if moved < 1e-3 or moved >= before:
            break
        before = moved
    mass, ones = {}, {}
    for (i, a), y in votes.items():
        mass[i], ones[i] = mass.get(i, 0) + w[a], ones.get(i, 0) + w[a] * y
    got = {r["item"]: (r["truth"], r["label"]) for r in items.collect()}
    assert set(got) == set(mass)
    assert all(got[i][0] == pytest.approx(ones[i] / mass[i]) and got[i][1] == (ones[i] >= 0.5 * mass[i]) for i in got)
    assert {r["annotator"]: r["weight"] for r in people.collect()} == pytest.approx(w)
    # The weights matter: some labels are not those of the plain majority.
    plain = {i: sum(y for (j, _), y in votes.items() if j == i) / sum(j == i for j, _ in votes) >= 0.5 for i in mass}
    assert any(plain[i] != bool(got[i][1]) for i in got)
