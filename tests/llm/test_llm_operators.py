"""The training-data operators: brute force, round trips, held-out accuracy, odd inputs."""

from __future__ import annotations

import base64
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorate.llm import abuse, bpe, clusters, consensus, garbled, lookalike, mixing, overlap, pairs, profiles, quota
from quorate.staging import staging_root


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1: consensus


def votes(n_items=60, seed=1):
    rng = random.Random(seed)
    truth = {f"i{k}": rng.random() < 0.5 for k in range(n_items)}
    out = []
    for a in range(14):
        for i, t in truth.items():
            if rng.random() < 0.6:
                y = (not t) if a == 0 else (rng.random() < 0.5) if a == 1 else (t if rng.random() < 0.9 else not t)
                out.append((i, f"a{a}", "remove" if y else "keep", len(out)))
    return truth, out


def test_consensus_finds_labels_and_bad_annotators(spark):
    truth, data = votes()
    d = spark.createDataFrame([*data, *data, (None, "a3", "keep", 1), ("i1", None, "keep", 2), ("i2", "a4", None, 3)], "post string, who string, decision string, n int").withColumn("weight", F.lit("clash"))
    v = consensus.votes_of(d, "post", "who", F.col("decision") == "remove", ["n"])
    assert v.count() == len(data)
    items, people = consensus.discover(v.cache())
    assert sum(r["label"] == truth[r["item"]] for r in items.collect()) >= 57
    assert {r["annotator"] for r in people.where("informedness < 0.4").collect()} == {"a0", "a1"}


def test_consensus_of_nothing(spark):
    v = consensus.votes_of(spark.createDataFrame([], "post string, who string, decision string, n int"), "post", "who", F.col("decision") == "remove", ["n"])
    items, people = consensus.discover(v)
    assert items.count() == people.count() == 0


# 2: quotas


def test_allot_floors_caps_and_remainders():
    assert dict(quota.allot(10, [("a", 0.5, 0, 100), ("b", 0.3, 0, 100), ("c", 0.2, 0, 100)])) == {"a": 5, "b": 3, "c": 2}
    assert dict(quota.allot(10, [("a", 0.5, 0, 2), ("b", 0.25, 0, 100), ("c", 0.25, 0, 100)])) == {"a": 2, "b": 4, "c": 4}
    assert dict(quota.allot(10, [("a", 0.98, 0, 100), ("b", 0.02, 3, 100)])) == {"a": 7, "b": 3}
    assert dict(quota.allot(0, [("a", 1.0, 0, 0)])) == {"a": 0}
    for seed in range(200):
        rng = random.Random(seed)
        t = [(str(k), rng.random(), rng.randint(0, 3), rng.randint(0, 30)) for k in range(5)]
        size = rng.randint(0, 60)
        got = dict(quota.allot(size, t))
        assert all(min(f, h) <= got[c] <= h for c, _, f, h in t)
        assert sum(got.values()) >= min(size, sum(h for *_, h in t))


def test_sample_meets_its_quotas(spark):
    d = spark.createDataFrame([(f"k{i}", "A " if i % 3 else "b") for i in range(300)] * 2 + [(None, "a"), ("k999", None), ("k998", "nan")], "id string, kind string").withColumn("category", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1, 0.4), ("b", 0.4, 1, 0.4), ("none", 0.1, 4, 0.4)], "category string, target_share double, min_rows int, sample_fraction double")
    records = quota.categorized(d, "id", ["kind"])
    plan = quota.plan(records, targets)
    got = {r["category"]: r for r in plan.collect()}
    assert got["none"]["missing"] == 12 and got["none"]["available"] == 0
    drawn = {r["category"]: r["n"] for r in quota.draw(records, plan).groupBy("category").agg(F.count_distinct("key").alias("n")).collect()}
    assert drawn == {c: r["quota"] for c, r in got.items() if r["quota"]}
    assert quota.plan(records.limit(0), targets).agg(F.sum("quota")).first()[0] == 0


# 3: overlap


def test_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {f"p{k}": [rng.choice(vocabulary) for _ in range(30)] for k in range(60)}
    for k in range(60, 90):
        base = list(texts[f"p{k - 60}"])
        base[rng.randrange(30)] = "changed"
        texts[f"p{k}"] = base
    said = {k: ("RT @x: " if rng.random() < 0.2 else "") + " ".join(t).upper() + rng.choice(["!", "", " https://a.example/1"]) for k, t in texts.items()}
    keys = list(texts)
    train, test = keys[:65], keys[60:]
    plain = lookalike.default_rewriter()
    words = {k: overlap.words(t, plain) for k, t in said.items()}
    want = {tuple(sorted((a, b))) for a in train for b in test if a == b or overlap.shared_in_order(words[a], words[b]) >= overlap.SHARED}
    d = spark.createDataFrame([*said.items(), ("q", None), (None, "x"), ("e", ""), ("s", "👍")], "id string, text string").withColumn("key", F.lit(1))
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "k string")
    got = overlap.cross_split(d, "id", "text", one([*train, "q", None, "gone"]), one([*test, "q", "q", "s"]))
    assert {tuple(r) for r in got.collect()} == want | {("q", "q")}
    assert overlap.cross_split(d.limit(0), "id", "text", one(train), one(test)).count() == 0
    found = overlap.overlaps(d, "id", "text", one([*train, "q", None, "gone"]), one([*test, "q", "q", "s"]))
    links = {}
    for a in train:
        for b in test:
            if a == b or tuple(sorted((a, b))) in want:
                links[a, "train"], links[b, "test"] = links.get((a, "train"), 0) + 1, links.get((b, "test"), 0) + 1
    assert {(r["key"], r["split"]): r["n_links"] for r in found.collect()} == links | {("q", "train"): 1, ("q", "test"): 1}


def test_overlap_of_scattered_changes(spark):
    # No three words in a row are left, though four fifths of the words are shared in the same order.
    said = [f"word{i}" for i in range(60)]
    data = {"a": said, "b": [w for i, w in enumerate(said) if i % 3], "c": said[::2], "d": ["so"] * 40, "e": ["so"] * 30, "f": ["so"] * 20, "g": ["one"], "h": ["ONE!"], "i": ["two"]}
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in data.items()], "id string, text string")
    got = overlap.cross_split(d, "id", "text", spark.createDataFrame([(k,) for k in "adg"], "k string"), spark.createDataFrame([(k,) for k in "bcefhi"], "k string"))
    assert rows(got) == [("a", "b"), ("d", "e"), ("g", "h")]


def test_overlap_of_many_blocks(spark, monkeypatch):
    class Texts:
        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, pack, schema):  # noqa: N802
            return pack

    monkeypatch.setattr(overlap, "BLOCK", 40)
    rng = random.Random(4)
    said = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))] for _ in range(150)] + [["z"] * 100, ["z"] * 90]
    said = [list(t) for t in dict.fromkeys(map(tuple, said))]
    batch = pa.RecordBatch.from_pylist([{"class": i.to_bytes(32, "big"), "words": " ".join(t), "train": i % 2 == 0 or None, "test": i % 3 < 2} for i, t in enumerate(said)])
    blocks = [b.to_pylist()[0] for b in overlap._blocks(Texts())(iter([batch.slice(0, 50), batch.slice(50)]))]
    assert all(b["n_words"] <= 40 or len(b["classes"]) == 32 for b in blocks) and len(blocks) > 20
    train, test = ([b for b in blocks if b["side"] == side] for side in ("train", "test"))
    assert sorted(b["classes"][i : i + 32] for b in train for i in range(0, len(b["classes"]), 32)) == [i.to_bytes(32, "big") for i in range(0, len(said), 2)]
    got = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for x in train for y in test for a, b in overlap._Lists(x).alike(y)]
    assert sorted(got) == [(i, j) for i in range(0, len(said), 2) for j in range(len(said)) if j % 3 < 2 and i != j and overlap.shared_in_order(said[i], said[j]) >= overlap.SHARED]


def test_overlap_writes_in_proportion_to_its_texts(spark):
    # All texts consist of the same phrases, so that many share some.
    rng = random.Random(8)
    phrases = [" ".join(rng.choice(["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "islet", "jetty"]) for _ in range(4)) for _ in range(150)]
    data = [(f"p{k}", " ".join(rng.sample(phrases, 9))) for k in range(1500)]
    train, test = ([(f"p{k}",) for k in range(1500) if (k % 5 == 0) == own] for own in (False, True))
    d = spark.createDataFrame(data, "id string, text string")

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).head().totalShuffleWrite() + sum(f.stat().st_size for f in Path(staging_root(spark)).rglob("*.parquet"))

    before = written()
    overlap.cross_split(d, "id", "text", spark.createDataFrame(train, "k string"), spark.createDataFrame(test, "k string")).collect()
    assert written() - before < 4 * sum(len(t) for _, t in data)


def test_shared_in_order():
    assert overlap.shared_in_order(list("abcd"), list("abxd")) == 0.75
    assert overlap.shared_in_order([], ["a"]) == 0.0
    assert overlap.shared_in_order(["a"] * 5000, ["a"] * 5000) == 1.0


# 4: clusters


def test_clusters_of_claims(spark):
    rng = random.Random(5)
    frames = ["claims that {a} of {p} {v} {o} in {q}", "{o} in {q}: {a} from {p} {v} them", "the post says {a} of {p} always {v} {o} of {q}"]
    data = []
    for c in range(12):
        parts = {"a": f"actor{c % 5}", "p": f"place{c}", "v": f"verb{c % 4}", "o": f"thing{c % 6}", "q": f"spot{c}"}
        data += [(f"f{len(data) + i:04d}", rng.choice(frames).format(**parts), c) for i in range(6)]
    data += [(f"n{i:04d}", f"odd{i} remark{i} upon{i} nothing{i}", -1) for i in range(30)] + [("z1", None, -1), ("z2", "", -1), (None, "x y z", -1)]
    d = spark.createDataFrame(data, "id string, text string, truth int").withColumn("term", F.lit("clash"))
    got = clusters.cluster(d, "id", "text").cache()
    truth = {k: c for k, _, c in data}
    assert got.where("feature_id LIKE 'n%' OR feature_id LIKE 'z%'").count() == 0
    by = {}
    for r in got.collect():
        by.setdefault(r["cluster_key"], set()).add(truth[r["feature_id"]])
    assert all(len(c) == 1 for c in by.values()) and len({next(iter(c)) for c in by.values()}) >= 10
    assert clusters.typical(got).where("size(members) > 3").count() == 0
    assert clusters.cluster(d.limit(0), "id", "text").count() == 0


def test_clusters_of_claims_in_a_common_frame(spark):
    # The frame alone has more pairs of high lift than are tried first.
    frame = "before lunar tidal galas open"
    data = [(f"c{i}", f"herons guard amber lanterns upstream {frame}") for i in range(4)]
    data += [(f"f{i}", f"odd{i} remark{i} upon{i} nothing{i} {frame}") for i in range(5)]
    data += [(f"n{i}", f"plain{i} words{i} without{i} sense{i}") for i in range(91)]
    got = clusters.cluster(spark.createDataFrame(data, "id string, text string"), "id", "text")
    assert rows(got.select("feature_id", "cluster_key")) == [(f"c{i}", "c0") for i in range(4)]


def test_clusters_of_long_records(spark):
    claim = " ".join(f"claim{j}" for j in range(30))
    data = [(f"c{i}", f"{claim} " + " ".join(f"typo{i}x{j}" for j in range(14))) for i in range(4)]
    data += [(f"n{i}", f"plain{i} words{i} without{i} sense{i}") for i in range(91)]
    got = clusters.cluster(spark.createDataFrame(data, "id string, text string"), "id", "text")
    assert rows(got.select("feature_id", "cluster_key")) == [(f"c{i}", "c0") for i in range(4)]


def test_the_criterion_chooses_the_components():
    rng = np.random.default_rng(4)
    means = rng.normal(size=(5, 64))
    x = np.concatenate([m + 0.3 * rng.normal(size=(20, 64)) for m in means])
    labels = clusters.divide(x, np.ones(len(x)))
    assert len(set(labels)) == 5 and all(len(set(labels[i : i + 20])) == 1 for i in range(0, 100, 20))
    assert set(clusters.divide(x[:20], np.ones(20))) == {0}


def test_clusters_do_not_depend_on_the_layout(spark, monkeypatch):
    rng = random.Random(6)
    data = []
    for c in range(6):
        words = [f"word{c}x{j}" for j in range(6)]
        data += [(f"f{len(data) + i:03d}", " ".join(rng.sample(words, 5)), " ".join(words) if i % 2 else None) for i in range(9)]
    data += [(f"n{i:03d}", f"odd{i} remark{i} upon{i}", None) for i in range(20)]
    d = spark.createDataFrame(data, "id string, text string, more string")
    whole = rows(clusters.cluster(d, "id", "text", "more").select("feature_id", "cluster_key"))
    assert len(whole) == 54 and len({k for _, k in whole}) == 6
    monkeypatch.setattr(clusters, "LAYOUT", 5)
    assert rows(clusters.cluster(d, "id", "text", "more").select("feature_id", "cluster_key")) == whole


# 5: pairs


@pytest.mark.parametrize(
    ("original", "response", "want"),
    [
        ("The mayors defend parks in the city now.", None, "empty"),
        ("The mayors defend parks in the city now.", "​ ", "empty"),
        ("The mayors defend parks in the city now.", "N/A", "empty"),
        ("The mayors defend parks in the city now.", "I'm sorry, but I can't rewrite this post.", "refusal"),
        ("The mayors defend parks in the city now.", "the MAYORS defend parks in the city now", "copy"),
        ("The mayors defend parks in the city and they are not the only ones.", "Los alcaldes no defienden los parques de la ciudad y no es por eso", "other_language"),
        ("The mayors defend parks in the city now.", 'Voters: ```json\n{"a": 1', "truncated"),
        ("The mayors defend parks in the city now.", "Some voters want,", "truncated"),
        ("The mayors defend parks in the city now.", "I refuse to accept that voters praise roads", None),
        (None, "Voters praise roads", None),
    ],
)
def test_defects(original, response, want):
    assert pairs.defect(original, response, lookalike.default_rewriter(), pairs.Endings({})) == want


def test_parser_and_tiling():
    assert pairs.left_open('a (b [c] "d" `e(`) <b>x</b><br>') == []
    assert pairs.left_open('a (b "c') == ["(", '"']
    assert pairs.tiled("a b c d e".split(), "x a b c y d e".split(), 2) == 5


def test_defects_of_odd_tables(spark):
    d = spark.createDataFrame([(1, None, None), (None, "a b", ""), (1, None, None)], "id long, a string, b string").withColumn("key", F.lit("clash"))
    assert rows(pairs.defects(d, "id", "a", "b")) == [(1, "empty"), (1, "empty"), (None, "empty")]
    assert pairs.defects(d.limit(0), "id", "a", "b").count() == 0


def test_truncation_needs_no_frequent_neighbours(spark):
    said = "the old harbour council delayed every new ferry licence because"
    words = [*said.split(), "of"]
    # 230,000 neighbours three times each, and those of the flip only twice.
    noise = [" ".join(x for j in range(480) for x in (f"w{i}", f"w{j}")) for i in range(480)]
    originals = [*noise * 3, *[", ".join(words) + ", "] * 30, f"{said} of rain."]
    d = spark.createDataFrame([*((i, t, None) for i, t in enumerate(originals)), (-1, None, said), (-2, None, " ".join(words[i] for i in (6, 2, 9, 0, 4, 8, 1, 5, 3, 7)))], "id long, a string, b string").repartition(4)
    assert rows(pairs.defects(d, "id", "a", "b").where("id < 0")) == [(-1, "truncated")]


# 6: abuse


def test_abuse_on_held_out_texts(spark):
    rng = random.Random(7)
    bad = ["you are a worthless moron", "shut up you idiot", "what a stupid idiot you are", "nobody likes you moron"]
    good = ["the council votes on parks", "roads cost nine million", "we praise the new library", "voters want cheap trams", "calling people names is wrong"]
    make = lambda b: " ".join(rng.sample(["indeed", "today", "well", "so"], 2)) + ". " + rng.choice(bad if b else good) + ". " + rng.choice(good)
    data = [(make(b), int(b)) for b in [True, False, False, False] * 120]
    noisy = [(t, 1 - y if rng.random() < 0.04 else y) for t, y in data[:320]]
    plain = lookalike.default_rewriter()
    model = abuse.fit([t for t, _ in noisy], [y for _, y in noisy], plain)
    p = 1 - model.scores([t for t, _ in data[320:]], plain)[:, 0]
    assert sum((x >= abuse.THRESHOLD) == bool(y) for x, (_, y) in zip(p, data[320:], strict=True)) >= 0.95 * len(p)
    assert 1 - model.scores(["well. you are a worthless m o r o n"], plain)[0, 0] >= abuse.THRESHOLD
    assert abuse.fit(["a"], [0], plain) is None
    d = spark.createDataFrame([("a", None), ("b", ""), ("c", "shut up you idiot"), ("c", "x " * 20000)], "id string, text string")
    got = abuse.score(d, "text", model, {}).collect()
    assert [r["p_bad"] > 0.5 for r in got] == [False, False, True, False]
    assert all(r["p_bad"] == 0 for r in abuse.score(d, "text", None, {}).collect())


# 7: look-alikes


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｈｅｌｌｏ　ｗｏｒｌｄ！", "hello world!"), ("ѕраrе me", "spare me"), ("co​op so­ft", "coop soft"), ("naïve", "naïve"), ("ﬁne 𝐛𝐨𝐥𝐝", "fine bold"), ("a b", "a b"),
        ("naïve “quotes” — …", None), ("Москва и город", None), ("👨‍👩‍👧 🤦🏽‍♀️ ❤️", None), ("学校を忘れた！", None), ("می‌خواهم", None), ("", None), ("plain", None),
    ],
)
def test_lookalikes(text, want):
    one = lookalike.default_rewriter()
    assert one(text) == (text if want is None else want)
    assert one(one(text)) == one(text)


def test_unify_keeps_rows(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "ａ"), (3, "ａ"), (4, "é" * 50000)], "id int, text string").withColumn("plain_text", F.lit("clash"))
    got = lookalike.unify(d, "text")
    assert [r["plain_text"] for r in got.collect()] == [None, "", "a", "a", "é" * 50000]
    assert lookalike.unify(d.limit(0), "text").count() == 0


# 8: token ids


def test_ids_equal_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        auto = bpe.Automaton(f.read())
    rng = random.Random(8)
    letters = [*map(chr, range(32, 127)), *"éüñ日本語текст👍‍\n\t ", "aa", "the ", "ing", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) if rng.random() < 0.7 else rng.choice(letters) * rng.randint(1, 300)
        ids = auto.encode(text)
        assert ids == library.encode_ordinary(text) and auto.decode(ids) == text
    d = spark.createDataFrame([(1, None), (2, ""), (None, "hi"), (4, "x" * 20000), (4, "hi")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {(r["doc_id"], len(r["ids"])) for r in bpe.encode(d, "doc_id", "text").collect()}
    assert got == {(1, 0), (2, 0), (None, 1), (4, len(library.encode_ordinary("x" * 20000))), (4, 1)}
    assert bpe.encode(d.limit(0), "doc_id", "text").count() == 0
    assert {r["n"] for r in bpe.count_tokens(d, "text", "n").where("doc_id IS NULL").collect()} == {1}


# 9: mixing


def test_mix_reaches_its_shares(spark):
    data = [(i, ("Big " if i % 2 else "big"), 10) for i in range(4000)] + [(5000 + i, "small", 10) for i in range(100)] + [(9000, None, 500), (9001, "big", None)]
    sized = spark.createDataFrame(data, "id long, source string, n long").withColumn("size", F.lit("clash"))
    weights = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("gone", 0.1, 9)], "source string, target_share double, max_repeats int")
    plan = mixing.budget(sized, "source", "n", weights).cache()
    assert {r["source"] for r in plan.where("short").collect()} == {"small", "gone"}
    mixed = mixing.mix(sized, "id", "source", "n", plan, {"small": [(0.0, 0.0), (1.0, 1.0)]}).cache()
    by = {r["source"]: r for r in mixing.report(mixed, plan).collect()}
    assert by["small"]["tokens"] == 3000 and by["small"]["most_copies"] == 3 and abs(by["big"]["tokens"] - 20750) <= 10
    assert mixed.groupBy("id", "copy").count().where("count > 1").count() == 0
    # A rising schedule asks for three quarters of its tokens in the second half.
    assert 0.7 < mixed.where("source = 'small' AND position > 0.5").count() / 300 < 0.8
    assert mixing.budget(sized.limit(0), "source", "n", weights).where("short").count() == 0


# 10: wrong encodings


def test_garbled_round_trip(spark):
    proper = ["Él comió jamón y piñas en la montaña mañana", "Les élèves préfèrent l'été à la forêt", "Für Bäcker wäre das schöner", "врачи построят дороги в городе снова", "それは学校を忘れた。春になってから", "plain words only here"] * 30
    d = spark.createDataFrame([(i, t) for i, t in enumerate(proper)], "id int, text string")
    broken = [(1000, proper[0].encode().decode("cp1252", "replace"), proper[0]), (1001, proper[3].encode("koi8-r").decode("cp1251"), proper[3]), (1002, proper[1].encode().decode("latin-1"), proper[1]), (1003, "lost � here", None)]
    twice = proper[2].encode().decode("latin-1").encode().decode("latin-1")
    all_of = d.unionByName(spark.createDataFrame([*[(i, t) for i, t, _ in broken], (1004, twice), (1005, None), (1006, "")], "id int, text string")).withColumn("garbled", F.lit("clash"))
    got = {r["id"]: (r["garbled"], r["restored"]) for r in garbled.find(all_of, "text").collect()}
    assert {i for i, (g, _) in got.items() if g} == {1000, 1001, 1002, 1003, 1004}
    assert all(got[i][1] == want for i, _, want in broken) and got[1004][1] == proper[2]
    assert garbled.find(d.limit(0), "text").count() == 0


def test_segments_are_those_of_the_definition():
    def slow(s, lo, hi):
        # The best segment, then those on both sides of it.
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if best is None or best[0] <= 1e-9:
            return []
        return [*slow(s, lo, best[3]), (best[3], best[4]), *slow(s, best[4], hi)]

    rng = random.Random(10)
    for _ in range(60):
        s = [rng.choice([-3.1, -1.3, -0.7, 0.9, 1.1, 2.3]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert garbled.segments(np.array(s)) == slow(s, 0, len(s))
    saw = np.tile([1.0, -1.0 + 1e-6], 200_000) - 1e-7 * np.arange(400_000)
    assert len(garbled.segments(saw)) > 0


@pytest.mark.parametrize("text", ["The plan (which was agreed…", 'He said "we will not', "Three points: [one, two", "See `the code", "A <b>bold plan", "“He left"])
def test_what_is_open_was_broken_off(text):
    assert pairs.unfinished(text) is True


@pytest.mark.parametrize("text", ["so sad :( really.", 'a 5" pipe burst.', "I don`t mind.", 'they said "yes" (twice).', "a) one b) two."])
def test_what_only_looks_open(text):
    assert pairs.unfinished(text) is False


def test_tiles_are_those_of_greedy_tiling():
    def slow(a, b, shortest):
        a, b, n = list(a), list(b), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    best = max(best, (k, -i, -j))
            k, i, j = best[0], -best[1], -best[2]
            if k < shortest:
                return n
            a[i : i + k], b[j : j + k], n = [object()] * k, [object()] * k, n + k

    rng = random.Random(11)
    off = 0
    for _ in range(150):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 25))] for _ in "ab")
        off += abs(pairs.tiled(a, b, 2) - slow(a, b, 2))
    assert off <= 30  # ties may be laid otherwise
    assert pairs.tiled(["x"] * 5000, ["x"] * 5000) == 5000


def test_language_profiles(spark):
    en = ["the council will vote on the new park", "we like the roads of this town", "they want to keep their library open"]
    es = ["el consejo votará sobre el parque nuevo", "nos gustan las calles de este pueblo", "quieren mantener abierta su biblioteca"]
    data = [(t, "EN ") for t in en * 9] + [(t, "es") for t in es * 9] + [("odd", "und"), (None, "es"), ("odd", None), ("odd one", "qq")]
    counts = profiles.learn(spark.createDataFrame(data, "t string, l string"), "t", "l")
    assert sorted(counts) == ["en", "es"]
    p = profiles.Profiles(counts)
    assert p.differ("the roads of the council", "las calles del consejo nuevo y la biblioteca")
    assert not p.differ("the roads of the council", "they want the park open") and not p.differ("", "las calles") and not p.differ("the", "12 !")
    assert profiles.learn(spark.createDataFrame([], "t string, l string"), "t", "l") == {} and not profiles.Profiles({}).differ("a b c", "d e f")
