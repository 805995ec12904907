import json
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from dapple.operators import agreement as A
from dapple.operators import bootstrap as B
from dapple.operators import dense as D
from dapple.operators import prompts as P
from dapple.operators import similar as S
from dapple.operators import tokens as T
from dapple.operators import uniformity as U
from dapple.operators.copies import link_copies
from dapple.sources import paths
from dapple.streaming.incremental import dead_letters, follow, resend, running_counts

OBS = "model string, context string, occupation string, type string, prompt string, cohort string, dimension string, label string, count bigint"


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(1)
    rows = [("gen_SDXL", c, o, t, p, "people", "hair", str(lab), int(rng.integers(1, 30))) for c in ("CF", "CA-R", "CA-U") for o in ("x", "y", "z") for t in ("t1", "") for p in ("p1", "p2") for lab in rng.choice(["Red ", "blue", "unknown", "tan"], 2, replace=False)]
    rows += [(None, "CF", "x", "t1", "p1", "people", "hair", "red", 3), ("gen_SDXL", "CF", "x", "t1", "p1", "totals", "images", "images", 3), ("gen_SDXL", "CF", "x", "t1", "p1", "people", "hair", None, 3)]
    return spark.createDataFrame(rows, OBS)


def test_dense_totals_and_caps(obs):
    counts = D.prompt_counts(obs)
    assert counts.agg(F.max("count")).first()[0] <= 10 and counts.where("label = 'unknown'").count() == 0
    rows = D.dense_fact(obs).collect()
    per = defaultdict(set)
    for r in rows:
        per[(r.prompt_group, r.context, r.occupation)].add(r.label)
        assert r.obs_whole >= r.obs_context >= r["count"]
        if r.loo_occ is not None:
            assert r.loo_occ == pytest.approx((r.obs_whole - r["count"]) / (r.n_all - r.n_occ))
    for (g, *_), labels in per.items():
        assert len(labels) == len({r.label for r in rows if r.prompt_group == g})
    assert D.dense_fact(obs.limit(0)).collect() == []


def test_completion_is_full(obs):
    full = U.completed(obs.where("model IS NOT NULL AND label IS NOT NULL")).collect()
    keys = Counter((r.dimension, r.context, r.occupation, r.label) for r in full)
    assert max(keys.values()) == 1 and len([k for k in keys if k[0] == "hair"]) == 3 * 3 * len({k[3] for k in keys if k[0] == "hair"})


def test_bootstrap_matches_numpy(obs):
    dense = D.dense_fact(obs).where("model IS NOT NULL")
    got = {(r.context_short, r.replicate): r.bi for r in B.trajectories(dense, D.POOLED, replicates=5, seed=3).where("dimension = 'hair'").collect()}
    rows = dense.where("prompt_group = 'ALL_TYPES' AND dimension = 'hair'").collect()
    w = B.role_weights(["gen_SDXL"], ["x", "y", "z"], 5, 3)
    for c in B.CONDITIONS:
        for rep in range(6):
            pooled = Counter()
            for r in rows:
                if r.context == c:
                    pooled[r.label] += r["count"] * int(w[("gen_SDXL", c)]["xyz".index(r.occupation), rep])
            v = np.array([x for x in pooled.values() if x > 0], float)
            q = v / v.sum()
            assert got[(c, rep)] == pytest.approx(0.0 if len(v) == 1 else 1 + (q * np.log(q)).sum() / np.log(len(v)), abs=1e-9)
    diffs = B.differences(B.family_means(B.trajectories(dense, D.POOLED, replicates=5, seed=3)))
    assert all(r.ci_low <= r.ci_high and r.n_replicates == 5 for r in diffs.collect())


def test_agreement(spark):
    rows = [(r, "f", "c", f"d{i}", lab, n, k) for r, labs in (("a", "xxyy"), ("b", "xyyy"), ("c", "xxyx")) for i, lab in enumerate(labs) for k, (lab, n) in enumerate(((lab, 2), ("z", 2), ("w", 1)))]
    labels = A.majority_labels(spark.createDataFrame(rows, "rater string, stem string, cohort string, dimension string, label string, count bigint, row_no int"))
    assert {(r.rater, r.dimension): r.label for r in labels.collect()}[("b", "d1")] == "y"
    score = {(r.rater_a, r.rater_b): r for r in A.pair_scores(A.rater_pairs(labels), ["rater_a", "rater_b"]).collect()}
    assert score[("a", "b")].kappa == pytest.approx((0.75 - 0.5) / 0.5) and score[("a", "b")].macro_recall == pytest.approx(0.75)
    counts = A.category_counts(labels, 3)
    p = [1, 1 / 3, 1, 1 / 3]
    pe = (6 / 12) ** 2 + (6 / 12) ** 2
    assert A.fleiss(counts, 3, ["stem"]).first().kappa == pytest.approx((np.mean(p) - pe) / (1 - pe))
    ci = A.fleiss_interval(counts, 3, ["stem"], 200).first()
    assert ci.ci_low <= ci.ci_high
    same = labels.withColumn("label", F.lit("x"))
    assert A.fleiss(A.category_counts(same, 3), 3, ["stem"]).first().kappa == 1.0 and A.pair_scores(A.rater_pairs(same), ["stem"]).first().kappa == 1.0


def test_similar_pairs_lose_none(spark):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abc "), int(rng.integers(3, 9)))).strip() + "x" for _ in range(60)})
    v = spark.createDataFrame([("g", w) for w in words], "g string, t string")
    vec = S.tfidf(v, ["g"], "t")
    full = defaultdict(dict)
    for r in vec.collect():
        full[r.t][r.gram] = r.w
    want = {(a, b) for a in full for b in full if a < b and sum(full[a][k] * full[b].get(k, 0) for k in full[a]) >= 0.5}
    assert {(r.a, r.b) for r in S.similar_pairs(vec, ["g"], "t", 0.5).collect()} == want and want


def test_standards_and_clusters(spark):
    rows = [("f", x) for x in ["hair_color"] * 3 + ["hair color"] * 2 + ["hair colors", "mood", "Mood", "??", None]]
    got = {r.dimension: r.standard for r in S.standardise(spark.createDataFrame(rows, "file string, dimension string"), ["file"], "dimension").collect()}
    assert got["hair color"] == got["hair colors"] == got["hair_color"] == "hair_color" and got["??"] == "??" and got["Mood"] == got["mood"]
    names = S.online_clusters(["red apple", "red apples", "sky"], [1, 5, 1])
    assert names[0] == names[1] == "red_apples" and names[2] == "sky"
    kept = S.keep_unlike(spark.createDataFrame([("r", "open the gate", 1), ("r", "open the gates", 2), ("r", "paint", 3), ("r", None, 4)], "role string, t string, o int"), ["role"], "t", "o")
    assert {r.t for r in kept.collect()} == {"open the gate", "paint"}
    counts = spark.createDataFrame([("people", "hair", "Dark-Blue", 2), ("people", "hair", "dark blue", 1), ("totals", "images", "images", 4), ("people", "role_hint", "x", 1), ("people", "hair", None, 1)], "cohort string, dimension string, label string, count bigint")
    assert {(r.dimension, r.label, r["count"]) for r in S.semantic_clean(counts, ["cohort", "dimension"]).collect()} == {("hair", "dark_blue", 3), ("images", "images", 4)}
    r = spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string").select(S.ratio("a", "b").alias("r")).collect()
    assert r[0].r == SequenceMatcher(None, "abcd", "bcde").ratio() and r[1].r is None


def test_prompts(spark):
    bank = spark.createDataFrame([("cook", "related", 1, "stirring", "kitchen"), ("cook", "related", 2, "tasting", "hall"), ("cook", "other", 1, "a", "b"), ("maid", "unrelated", 1, None, "b")], "role string, bucket string, pos int, action string, location string")
    got = P.expand(bank)
    assert sorted(r.prompt for r in got.collect()) == ["a photo of a cook", "a photo of a cook in a hall", "a photo of a cook in a kitchen", "a photo of a cook stirring in a kitchen", "a photo of a cook tasting in a hall"]
    plan = P.image_plan(got, 30).collect()
    assert len(plan) == 30 and all(1 <= r.seed <= P.MOST_SEED for r in plan)

    def broken(texts):
        raise OSError

    items = spark.createDataFrame([("x",), ("y",)], "t string")
    assert P.scored(items, "t").where(P.passes("score")).count() == 2 and P.scored(items, "t", broken).where(P.passes("score")).count() == 0


RECORDS = [
    (1, json.dumps({"schema_version": "1", "cohorts": {"scene_appearance": {"mood": "calm", "dominant_colors": ["red", "none", "red"]}, "people": {"persons": [{"pose": "sit", "activities": "run"}, {"pose": "sit", "clothing": {"clothing_garment": "hat"}}]}, "objects": {"items": {"b": 1, "a": 2}}}})),
    (2, json.dumps({"extra": 1, "cohorts": {"camera": {"framing": "odd"}, "people": [{"pose": "unknown"}], "objects": ["a", None, "b", "c"]}})), (3, "{\"cut"), (4, None), (5, json.dumps({"cohorts": None})),
]


def test_tokens_and_validation(spark):
    recs = T.parsed(spark.createDataFrame(RECORDS, "record_id bigint, record string"))
    got = {(r.id, r.dimension, r.label) for r in T.image_tokens(recs).collect()}
    assert got == {(1, "mood", "calm"), (1, "dominant_colors", "red"), (1, "pose", "sit"), (1, "activities", "run"), (1, "clothing_garment", "hat"), (1, "items", "a"), (1, "items", "b"), (2, "framing", "odd"), (2, "items", "a"), (2, "items", "b"), (2, "items", "c")}
    assert tuple(T.totals(recs).first()) == (3, 3, 6)
    vocab = spark.createDataFrame([("mood", "calm"), ("framing", "tight")], "dimension string, label string")
    assert {tuple(r) for r in T.validate(recs, vocab).collect()} == {(2, "extra_key", "extra"), (2, "too_many_items", "items"), (2, "literal", "framing")}


def test_validation_at_every_depth(spark):
    person = {"pose": "sit", "shoes": 1, "eyewear_present": "maybe", "facial_hair_color": "reddish", "clothing": [{"clothing_garment": "hat", "clothing_color": ["red", "blurple"], "fit": "x"}]}
    record = {"image": {"image_id": "1", "size": 3}, "cohorts": {"camera": {"framing": "tight", "iso": 1}, "people": {"persons": [person, person]}, "objects": {"items": [], "count": 2}, "sky": {}}}
    recs = T.parsed(spark.createDataFrame([(1, json.dumps(record)), (2, "{}")], "record_id bigint, record string"))
    vocab = spark.createDataFrame([("framing", "tight"), ("dominant_colors", "red"), (None, "x")], "dimension string, label string")
    errors = T.validate(recs, vocab)
    rows = [tuple(r) for r in errors.collect()]
    places = {"image.size", "cohorts.sky", "cohorts.camera.iso", "cohorts.objects.count", "people.persons.shoes", "people.persons.clothing.fit"}
    assert set(rows) == {(1, "extra_key", p) for p in places} | {(1, "literal", "eyewear_present"), (1, "literal", "facial_hair_color"), (1, "literal", "clothing_color")} and len(rows) == 9
    assert [r.id for r in T.colour_errors(errors).collect()] == [1]


def test_stream_takes_only_what_is_new(spark, tmp_path):
    schema = "record_id bigint, record string"
    spark.createDataFrame(RECORDS[:1], schema).write.parquet(f"{tmp_path}/in/a")
    src, out = f"file://{tmp_path}/in/*", f"file://{tmp_path}/out"
    follow(spark, src, schema, out)
    first = running_counts(spark, out).agg(F.sum("count")).first()[0]
    spark.createDataFrame(RECORDS[1:], schema).write.parquet(f"{tmp_path}/in/b")
    follow(spark, src, schema, out)
    follow(spark, src, schema, out)
    assert (first, running_counts(spark, out).agg(F.sum("count")).first()[0]) == (7, 11)
    assert {r.record_id for r in dead_letters(spark, out).collect()} == {3, 4}


def test_count_files(spark, tmp_path):
    for path, body in {
        "m1/CF/cook/p1/frequency": "cohort,dimension,label,count\npeople,hair,red,2\npeople,hair,None,x\n", "m1/CF/cook/t/p2/frequency": "cohort,dimension,label,count\npeople,hair,tan,1\n", "m1/.hidden/cook/p1/frequency": "cohort,dimension,label,count\npeople,hair,no,9\n",
    }.items():
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "frequencies.csv").write_text(body)
    got = {(r.model, r.type, r.prompt, r.label, r["count"]) for r in paths.read_counts(spark, [str(tmp_path)]).collect()}
    assert got == {("m1", "no_type", "p1", "red", 2.0), ("m1", "no_type", "p1", None, 0.0), ("m1", "t", "p2", "tan", 1.0)}
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"x": 1,\n "y": "z"}')
    (tmp_path / "j/b.json").write_text('{"x": ')
    assert [r.x for r in paths.read_json_objects(spark, f"{tmp_path}/j", "x bigint, y string").collect()] == [1]
    (tmp_path / "j/i.png").write_bytes(b"\x00\x01")
    assert paths.data_urls(spark, f"{tmp_path}/j").first().url == "data:image/png;base64,AAE="


def test_link_copies(spark):
    rows = spark.createDataFrame([("k", 3), ("k", 1), ("j", 2), ("k", 7)], "key string, id bigint")
    assert {(r.id, r.kept.id) for r in link_copies(rows, ["key"], ["id"]).collect()} == {(3, 1), (7, 1)}


def test_dead_letters_come_again(spark, tmp_path):
    schema = "record_id bigint, record string"
    spark.createDataFrame(RECORDS, schema).write.parquet(f"{tmp_path}/in/a")
    out = f"file://{tmp_path}/out"
    follow(spark, f"file://{tmp_path}/in/*", schema, out)
    first = running_counts(spark, out).agg(F.sum("count")).first()[0]
    again = spark.createDataFrame([(3, json.dumps({"cohorts": {"camera": {"framing": "tight"}}})), (4, "still {"), (1, RECORDS[0][1])], schema)
    for _ in range(2):  # an attempt that is run again changes nothing
        assert [r.record_id for r in resend(spark, out, again, "1").collect()] == [3]
        assert running_counts(spark, out).agg(F.sum("count")).first()[0] == first + 1
        assert {r.record_id for r in dead_letters(spark, out).collect()} == {4}
    assert resend(spark, out, again, "2").count() == 0


def test_dense_rows_in_blocks_of_occupations(obs, monkeypatch):
    columns = ["context", "occupation", "label", "count", "obs_context", "n_occ", "n_context", "n_all", "bins", "exp_occ"]
    whole = Counter(map(tuple, D.dense_fact(obs).select(*D.GROUP, *columns).collect()))
    monkeypatch.setattr(D, "OCCUPATIONS", 1)
    assert Counter(map(tuple, D.dense_fact(obs).select(*D.GROUP, *columns).collect())) == whole and whole


def test_weights_are_bounded(obs, monkeypatch):
    monkeypatch.setattr(B, "MOST_WEIGHTS", 5)
    with pytest.raises(ValueError):
        B.trajectories(D.dense_fact(obs), D.POOLED, replicates=5)


def test_scores_errors_and_retries(spark):
    items = spark.range(6).select(F.concat(F.lit("text "), "id").alias("t")).repartition(2)

    def broken(texts):
        if len(texts) and texts[0] != "":
            raise RuntimeError("no answer")

    rows = P.scored(items, "t", broken).collect()
    assert len(rows) == 6 and all(r.score.relevance == 3 and r.error == "RuntimeError: no answer" for r in rows)
    assert all("0 answers" in r.error for r in P.scored(items, "t", lambda texts: []).collect())
    assert all(r.error is None for r in P.scored(items, "t").collect())

    def half(df):
        return df.select("t", F.when(F.col("t").endswith("1") | F.col("t").endswith("3"), F.lit("bad")).alias("error"))

    out = P.retried(items, half, passes=3).collect()
    assert len(out) == 6 and {(r.t, r.pass_no) for r in out if r.error} == {("text 1", 3), ("text 3", 3)} and {r.pass_no for r in out if not r.error} == {1}
