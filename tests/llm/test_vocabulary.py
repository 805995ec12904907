import random

from dapple.llm.vocabulary import map_entries, pigeonhole

REF = "map_id bigint, canonical_id bigint, cohort string, dimension string, label string, canonical_label string"
ENTRY = "entry_id bigint, dimension string, label string, value string, id string"
REFS = [
    (1, 1, "o", "items", "mop bucket", "mop bucket"), (2, 1, "o", "items", "rinse pail", "mop bucket"), (3, 2, "o", "items", "wheelbarrow", "wheelbarrow"), (4, 3, "s", "mood", "calm", "calm"),
    (5, 4, "s", "mood", "tense", "tense"), (6, 5, "p", "hair_style", "bob", "bob"), (7, 6, "p", "hair_color", "grey", "grey"), (8, 7, "p", "pose", "hands_on_hips", "hands_on_hips"),
    (9, 8, "c", "framing", "medium", "medium"), (10, 9, "c", "depth_of_field", "medium", "medium"), (11, 10, "c", "framing", "tight", "tight"), (12, 11, "p", "skin_tone", "light", "light"),
]
CASES = [
    ("items", "mop bucket", 1, True), ("ITEMS", "Mop-Bucket", 1, False), ("itmes", "mpo bucekt", 1, False), ("object items", "the rinse pail x2", 1, False), ("items", "bucket, mop", 1, False), ("item", "wheelb.", 2, False),
    ("items", "whee1barow", 2, False), ("mood", "clam", 3, False), ("Mood ", "CALM (partly hidden)", 3, False), ("mood", "tense, probably", 4, False), ("mood", "mop bucket", 0, False), ("mood", "zeppelin", 0, False),
    ("hair style", "a bob", 5, False), ("hair_color", "gray", 6, False), ("pose", "hands on hips", 7, False), ("framing", "mediun", 8, False), ("depth of field", "medium", 9, False), ("framing", "light", 0, False),
    (None, "wheelbarrow", 2, False), (None, "quartz obelisk", 0, False), ("nonsense thing", "calm", 0, False), ("mood", None, 0, False), ("mood", "  ", 0, False), ("mood", "n/a", 0, False), ("mood", "x" * 5000, 0, False), ("mood", "clam", 3, False),
]


def test_meanings(spark):
    entries = spark.createDataFrame([(i, d, v, "clash", "clash") for i, (d, v, *_) in enumerate(CASES)], ENTRY)
    got = {r.entry_id: r for r in map_entries(entries, spark.createDataFrame(REFS, REF)).collect()}
    assert len(got) == len(CASES)
    wrong = [(c, got[i].canonical_id, got[i].listed) for i, c in enumerate(CASES) if (got[i].canonical_id, got[i].listed) != (c[2], c[3])]
    assert not wrong
    assert got[0].canonical_label == "mop bucket" and got[10].canonical_label is None


def test_empty(spark):
    none, some = spark.createDataFrame([], ENTRY), spark.createDataFrame([(1, "mood", "calm", None, None)], ENTRY)
    assert map_entries(none, spark.createDataFrame(REFS, REF)).collect() == []
    assert [r.canonical_id for r in map_entries(some, spark.createDataFrame([], REF)).collect()] == [0]


def test_entries_late_in_long_values(spark):
    before, name = " ".join(f"word{i}q" for i in range(14)), "a b c d e f g h"
    refs = spark.createDataFrame([*REFS, (13, 12, "o", "items", name, name)], REF)
    values = [(f"{before} mop bucket here", 1), (f"{before} {name} here", 12), (f"{before} here", 0)]
    entries = spark.createDataFrame([(i, "items", v, None, None) for i, (v, _) in enumerate(values)], ENTRY)
    assert {r.entry_id: r.canonical_id for r in map_entries(entries, refs).collect()} == {i: c for i, (_, c) in enumerate(values)}


def test_rotations_and_transpositions_of_any_length(spark):
    name = "one two three four five six seven eight nine"
    refs = spark.createDataFrame([*REFS, (13, 12, "o", "items", name, name), (14, 13, "o", "items", "key", "key")], REF)
    values = [("six seven eight nine one two three four five", 12), ("six seven eight nine one two thre four five", 12), ("kye", 13), ("eky", 13), ("yek", 13), ("kzzy", 0), ("wheel bar", 2), ("wh", 0), ("", 0)]
    entries = spark.createDataFrame([(i, "items", v, None, None) for i, (v, _) in enumerate(values)], ENTRY)
    got = {r.entry_id: r.canonical_id for r in map_entries(entries, refs).collect()}
    assert got == {i: c for i, (_, c) in enumerate(values)}


def test_pigeonhole_loses_no_pair(spark):
    """Against all pairs: every value within the accepted edits of a reference string is found."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 16))) for _ in range(60)]
    typed = words[:20] + ["".join(c for c in w if rng.random() > 0.15) + rng.choice(["", "a", "bc"]) for w in words * 3]
    forms = spark.createDataFrame([("near", v, 0, v, v) for v in set(typed) if v], "kind string, value string, rank int, form string, own string")
    k = lambda r: min(4, max(1, len(r) // 3), len(r) - 1)
    refs = spark.createDataFrame([("near", i, "s", r, r, k(r)) for i, r in enumerate(words)], "kind string, id int, scope string, ref string, own string, most int")
    got = {(r.value, r.id): r.d for r in pigeonhole(forms, refs).collect()}
    want = {(v, i): d for v in set(typed) if v for i, r in enumerate(words) if (d := distance(v, r)) <= k(r)}
    assert got == want and len(want) > 100


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
