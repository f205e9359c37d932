"""The annotation store: actions, refusals, and the fold of the log."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators.annotations import AnnotationError, Store, folded_occurrences, near_spellings
from pagemill.sources import readers as RD
from pagemill.sources import writers as WR


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    rows = [(7, 9.0, "a", "t1", "t1", 0, 0, 10, 10, 1), (7, 9.0, "b", "t2", "t2", 0, 0, 10, 10, 2), (3, 5.0, "a", "t3", "t3", 20, 0, 30, 10, 3)]
    schema = "cluster int, best_z double, page string, token string, candidate string, x0 int, y0 int, x1 int, y1 int, ord int"
    clusters, occ = RD.imported_clusters(spark.createDataFrame(rows, schema), "r1")
    s.load(clusters, occ)
    return s


def state(store):
    return {r["cluster_id"]: r for r in store.clusters.collect()}


def test_import_order(store):
    assert {c: r["number"] for c, r in state(store).items()} == {1: 7, 2: 3}
    assert [r["occ_id"] for r in store.occurrences.orderBy("token").collect()] == [1, 2, 3]
    with pytest.raises(RD.InputError):
        RD.imported_clusters(store.spark.createDataFrame([], "cluster int, best_z double, ord int"), "r1", store.clusters)


def test_assign_and_refusals(store):
    with pytest.raises(AnnotationError, match="no concept"):
        store.assign(1, "Horse", "me", "equus")
    with pytest.raises(AnnotationError, match="value"):
        store.assign(1, "Horse", "me", new=True)
    assert store.events.count() == 0
    assert store.assign(1, " Horse ", "me", "equus", new=True) == "Horse"
    with pytest.raises(AnnotationError, match="exists"):
        store.assign(2, "HORSE", "me", "x", new=True)
    assert store.assign(2, "horse", "me", "caballus") == "Horse"
    got = state(store)[1]
    assert (got["status"], got["concept"], got["name"], got["name_source"]) == ("labelled", "Horse", "equus", "manual")
    with pytest.raises(AnnotationError, match="in use"):
        store.delete_concept("horse", "me")
    store.rename_concept("horse", "Equine", "me")
    assert state(store)[2]["concept"] == "Equine" and [r[0] for r in store.concepts.collect()] == ["Equine"]


def test_remove_restore_unlabel(store):
    store.remove(2, "me", "blurred")
    with pytest.raises(AnnotationError, match="removed"):
        store.assign(2, "x", "me", "y", new=True)
    store.restore(2, "me")
    assert state(store)[2]["status"] == "pending"
    store.assign(2, "c", "me", "v", new=True)
    store.remove(2, "me")
    store.restore(2, "me")
    assert state(store)[2]["status"] == "labelled"
    store.unlabel(2, "me")
    assert state(store)[2]["status"] == "pending" and state(store)[2]["name"] is None
    with pytest.raises(AnnotationError):
        store.restore(2, "me")


def test_auto_names_and_reset(store):
    assert store.set_auto_names({1: "auto", 2: "two"}) == 2
    assert store.set_auto_names({1: "auto"}) == 0
    store.assign(1, "c", "me", new=True)
    assert (state(store)[1]["name"], state(store)[1]["name_source"]) == ("auto", "auto")
    store.name(1, "typed", "me")
    store.set_auto_names({1: "other"})
    assert state(store)[1]["name"] == "typed"
    store.assign(2, "c", "me", "z")
    store.remove(2, "me")
    done = store.reset("me", concepts="keep")
    assert (done["clusters"], done["concepts_removed"], done["concepts_left"]) == (2, 0, 1)
    backup = {r["cluster_id"]: r["status"] for r in store.spark.read.parquet(f"{store.folder}/{done['backup']}/clusters").collect()}
    assert backup == {1: "labelled", 2: "removed"}
    assert {c: r["status"] for c, r in state(store).items()} == {1: "pending", 2: "removed"}


def test_words_merge_new(store):
    store.remove_word(1, "me")
    words = lambda: {r["occ_id"]: (r["cluster_id"], r["removed"]) for r in store.occurrences.collect()}
    assert words()[1] == (1, 1)
    store.move_word(1, 2, "me")
    assert words()[1] == (2, 0)
    made = store.new_cluster([3], "me")
    assert words()[3] == (made, 0) and state(store)[made]["number"] == 8
    store.merge(2, 1, "me")
    assert words()[1] == (1, 0)
    assert (state(store)[2]["status"], state(store)[2]["merged_into"]) == ("merged", 1)
    with pytest.raises(AnnotationError):
        store.merge(2, 1, "me")
    store.assign(1, "c", "me", "v", new=True)
    rows = WR.decided(store.clusters, store.occurrences, "r1")
    assert rows.count() == 2
    doc = WR.collection(WR.web_annotations(rows), 'a "b"').first()["document"]
    import json

    parsed = json.loads(doc)
    assert parsed["total"] == 2 and parsed["label"] == 'a "b"' and parsed["items"][0]["body"][0]["value"] == "v"


def test_carry_over(store, spark):
    store.assign(1, "c", "me", "v", new=True)
    rows = [(1, 1.0, "a", "n1", "n1", 1, 0, 11, 10, 1), (1, 1.0, "b", "n2", "n2", 0, 0, 10, 10, 2), (2, 1.0, "z", "n3", "n3", 0, 0, 1, 1, 3)]
    schema = "cluster int, best_z double, page string, token string, candidate string, x0 int, y0 int, x1 int, y1 int, ord int"
    clusters, occ = RD.imported_clusters(spark.createDataFrame(rows, schema), "r2", store.clusters, 10, 10)
    store.load(clusters, occ)
    assert store.carry_over("r1", "r2", "me") == 1
    assert {c: r["status"] for c, r in state(store).items() if r["run_id"] == "r2"} == {10: "labelled", 11: "pending"}


def test_near_spellings(spark):
    names = spark.createDataFrame([("Cavallo",), ("Cavalla",), ("Pecora",)], "name string")
    assert [r["name"] for r in near_spellings(names, "cavalo").collect()] == ["Cavallo", "Cavalla"]
    with pytest.raises(AnnotationError):
        Store(spark, "x.db")
    assert names.select(F.count("*")).first()[0] == 3


def test_chains_of_merges(spark):
    """Five merges in a row, in and against the order of numbers, with moves before, between and after."""
    merges = [(10, 101, 102), (20, 102, 103), (30, 103, 104), (40, 104, 105), (50, 105, 106), (60, 203, 202), (70, 202, 201), (80, 301, 302)]
    events = [(e, "t", "me", "merge", a, f'{{"into": {b}}}') for e, a, b in merges]
    events += [(25, "t", "me", "word_move", 7, '{"occ": 3, "into": 103}'), (55, "t", "me", "word_move", 7, '{"occ": 4, "into": 104}'), (45, "t", "me", "word_move", 7, '{"occ": 5, "into": 105}')]
    log = spark.createDataFrame(events, "event_id long, ts string, annotator string, action string, cluster_id long, payload string")
    base = spark.createDataFrame([(1, 101), (2, 102), (3, 1), (4, 2), (5, 3), (6, 106), (7, 203), (8, 301), (9, 400)], "occ_id long, origin_cluster long")
    got = {r["occ_id"]: r["cluster_id"] for r in folded_occurrences(base, log).collect()}
    assert got == {1: 106, 2: 106, 3: 106, 4: 104, 5: 106, 6: 106, 7: 201, 8: 302, 9: 400}  # word 4 was moved there after the merge


def test_rename_reaches_all_clusters(store):
    store.assign(1, "Horse", "me", "equus", new=True)
    store.assign(2, "horse", "me", "caballus")
    store.remove(2, "me")
    store.rename_concept("HORSE", "horse", "me")  # the spelling alone
    assert [r[0] for r in store.concepts.collect()] == ["horse"]
    store.rename_concept("horse", "Equine", "me")
    store.rename_concept("equine", "Animal", "me")
    assert {c: (r["status"], r["concept"]) for c, r in state(store).items()} == {1: ("labelled", "Animal"), 2: ("removed", "Animal")}
    with pytest.raises(AnnotationError, match="in use"):
        store.delete_concept("animal", "me")
    store.restore(2, "me")
    assert state(store)[2]["concept"] == "Animal"
    store.add_concept("Other", "me")
    store.rename_concept("Other", "ANIMAL", "me")
    assert [r[0] for r in store.concepts.collect()] == ["Animal"]
    for bad in ("", "  ", None):
        with pytest.raises(AnnotationError, match="needed"):
            store.rename_concept("Animal", bad, "me")
    store.add_concept("Imported", "me", source="dictionary")
    done = store.reset("me")
    assert (done["concepts_removed"], done["concepts_left"]) == (1, 1)
    assert {r["concept"] for r in state(store).values()} == {None}


def test_words_refusals(store):
    events = store.events.count
    with pytest.raises(AnnotationError, match="not in cluster"):
        store.remove_word(1, "me", cluster_id=2)
    with pytest.raises(AnnotationError, match="already"):
        store.move_word(1, 1, "me")
    with pytest.raises(AnnotationError, match="needed"):
        store.new_cluster([], "me")
    store.remove(1, "me")
    before = events()
    for refused in (lambda: store.remove_word(1, "me"), lambda: store.move_word(1, 2, "me"), lambda: store.move_word(3, 1, "me"), lambda: store.new_cluster([1, 3], "me")):
        with pytest.raises(AnnotationError, match="is removed"):
            refused()
    assert events() == before


def test_add_word(store):
    word = {"page": "c", "token": "t9", "x0": 1, "y0": 2, "x1": 3, "y1": 4}
    occ, into = store.add_word(word, "me", into=2)
    assert (occ, into) == (4, 2)
    row = store.occurrences.where("occ_id = 4").first()
    assert (row["cluster_id"], row["page"], row["candidate"], row["x1"], row["removed"]) == (2, "c", "t9", 3, 0)
    with pytest.raises(AnnotationError, match="already"):
        store.add_word(word, "me", run_id="r1")
    store.remove_word(4, "me")
    assert store.add_word(word, "me", run_id="r1") == (4, 3)  # back again, in a cluster of its own
    assert state(store)[3]["number"] == 8 and store.occurrences.where("occ_id = 4 and removed = 0 and cluster_id = 3").count() == 1
    with pytest.raises(AnnotationError, match="needed"):
        store.add_word(word | {"token": "new"}, "me")


def test_apply_checks(store, spark):
    checks = spark.createDataFrame([(1, "move", 2), (2, "remove", None), (3, "move", 1)], "occ_id long, verdict string, best_target long")
    assert store.apply_checks(1, checks, "me") == {"move": 1, "remove": 1}
    words = {r["occ_id"]: (r["cluster_id"], r["removed"]) for r in store.occurrences.collect()}
    assert words == {1: (2, 0), 2: (1, 1), 3: (2, 0)}
    store.remove(1, "me")
    with pytest.raises(AnnotationError, match="is removed"):
        store.apply_checks(2, checks.where("occ_id = 3"), "me")
    assert {r["occ_id"]: r["cluster_id"] for r in store.occurrences.collect()} == {1: 2, 2: 1, 3: 2}


def test_one_writer_at_a_time(store):
    """A second writer waits and is refused; a failed action writes nothing and gives the turn back."""
    other = Store(store.spark, store.folder)
    with store.turn():
        with pytest.raises(AnnotationError, match="another writer"), other.turn(patience=0.2):
            pass
        store.remove(1, "me")
    with pytest.raises(AnnotationError):
        other.remove(1, "me")
    other.restore(1, "me")
    assert store.events.select("event_id").distinct().count() == store.events.count() == 2


def test_first_behind_in_ranges(spark, monkeypatch):
    from pagemill.operators import annotations

    monkeypatch.setattr(annotations, "STEPS_TOGETHER", 4)
    steps = [(s, f"c{s * s % 3}") for s in range(1, 60, 2)]
    asked = [(f"c{c}", s) for c in range(4) for s in range(0, 62, 3)]
    out = annotations.first_behind(spark.createDataFrame(asked, "thing string, since int"), spark.createDataFrame(steps, "step int, source string"))
    want = {(c, s): min((n for n, of in steps if of == c and n > s), default=None) for c, s in asked}
    assert {(r.thing, r.since): r.next for r in out.collect()} == want
