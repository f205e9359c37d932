"""Annotation state as a fold of an append-only event log.

Every action is one event: event_id, ts, annotator, action, cluster_id, payload
(JSON). Current state is the last value of each field by event_id; nothing is
updated in place. A transaction checks an action against the folded state
before it appends; a refused action appends nothing.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill import schema
from pagemill.functions.text import folded, ratio
from pagemill.operators.aggregates import ordered_distinct
from pagemill.storage import stored

#: States of a cluster; only the first two are open.
STATUSES = ("pending", "labelled", "removed", "merged")
OPEN = ("pending", "labelled")


class AnnotationError(ValueError):
    """An action that the state doesn't allow."""


def field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


#: Rows of a range of step numbers that are sorted together.
STEPS_TOGETHER = 1 << 16


def first_behind(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """asked(thing, since) with next: the first of steps(step, source) whose source is the thing and whose number is above since, or null.

    Both are dealt to ranges of numbers and sorted together there, so no step
    meets another; a thing's ranges know the first step of those behind them.
    """
    ours = asked.select("thing", F.col("since").cast("long").alias("x"), F.lit(0).alias("kind")).where("thing is not null and x is not null").distinct()
    both = stored(ours.unionAll(steps.select(F.col("source").alias("thing"), F.col("step").cast("long").alias("x"), F.lit(1).alias("kind"))), "asked-steps")
    n, low, high = both.agg(F.count("*"), F.min("x"), F.max("x")).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, n // STEPS_TOGETHER) + 1)
    both = both.withColumn("part", F.floor((F.col("x") - F.lit(low or 0)) / F.lit(width)).cast("long"))
    step = F.when(F.col("kind") == 1, F.col("x"))
    parts = both.groupBy("thing", "part").agg(F.min(step).alias("_first"))
    later = Window.partitionBy("thing").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.select("thing", "part", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    above = Window.partitionBy("thing", "part").orderBy(F.desc("x"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_next", F.last(step, ignorenulls=True).over(above)).where("kind = 0").join(parts, ["thing", "part"])
    return rows.select("thing", F.col("x").alias("since"), F.coalesce("_next", "_later").alias("next"))


def settled(steps: DataFrame) -> DataFrame:
    """steps(step, source, into) with last: where a thing that takes the step ends up.

    From into it takes the first step of that source behind this one, and so on.
    Chains are followed by doubling: after k rounds each step knows the one
    2 ** k further on, until none has a next.
    """
    rows = stored(steps, "steps")
    found = first_behind(rows.select(F.col("into").alias("thing"), F.col("step").alias("since")), rows)
    known = rows.join(found, (F.col("into") == F.col("thing")) & (F.col("step") == F.col("since")), "left")
    now = stored(known.groupBy("step").agg(F.min("next").alias("next")), "steps")
    while True:
        ahead = now.select(F.col("step").alias("_s"), F.col("next").alias("_n"), F.lit(True).alias("_there"))
        both = now.join(ahead, F.col("next") == F.col("_s"), "left")
        open_ends = both.where("_n is not null").isEmpty()
        if open_ends:
            ends = rows.select(F.col("step").alias("_e"), F.col("into").alias("last"))
            final = now.withColumn("_e", F.coalesce("next", "step")).join(ends, "_e").select("step", "last")
            return rows.join(final, "step")
        now = stored(both.select("step", F.coalesce("_n", "next").alias("next")), "steps")


def followed(rows: DataFrame, steps: DataFrame, at: str, since: str) -> DataFrame:
    """rows with the column at moved along the steps(step, source, into) that come behind the step number in since. Without steps, rows themselves."""
    if steps.isEmpty():
        return rows
    ends = stored(settled(steps).groupBy(F.col("source").alias("thing"), F.col("step").cast("long").alias("next")).agg(F.min("last").alias("_last")), "settled")
    start = F.coalesce(F.col(since), F.lit(0)).cast("long")
    found = first_behind(rows.select(F.col(at).alias("thing"), start.alias("since")), ends.select(F.col("thing").alias("source"), F.col("next").alias("step")))
    found = found.join(ends, ["thing", "next"]).select(F.col("thing").alias("_thing"), F.col("since").alias("_since"), "_last")
    moved = rows.join(found, (F.col(at) == F.col("_thing")) & (start == F.col("_since")), "left")
    return moved.withColumn(at, F.coalesce("_last", F.col(at))).drop("_thing", "_since", "_last")


def folded_clusters(base: DataFrame, events: DataFrame) -> DataFrame:
    """base(cluster_id, run_id, number, best_z) with the state that events have brought it to.

    One aggregate: for each field the last event that sets it. Restoring leads
    to labelled if the last labelling action was an assignment, else to pending.
    Renamed concepts are renamed in clusters of any state, through all renames
    that came after the assignment.
    """
    action, at = F.col("action"), F.col("event_id")

    def last(value: Column, *actions: str) -> Column:
        return F.max_by(F.struct(value.alias("v")), F.when(action.isin(*actions), at))["v"]

    state = {"assign": "labelled", "remove": "removed", "merge": "merged", "unlabel": "pending", "reset": "pending", "restore": "restored"}
    kind = F.create_map(*[F.lit(x) for pair in state.items() for x in pair])
    fold = events.groupBy("cluster_id").agg(
        last(F.try_element_at(kind, action), *state).alias("_status"),
        last(F.when(action == "assign", F.lit("concept")), "assign", "unlabel", "reset").alias("kind"),
        last(F.when(action == "assign", field("concept")), "assign", "unlabel", "reset").alias("concept"),
        F.max(F.when(action == "assign", at)).alias("_assigned"),
        last(F.when(action.isin("assign", "name"), field("value")), "assign", "name", "unlabel", "reset").alias("name"),
        last(F.when(action == "assign", F.coalesce(field("source"), F.lit("manual"))).when(action == "name", F.lit("manual")), "assign", "name", "unlabel", "reset").alias("name_source"),
        last(field("value"), "auto").alias("auto_name"),
        last(field("into").try_cast("long"), "merge").alias("merged_into"),
        last(F.col("annotator"), *[a for a in state if a != "auto"], "name").alias("annotator"),
        last(F.col("ts"), *[a for a in state if a != "auto"], "name").alias("updated_at"),
        last(F.coalesce(field("note"), field("reason")), "assign", "remove").alias("note"),
    )
    status = F.when(F.col("_status") == "restored", F.when(F.col("kind").isNotNull(), "labelled").otherwise("pending")).otherwise(F.coalesce("_status", F.lit("pending")))
    out = base.join(fold, "cluster_id", "left").withColumn("status", status)
    out = out.withColumn("merged_into", F.when(F.col("status") == "merged", F.col("merged_into")))
    renames = events.where(action == "concept_rename").select(at.alias("step"), field("name").alias("source"), field("into").alias("into"))
    names = [c for c in out.columns if c not in ("_status", "_assigned")]
    return followed(out, renames, "concept", "_assigned").select(*names)


def folded_occurrences(base: DataFrame, events: DataFrame) -> DataFrame:
    """base(occ_id, origin_cluster, ...) with each word's current cluster and whether it is removed.

    A move makes a word active again. Words of a merged cluster follow it, along
    chains of merges of any length, from the merges that came after their move.
    """
    occ = field("occ").try_cast("long")
    own = events.where(F.col("action").isin("word_remove", "word_restore", "word_move")).withColumn("occ_id", occ)
    fold = own.groupBy("occ_id").agg(
        F.max_by(F.when(F.col("action") == "word_remove", 1).otherwise(0), "event_id").alias("removed"),
        F.max_by(F.struct(field("into").try_cast("long").alias("into"), F.col("event_id").alias("moved_at")), F.when(F.col("action") == "word_move", F.col("event_id"))).alias("_m"),
    )
    rows = base.join(fold, "occ_id", "left").withColumn("cluster_id", F.coalesce("_m.into", "origin_cluster"))
    rows = rows.withColumn("_at", F.coalesce("_m.moved_at", F.lit(0))).drop("_m")
    merges = events.where("action = 'merge'").select(F.col("event_id").alias("step"), F.col("cluster_id").alias("source"), field("into").try_cast("long").alias("into"))
    rows = followed(rows, merges, "cluster_id", "_at")
    return rows.withColumn("removed", F.coalesce("removed", F.lit(0))).drop("_at")


def concept_summary(clusters: DataFrame, order: str = "number") -> DataFrame:
    """For each concept of labelled clusters: how many clusters, and its distinct values in order."""
    rows = clusters.where("status = 'labelled' and concept is not null")
    counts = rows.groupBy("concept").agg(F.count("*").alias("n_clusters"))
    values = ordered_distinct(rows, ["concept"], "name", order, "signifiers")
    return counts.join(values, "concept", "left").select("concept", "n_clusters", F.coalesce("signifiers", F.lit("")).alias("signifiers"))


def progress(clusters: DataFrame) -> DataFrame:
    """For each run: clusters by status, and labelled ones with and without a name."""
    named = (F.col("status") == "labelled") & F.col("name").isNotNull()
    return clusters.groupBy("run_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if(named).alias("named"),
        F.count_if((F.col("status") == "labelled") & F.col("name").isNull()).alias("unnamed"),
    )


def listed(clusters: DataFrame, occurrences: DataFrame, run: str, status: str | None = None, concept: str | None = None, unnamed: bool = False) -> DataFrame:
    """Clusters of a run with size and pages of their kept words, by optional filters."""
    rows = clusters.where(F.col("run_id") == run)
    rows = rows if status is None else rows.where(F.col("status") == status)
    rows = rows if concept is None else rows.where(folded(F.col("concept")) == folded(F.lit(concept)))
    rows = rows.where("name is null") if unnamed else rows
    counts = occurrences.where("removed = 0").groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("page").alias("n_pages"))
    return rows.join(counts, "cluster_id", "left").withColumns({"size": F.coalesce("size", F.lit(0)), "n_pages": F.coalesce("n_pages", F.lit(0))})


def near_spellings(concepts: DataFrame, name: str, n: int = 3, least: float = 0.75) -> DataFrame:
    """The most similar concept names."""
    rows = concepts.select("name").withColumn("ratio", ratio(F.lower("name"), F.lower(F.lit(name))))
    return rows.where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "name").limit(n)


def _in_turn(action):
    """An action of a Store that checks and writes as the only writer."""

    @functools.wraps(action)
    def held(self, *args, **kwargs):
        with self.turn():
            return action(self, *args, **kwargs)

    return held


class Store:
    """An annotation folder: clusters and words as imported, concepts, and the event log."""

    def __init__(self, spark: SparkSession, folder: str):
        if folder.endswith(".db"):
            raise AnnotationError("a folder is needed, not a database file")
        self.spark, self.folder, self._turns = spark, folder, 0

    def _table(self, name: str, kind) -> DataFrame:
        path = f"{self.folder}/{name}"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(kind).parquet(path) if there else self.spark.createDataFrame([], kind)

    @property
    def events(self) -> DataFrame:
        return self._table("history", schema.HISTORY)

    @contextmanager
    def turn(self, patience: float = 20.0) -> Iterator[None]:
        """One writer at a time: what an action checks holds until its events are written, as one commit or not at all.

        The turn is a file that only one can create; it is waited for.
        """
        if self._turns == 0:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_turn")
            files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            until = time.monotonic() + patience
            while not files.createNewFile(path):
                if time.monotonic() > until:
                    raise AnnotationError(f"another writer holds {self.folder}/_turn")
                time.sleep(0.05)
        self._turns += 1
        try:
            yield
        finally:
            self._turns -= 1
            if self._turns == 0:
                files.delete(path, False)

    @property
    def base(self) -> DataFrame:
        """Imported clusters, and those that actions made."""
        made = self.events.where("action = 'create'")
        made = made.select("cluster_id", field("run").alias("run_id"), field("number").try_cast("int").alias("number"), F.lit(None).cast("double").alias("best_z"))
        return self._table("clusters", schema.CLUSTER_LABELS).select("cluster_id", "run_id", "number", "best_z").unionByName(made)

    @property
    def clusters(self) -> DataFrame:
        return folded_clusters(self.base, self.events)

    @property
    def occurrences(self) -> DataFrame:
        """Imported words, and those that were added by hand."""
        events = self.events
        added = events.where("action = 'word_add'").select(
            *[field(f.name).try_cast(f.dataType).alias(f.name) if f.name != "origin_cluster" else F.col("cluster_id").alias(f.name) for f in schema.OCCURRENCES if f.name not in ("cluster_id", "removed")]
        )
        return folded_occurrences(self._table("occurrences", schema.OCCURRENCES).drop("cluster_id", "removed").unionByName(added), events)

    def _concepts(self) -> DataFrame:
        e = self.events.where("action in ('concept_add', 'concept_delete')").withColumn("name", field("name")).withColumn("_k", folded(F.col("name")))
        last = e.groupBy("_k").agg(F.max_by(F.struct("name", "action", F.coalesce(field("source"), F.lit("annotator")).alias("source")), "event_id").alias("_l"))
        return last.where("_l.action = 'concept_add'").select("_l.name", "_l.source")

    @property
    def concepts(self) -> DataFrame:
        """Names added, renamed or deleted, by the last event of each spelling."""
        return self._concepts().select("name").orderBy(F.lower("name"))

    def load(self, clusters: DataFrame, occurrences: DataFrame) -> None:
        """Add an imported run."""
        pad = lambda df, kind: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
        pad(clusters, schema.CLUSTER_LABELS).write.mode("append").parquet(f"{self.folder}/clusters")
        pad(occurrences, schema.OCCURRENCES).write.mode("append").parquet(f"{self.folder}/occurrences")

    def log(self, *events: tuple[str, int | None, str, dict]) -> None:
        """Append (action, cluster_id, annotator, payload) events as one commit."""
        with self.turn():
            first = (self.events.agg(F.max("event_id")).first()[0] or 0) + 1
            now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            rows = [(first + i, now, who, what, cluster, json.dumps(payload, ensure_ascii=False)) for i, (what, cluster, who, payload) in enumerate(events)]
            self.spark.createDataFrame(rows, schema.HISTORY).coalesce(1).write.mode("append").parquet(f"{self.folder}/history")

    def _cluster(self, cluster_id: int):
        row = self.clusters.where(F.col("cluster_id") == cluster_id).first()
        if row is None:
            raise AnnotationError(f"no cluster {cluster_id}")
        return row

    def _open(self, cluster_id: int):
        row = self._cluster(cluster_id)
        if row["status"] not in OPEN:
            raise AnnotationError(f"cluster {cluster_id} is {row['status']}")
        return row

    def find_concept(self, name: str) -> str | None:
        row = self.concepts.where(folded(F.col("name")) == folded(F.lit(name))).first()
        return row["name"] if row else None

    @_in_turn
    def add_concept(self, name: str, annotator: str, source: str = "annotator") -> str:
        if known := self.find_concept(name):
            return known
        self.log(("concept_add", None, annotator, {"name": name.strip(), "source": source}))
        return name.strip()

    @_in_turn
    def rename_concept(self, old: str, new: str, annotator: str) -> None:
        """Rename in the list and in all clusters, whatever their state, or merge into a concept that has the new name; clusters keep their values."""
        have = self.find_concept(old)
        if have is None:
            raise AnnotationError(f"no concept {old}")
        if not (new or "").strip():
            raise AnnotationError("a new name is needed")
        there = self.find_concept(new)
        target = new.strip() if there in (None, have) else there
        add = [("concept_add", None, annotator, {"name": target})] if there in (None, have) else []
        self.log(("concept_delete", None, annotator, {"name": have}), *add, ("concept_rename", None, annotator, {"name": have, "into": target}))

    @_in_turn
    def delete_concept(self, name: str, annotator: str) -> None:
        have = self.find_concept(name)
        if have is None:
            raise AnnotationError(f"no concept {name}")
        if not self.clusters.where((F.col("concept") == have) & (F.col("status") != "merged")).isEmpty():
            raise AnnotationError(f"{have} is in use")
        self.log(("concept_delete", None, annotator, {"name": have}))

    @_in_turn
    def assign(self, cluster_id: int, concept: str, annotator: str, value: str | None = None, note: str | None = None, new: bool = False, use_auto: bool = True) -> str:
        """Label an open cluster that has a kept word; the value is typed or the automatic one."""
        row = self._open(cluster_id)
        if self.occurrences.where((F.col("cluster_id") == cluster_id) & (F.col("removed") == 0)).isEmpty():
            raise AnnotationError(f"cluster {cluster_id} has no word left")
        have = self.find_concept(concept)
        if new and have:
            raise AnnotationError(f"{have} exists")
        if not new and not have:
            near = [r["name"] for r in near_spellings(self.concepts, concept).collect()]
            raise AnnotationError(f"no concept {concept}" + (f"; near: {', '.join(near)}" if near else ""))
        typed = (value or "").strip()
        chosen = typed or (row["auto_name"] if use_auto else None)
        if not chosen:
            raise AnnotationError("a value is needed")
        name = have or concept.strip()
        add = [("concept_add", None, annotator, {"name": name})] if new else []
        self.log(*add, ("assign", cluster_id, annotator, {"concept": name, "value": chosen, "source": "manual" if typed else "auto", "note": note}))
        return name

    @_in_turn
    def name(self, cluster_id: int, value: str, annotator: str) -> None:
        if self._open(cluster_id)["status"] != "labelled":
            raise AnnotationError("only a labelled cluster has a value")
        self.log(("name", cluster_id, annotator, {"value": value}))

    @_in_turn
    def set_auto_names(self, names: dict[int, str], source: str = "reader") -> int:
        """Store suggestions that differ from those there are; values given by hand stay."""
        have = {r["cluster_id"]: r["auto_name"] for r in self.clusters.where(F.col("cluster_id").isin(list(names))).collect()}
        changed = [("auto", c, source, {"value": v}) for c, v in names.items() if c in have and have[c] != v]
        if changed:
            self.log(*changed)
        return len(changed)

    @_in_turn
    def remove(self, cluster_id: int, annotator: str, reason: str | None = None) -> None:
        self._open(cluster_id)
        self.log(("remove", cluster_id, annotator, {"reason": reason}))

    @_in_turn
    def restore(self, cluster_id: int, annotator: str) -> None:
        if self._cluster(cluster_id)["status"] != "removed":
            raise AnnotationError("only a removed cluster can be restored")
        self.log(("restore", cluster_id, annotator, {}))

    @_in_turn
    def unlabel(self, cluster_id: int, annotator: str) -> None:
        if self._open(cluster_id)["status"] != "labelled":
            raise AnnotationError("the cluster has no label")
        self.log(("unlabel", cluster_id, annotator, {}))

    @_in_turn
    def reset(self, annotator: str, run_id: str | None = None, concepts: str = "annotator") -> dict[str, int | str]:
        """Back to pending for all labelled clusters, of one run or all; removed ones stay removed but lose their labels.

        Word moves, merges and automatic names stay. concepts says which leave
        the list: those added while annotating, all, or none (keep). The state
        before is written to a backup folder first. Returns counts and its name.
        """
        if concepts not in ("annotator", "all", "keep"):
            raise AnnotationError("concepts must be annotator, all or keep")
        if not annotator:
            raise AnnotationError("an annotator is needed")
        backup = f"backup_{datetime.now(UTC):%Y%m%d-%H%M%S-%f}"
        self.clusters.write.parquet(f"{self.folder}/{backup}/clusters")
        self._concepts().write.parquet(f"{self.folder}/{backup}/concepts")
        rows = self.clusters if run_id is None else self.clusters.where(F.col("run_id") == run_id)
        rows = rows.where("kind is not null and status in ('labelled', 'removed')").select("cluster_id", "status").collect()
        events = [e for r in rows for e in ([("reset", r["cluster_id"], annotator, {})] + ([("remove", r["cluster_id"], annotator, {})] if r["status"] == "removed" else []))]
        known = self._concepts().collect()
        gone = [c["name"] for c in known if concepts == "all" or (concepts == "annotator" and c["source"] != "dictionary")]
        events += [("concept_delete", None, annotator, {"name": n}) for n in gone]
        done = {"clusters": len(rows), "concepts_removed": len(gone), "concepts_left": len(known) - len(gone), "backup": backup}
        self.log(*events, ("reset_all", None, annotator, {"run": run_id, **done}))
        return done

    @_in_turn
    def merge(self, cluster_id: int, into: int, annotator: str) -> None:
        a, b = self._open(cluster_id), self._open(into)
        if cluster_id == into or a["run_id"] != b["run_id"]:
            raise AnnotationError("two clusters of one run are needed")
        self.log(("merge", cluster_id, annotator, {"into": into}))

    def _word(self, occ_id: int):
        row = self.occurrences.where(F.col("occ_id") == occ_id).first()
        if row is None:
            raise AnnotationError(f"no word {occ_id}")
        return row

    @_in_turn
    def remove_word(self, occ_id: int, annotator: str, restore: bool = False, cluster_id: int | None = None) -> None:
        """Take a word out of its cluster, which must be open, or put it back; cluster_id says which cluster that should be."""
        row = self._word(occ_id)
        if cluster_id is not None and row["cluster_id"] != cluster_id:
            raise AnnotationError(f"word {occ_id} is not in cluster {cluster_id}")
        self._open(row["cluster_id"])
        self.log(("word_restore" if restore else "word_remove", row["cluster_id"], annotator, {"occ": occ_id}))

    @_in_turn
    def move_word(self, occ_id: int, into: int, annotator: str) -> None:
        """Move a word between two open clusters of one run."""
        row = self._word(occ_id)
        if row["cluster_id"] == into:
            raise AnnotationError(f"word {occ_id} is in cluster {into} already")
        if self._open(row["cluster_id"])["run_id"] != self._open(into)["run_id"]:
            raise AnnotationError("words move within a run only")
        self.log(("word_move", row["cluster_id"], annotator, {"occ": occ_id, "into": into}))

    def _next_cluster(self, run: str) -> tuple[int, int]:
        """Ids go on over all runs, numbers within one."""
        top = self.base.agg(F.max("cluster_id").alias("c"), F.max(F.when(F.col("run_id") == run, F.col("number"))).alias("n")).first()
        return (top["c"] or 0) + 1, (top["n"] or 0) + 1

    @_in_turn
    def new_cluster(self, occ_ids: list[int], annotator: str) -> int:
        """A pending cluster of some words of open clusters of one run, numbered behind its last."""
        if not occ_ids:
            raise AnnotationError("a word is needed")
        sources = {o: self._word(o)["cluster_id"] for o in occ_ids}
        runs = {self._open(c)["run_id"] for c in set(sources.values())}
        if len(runs) != 1:
            raise AnnotationError("words of one run are needed")
        run = runs.pop()
        made, number = self._next_cluster(run)
        moves = [("word_move", sources[o], annotator, {"occ": o, "into": made}) for o in occ_ids]
        self.log(("create", made, annotator, {"run": run, "number": number}), *moves)
        return made

    @_in_turn
    def add_word(self, word: dict, annotator: str, into: int | None = None, run_id: str | None = None) -> tuple[int, int]:
        """Add a word (page, token, x0, y0, x1, y1) that no open cluster has, to an open cluster or to a new one of a run.

        A word that is there but removed, or in a cluster that isn't open, is
        moved instead, so it keeps its number. Returns the word's and the
        cluster's numbers.
        """
        here = self.occurrences.where((F.col("page") == word["page"]) & (F.col("token") == word["token"]))
        old = here.join(self.clusters.select("cluster_id", "status", "run_id", "number"), "cluster_id").collect()
        for r in old:
            if not r["removed"] and r["status"] in OPEN:
                raise AnnotationError(f"this word is in cluster {r['number']} already")
        run = self._open(into)["run_id"] if into is not None else run_id
        if run is None:
            raise AnnotationError("a cluster or a run is needed")
        events = []
        if into is None:
            into, number = self._next_cluster(run)
            events.append(("create", into, annotator, {"run": run, "number": number}))
        again = [r["occ_id"] for r in old if r["run_id"] == run]
        if again:
            occ = min(again)
            events.append(("word_move", into, annotator, {"occ": occ, "into": into}))
        else:
            occ = (self.occurrences.agg(F.max("occ_id")).first()[0] or 0) + 1
            events.append(("word_add", into, annotator, {"occ_id": occ, "candidate": word.get("candidate", word["token"]), **{k: word[k] for k in ("page", "token", "x0", "y0", "x1", "y1")}}))
        self.log(*events)
        return occ, into

    @_in_turn
    def apply_checks(self, cluster_id: int, checks: DataFrame, annotator: str) -> dict[str, int]:
        """Do what a check of fits (occ_id, verdict, best_target) says about the kept words of an open cluster: move or remove them, in one commit."""
        run = self._open(cluster_id)["run_id"]
        members = self.occurrences.where((F.col("cluster_id") == cluster_id) & (F.col("removed") == 0)).select("occ_id")
        rows = members.join(checks.select("occ_id", "verdict", "best_target"), "occ_id").where("verdict in ('move', 'remove')").orderBy("occ_id").collect()
        events = []
        for r in rows:
            if r["verdict"] == "move":
                if r["best_target"] == cluster_id or self._open(r["best_target"])["run_id"] != run:
                    raise AnnotationError("words move to other clusters of one run only")
                events.append(("word_move", cluster_id, annotator, {"occ": r["occ_id"], "into": r["best_target"]}))
            else:
                events.append(("word_remove", cluster_id, annotator, {"occ": r["occ_id"]}))
        if events:
            self.log(*events)
        return {v: sum(r["verdict"] == v for r in rows) for v in ("move", "remove")}

    @_in_turn
    def carry_over(self, from_run: str, to_run: str, annotator: str, least_iou: float = 0.5, least_share: float = 0.5) -> int:
        """Pending clusters of a run take the decisions of those of another run that cover them."""
        from pagemill.operators.joins import carried_over

        c = self.clusters
        words = self.occurrences.where("removed = 0").select("cluster_id", "page", "x0", "y0", "x1", "y1", F.col("occ_id").alias("item"))
        of = lambda rows: words.join(rows.select("cluster_id"), "cluster_id").withColumnRenamed("cluster_id", "cluster")
        old = of(c.where((F.col("run_id") == from_run) & F.col("status").isin("labelled", "removed")))
        new = of(c.where((F.col("run_id") == to_run) & (F.col("status") == "pending")))
        hits = carried_over(old.drop("item"), new, least_iou, least_share).join(c.withColumnRenamed("cluster_id", "old_cluster"), "old_cluster").collect()
        events = [
            ("assign", r["new_cluster"], annotator, {"concept": r["concept"], "value": r["name"], "source": r["name_source"]}) if r["status"] == "labelled" else ("remove", r["new_cluster"], annotator, {"reason": "carried over"})
            for r in hits
        ]
        if events:
            self.log(*events)
        return len(events)
