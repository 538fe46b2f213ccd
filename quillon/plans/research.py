"""The research loop: bounded passes over injected stages, and the run of the whole flow.

Stages are functions of DataFrames, so a step that needs a model is a table of its output or a
function that the caller supplies. ``run_session`` keeps a log of the phases that are done in the
session's folder, each entry written after its data: an interrupted run goes on at the phase at which
it stopped, and no phase that is done is called again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.config import BUDGETS, DEFAULT, TARGETS, Config
from quillon.lineage import kept
from quillon.operators import claims as C
from quillon.sources import fs

Stage = Callable[[str, int], DataFrame]


@dataclass
class Result:
    """What a call of the public API gives: ``ok``, data, or an error's text."""

    ok: bool
    data: dict = field(default_factory=dict)
    error: str | None = None


def called(f: Callable, *args, **options) -> Result:
    """Any exception becomes an error; a dictionary is the data, anything else its ``result``."""
    try:
        out = f(*args, **options)
    except Exception as e:  # noqa: BLE001  the wrapper's purpose
        return Result(False, error=f"{type(e).__name__}: {e}")
    return Result(True, out if isinstance(out, dict) else {"result": out})


def phases(depth: str) -> list[str]:
    return ["acquire", *(["mid_acquire"] if depth == "deep" else []), "extract", "verify"]


def research_subtopic(ledger: DataFrame, subtopic: str, stage: Stage, depth: str = "normal", config: Config = DEFAULT, done: int = 0) -> tuple[DataFrame, int]:
    """(ledger, passes) after the passes of one subtopic: each gives raw claims, which the policy
    judges anew and the ledger takes if their ids are new. A pass's counts are two numbers."""
    target, budget = TARGETS.get(depth, TARGETS["normal"]), BUDGETS.get(depth, config.fallback_budget)
    passes, new = done, 0
    while True:
        have = ledger.where(F.col("subtopic_id") == subtopic).agg(F.count_if(F.col("status") == "kept")).first()[0]
        if have >= target or passes >= budget or (passes >= 1 and new < config.min_new_claims):
            return ledger, passes
        before = ledger.count()
        ledger = kept(C.merge(ledger, C.enrich(stage(subtopic, passes), config=config)))
        new, passes = ledger.count() - before, passes + 1


class RunLog:
    """The durable log of a session: a file for each phase that is done, named by subtopic, pass and phase,
    with the place of the phase's data and what is to be remembered of it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.done = {}
        for name in fs.names(spark, f"{self.folder}/log"):
            if name.endswith(".json"):
                entry = json.loads(fs.read_text(spark, f"{self.folder}/log/{name}"))
                self.done[tuple(entry["key"])] = entry

    def phase(self, key: tuple, make: Callable[[], DataFrame], facts: Callable[[DataFrame], dict] | None = None) -> tuple[DataFrame, dict]:
        """The data of a phase and its facts: read if it is done, else made, written and entered."""
        if key not in self.done:
            path = f"{self.folder}/data/{uuid.uuid4().hex}"
            made = make()
            made.write.parquet(path)
            data = self.spark.read.schema(made.schema).parquet(path)
            entry = {"key": list(key), "path": path, "schema": json.loads(data.schema.json()), "facts": facts(data) if facts else {}}
            fs.write_new(self.spark, f"{self.folder}/log/{len(self.done):08d}-{uuid.uuid4().hex[:8]}.json", json.dumps(entry))
            self.done[key] = entry
        entry = self.done[key]
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"]), entry["facts"]

    def mark(self, key: tuple, act: Callable[[], None]) -> None:
        """``act`` once, but for a run that ends between it and its entry."""
        if key not in self.done:
            act()
            entry = {"key": list(key), "facts": {}}
            fs.write_new(self.spark, f"{self.folder}/log/{len(self.done):08d}-{uuid.uuid4().hex[:8]}.json", json.dumps(entry))
            self.done[key] = entry


#: A phase: subtopic, pass and the data of the phase before it (none for the first) to its data.
Phase = Callable[[str, int, DataFrame | None], DataFrame]


def run_session(folder: str, ledger: DataFrame, subtopics: list[str], stages: dict[str, Phase], depth: str = "normal", milestone: Callable[[str, DataFrame], None] | None = None, config: Config = DEFAULT) -> tuple[DataFrame, dict[str, int]]:
    """(ledger, passes of each subtopic) after the passes of every subtopic: each pass runs the phases of
    ``depth`` that ``stages`` has, of which the last gives raw claims; the policy judges them and the ledger takes the new ones.
    ``ledger`` is what a new session begins with. Called again on the same folder after a failure, it goes on
    where it stopped."""
    log, passes = RunLog(ledger.sparkSession, folder), {}
    target, budget = TARGETS.get(depth, TARGETS["normal"]), BUDGETS.get(depth, config.fallback_budget)

    def facts(subtopic: str, before: int) -> Callable[[DataFrame], dict]:
        def count(now: DataFrame) -> dict:
            rows, have = now.agg(F.count("*"), F.count_if((F.col("subtopic_id") == subtopic) & (F.col("status") == "kept"))).first()
            return {"rows": rows, "kept": have, "new": rows - before}

        return count

    ledger, known = log.phase(("", -1, "begin"), lambda: ledger, facts("", 0))
    for s in subtopics:
        passes[s], state = 0, known | {"kept": ledger.where((F.col("subtopic_id") == s) & (F.col("status") == "kept")).count(), "new": 0}
        while not (state["kept"] >= target or passes[s] >= budget or (passes[s] >= 1 and state["new"] < config.min_new_claims)):
            data = None
            for name in [p for p in phases(depth) if p in stages]:
                data, _ = log.phase((s, passes[s], name), lambda: stages[name](s, passes[s], data))  # noqa: B023
            before = ledger
            ledger, state = log.phase((s, passes[s], "merge"), lambda: C.merge(before, C.enrich(data, config=config)), facts(s, state["rows"]))  # noqa: B023
            passes[s] += 1
        known = state
        if milestone:
            log.mark((s, -1, "milestone"), lambda: milestone(s, ledger))  # noqa: B023
    return ledger, passes


def research(ledger: DataFrame, subtopics: list[str], stage: Stage, depth: str = "normal", milestone: Callable[[str, DataFrame], None] | None = None, config: Config = DEFAULT) -> tuple[DataFrame, dict[str, int]]:
    """Every subtopic in turn; ``milestone`` is called once after each."""
    passes = {}
    for s in subtopics:
        ledger, passes[s] = research_subtopic(ledger, s, stage, depth, config)
        if milestone:
            milestone(s, ledger)
    return ledger, passes
