"""Runs of all configurations of components, each shared step once.

A configuration names a chunker, a retriever, a generator and a judge. Steps are a tree: a chunker's chunks serve all retrievers on them, what one retriever found serves all generators, and their answers
all judges. Each distinct beginning of a configuration is evaluated and written once, whatever the number of configurations that share it; a model is asked once for each example
and beginning that ends with it. Result rows name their configuration; configurations that are equal in all four have the same rows under each one's own name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.sources.tables import kept

from . import judging, summary

STEPS = ("chunker", "retriever", "generator", "judge")


class Components(NamedTuple):
    """chunkers: documents -> chunks; retrievers: (chunks, examples) -> example_id, rank, chunk_id, chunk_text; generators, judges: model functions; all by name."""

    chunkers: Mapping[str, Callable[[DataFrame], DataFrame]]
    retrievers: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]]
    generators: Mapping[str, Callable]
    judges: Mapping[str, Callable]


def all_configs(components: Components) -> list[dict[str, str]]:
    """Every combination, each under the name of its parts joined by underscores."""
    found = [()]
    for each in components:
        found = [(*x, name) for x in found for name in each]
    return [{"config": "_".join(x), **dict(zip(STEPS, x, strict=True))} for x in found]


def evaluate_grid(configs: Sequence[Mapping[str, str]], examples: DataFrame, documents: DataFrame, components: Components, k: int = 5, keep: Callable[[DataFrame], DataFrame] = kept, call: Callable = judging.call_model, **options) -> DataFrame:
    """Flat result rows of every configuration (config: its name, and the four steps), as `summary.evaluate` gives them for one; run_id is the name. options: those of `evaluate`."""
    named = [c["config"] for c in configs]
    if not configs or len(set(named)) < len(named):
        raise ValueError("configurations need names of their own" if configs else "no configuration")
    for step, known in zip(STEPS, components, strict=True):
        if unknown := {c[step] for c in configs} - set(known):
            raise ValueError(f"no {step} {', '.join(sorted(unknown))}")
    done: dict[tuple[str, ...], DataFrame] = {}

    def once(path: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
        if path not in done:
            done[path] = make()
        return done[path]

    out = []
    for path in dict.fromkeys(tuple(c[s] for s in STEPS) for c in configs):
        chunker, retriever, generator, judge = path
        chunks = once(path[:1], lambda: keep(components.chunkers[chunker](documents)))  # noqa: B023  called at once
        retrieved = once(path[:2], lambda: keep(components.retrievers[retriever](chunks, examples)))  # noqa: B023
        answers = once(path[:3], lambda: summary.generate_answers(examples, retrieved, components.generators[generator], keep, k, call))  # noqa: B023
        rows = keep(summary.judge_answers(answers, retrieved, components.judges[judge], keep, "", k, call=call, **options))
        mine = F.array(*(F.lit(c["config"]) for c in configs if tuple(c[s] for s in STEPS) == path))
        out.append(rows.withColumn("config", F.explode(mine)).withColumns({"run_id": F.col("config"), **{s: F.lit(x) for s, x in zip(STEPS, path, strict=True)}}))
    return summary.union_all(out)


def compare_grid(rows: DataFrame, metric: str = "recall_at_k") -> DataFrame:
    """Mean metrics of each configuration, and which is best; see `summary.component_grid`."""
    return summary.component_grid(rows, STEPS, metric)
