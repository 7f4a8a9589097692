"""Public rows, requests, training views and reports."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import labels as L
from ..functions import parsing as P
from ..functions import rewards as R
from . import evaluate as E

#: Prefixes of row ids by task.
VERSION = "v0.1"


def public_rows(records: DataFrame, template: str, split: Column, extras: dict[str, Column] | None = None) -> DataFrame:
    """Rows with their metadata struct. records: id, task_type, answer, prompt, script, geometry_id, group ids, relation, hashes.

    The split group is the first of counterfactual, assembly and pair group that is known; extras are more metadata.
    """
    group = F.coalesce("counterfactual_group_id", "assembly_group_id", "pair_id")
    metadata = F.struct(
        F.lit(template).alias("prompt_template_version"),
        group.alias("split_group"),
        F.col("strategy").alias("candidate_strategy"),
        F.coalesce(F.col("generator_ids"), F.array().cast("array<string>")).alias("generator_ids"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("topology_tags"),
        *[c.alias(k) for k, c in (extras or {}).items()],
    )
    return records.select(
        "id", F.lit(VERSION).alias("dataset_version"), split.alias("split"), "task_type", "prompt", "answer", F.array("geometry_id").alias("geometry_ids"),
        F.get("generator_ids", F.lit(0)).alias("generator_id"), "pair_id", "assembly_group_id", "counterfactual_group_id", "relation",
        C.row_hashes(F.col("hashes"), F.col("prompt"), F.col("task_type"), F.col("geometry_id"), F.lit(template)).alias("hashes"), metadata.alias("metadata"),
    )


def group_rows(records: DataFrame, group: str, order: str) -> DataFrame:
    """One row a group of a few records: ids in order, the first record's fields for the group's."""
    packed = records.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in records.columns if c != order]))).alias("records"))
    first = F.get("records", F.lit(0))
    return packed.select(group, F.transform("records", lambda r: r[order]).alias("ids"), first["relation"].alias("relation"), first["strategy"].alias("strategy"), F.transform("records", lambda r: r["relation"]).alias("relations"))


def pairwise_from(rows: DataFrame, group: str, key: str, relation: str) -> DataFrame:
    """A pairwise row anew from the first two rows of each group: (id, group, members, answer)."""
    two = rows.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(F.struct(key, relation))), 1, 2).alias("two")).where(F.size("two") == 2)
    a, b = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    return two.select(F.concat(F.lit("pairwise_"), F.col(group).cast("string")).alias("id"), group, F.array(a[key], b[key]).alias("members"), L.pairwise_answer(a[relation], b[relation]).alias("answer"))


def messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def few_shot_text(examples: Column, prompt: Column) -> Column:
    """examples: array of (prompt, answer). Numbered examples, then the prompt in question."""
    shown = F.array_join(F.transform(examples, lambda e, i: F.format_string("Example %d\nPrompt:\n%s\nAnswer:\n%s", i + 1, e["prompt"], e["answer"])), "\n\n")
    target = F.concat(F.lit("Target prompt:\n"), prompt)
    return F.when(F.size(examples) > 0, F.concat(shown, F.lit("\n\n"), target)).otherwise(target)


def requests(rows: DataFrame, system: str, user: Column, model: str, version: str, decoding: dict[str, float]) -> DataFrame:
    """(id, model, eval_version, messages, eval_request_hash): the hash is of the request's canonical JSON."""
    text = messages(system, user)
    out = rows.select("id", F.lit(model).alias("model"), F.lit(version).alias("eval_version"), text.alias("messages"))
    said = F.transform("messages", lambda m: C.json_object(role=C.quoted(m["role"]), content=C.quoted(m["content"])))
    name = C.quoted(F.col("id")) if dict(rows.dtypes)["id"] == "string" else F.coalesce(F.col("id").cast("string"), F.lit("null"))
    body = C.json_object(id=name, model=model, eval_version=version, messages=C.json_array(said), decoding={k: float(v) for k, v in decoding.items()})
    return out.withColumn("eval_request_hash", C.sha256_text(body))


class ModelClient(Protocol):
    """Where completions come from: a frame of requests in, (id, output) out."""

    def complete(self, requests: DataFrame) -> DataFrame: ...


class Replay:
    """A client that answers from a table of stored completions."""

    def __init__(self, completions: DataFrame):
        self.completions = completions

    def complete(self, requests: DataFrame) -> DataFrame:
        return E.keyed(requests.select("id"), self.completions.select("id", "output"), "id")


def evaluated(rows: DataFrame, request: Callable[[DataFrame], DataFrame], client: ModelClient) -> DataFrame:
    """Requests to a client, its completions scored against the rows."""
    return E.scored(rows, client.complete(request(rows)))


def run_report(scored: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """One row: rows, predictions, splits and tasks seen, and the accuracies by task."""
    by = scored.groupBy("task_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("n_correct"), F.collect_set("split").alias("splits"))
    seen = by.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("row_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("splits")))).alias("splits"),
        F.array_sort(F.collect_set("task_type")).alias("task_types"),
        F.array_sort(F.collect_list(F.struct("task_type", "total", "n_correct"))).alias("metrics"),
    )
    n = predictions.agg(F.count(F.lit(1)).alias("prediction_count"))
    return seen.crossJoin(n).select(F.lit(model).alias("model"), "row_count", "prediction_count", "splits", "task_types", "metrics")  # one row each


def known_predictions(predictions: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Predictions that have a row, with its task, answer and the reward's verdict."""
    return E.keyed(predictions, rows, key).withColumn("correct", F.coalesce(P.parse_answer(F.col("task_type"), P.candidate(F.col("output"))) == F.col("answer"), F.lit(False)))


#: Columns that only supervision has; the public view is without them.
SUPERVISION = ("target_text", "canonical_answer", "supervision")


def sft_rows(rows: DataFrame, target: Column, source: str) -> DataFrame:
    """Rows with the text to learn, the answer alone, and where the text comes from."""
    supervision = F.struct(F.lit("think_answer_v01").alias("target_text_format"), F.lit(source).alias("target_text_source"))
    return rows.withColumns({"target_text": target, "canonical_answer": F.col("answer"), "supervision": supervision})


def public_view(rows: DataFrame) -> DataFrame:
    return rows.drop(*SUPERVISION)


def grpo_rows(rows: DataFrame) -> DataFrame:
    """(id, prompt as messages, answer, task_type) of the public view."""
    user = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return public_view(rows).select("id", user.alias("prompt"), "answer", "task_type")


def reward(task: Column, gold: Column, output: Column) -> Column:
    """One entry for all tasks whose reward needs the answer texts only: edits in part, other answers all or nothing."""
    mine = P.parse_answer(P.require_known(task), P.candidate(output))
    value = (
        F.when(task.isin("axis_aligned_repair", "target_clearance_repair"), R.axis_reward(gold, mine))
        .when(task == "axis_aligned_repair_vector", R.vector_reward(gold, mine))
        .when(task.isin("target_clearance_move", "target_contact_move", "centroid_distance_move"), R.signed_reward(gold, mine))
        .when(task == "edit_candidate_ranking", R.ranking_reward(gold, mine))
        .otherwise(R.flag(gold == mine))
    )
    return R.final(value, output, mine)


def failure_cases(rows: DataFrame, validations: DataFrame, failures: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """(section, name, n): what a failure report counts. Each table is counted once, by all that its sections ask for."""
    n = F.count(F.lit(1)).alias("n")
    cell = lambda section, name: F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"))
    each = lambda counts, *cells: counts.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())), "n")
    total = lambda name: cell("summary", F.lit(name))
    bad, reason = ~F.coalesce("valid", F.lit(False)), F.col("reason")
    out = rows.sparkSession.createDataFrame([("summary", x, 0) for x in ("rows", "validations", "invalid_validations", "failures")], "section string, name string, n long")
    checks = validations.groupBy(bad.alias("bad"), reason).agg(n)
    out = out.unionByName(each(checks, total("validations"), F.when(F.col("bad"), total("invalid_validations")), F.when(F.col("bad"), cell("validation_failures", reason))))
    out = out.unionByName(each(failures.groupBy(reason).agg(n), total("failures"), cell("generation_failures", reason)))
    if scored is not rows:
        out = out.unionByName(each(rows.agg(n), total("rows")))
    if scored is not None:
        kind = F.when(F.col("correct"), None).when(F.col("parsed").isNull(), "invalid").otherwise("incorrect")
        verdicts = scored.groupBy("task_type", kind.alias("kind")).agg(n)
        wrong = F.col("kind").isNotNull()
        own = [total("rows")] if scored is rows else []
        out = out.unionByName(each(verdicts, *own, F.when(wrong, cell("prediction_failures", F.col("kind"))), F.when(wrong, cell("failures_by_task", F.col("task_type")))))
    return out.groupBy("section", "name").agg(F.sum("n").alias("n"))


def first_failures(scored: DataFrame, order: str, k: int = 20) -> DataFrame:
    """The first k wrong rows in row order."""
    return scored.where(~F.col("correct")).orderBy(order).limit(k)


def verified_move(direction: Column, distance: Column) -> dict[str, Column]:
    """Bounds of b after a move along a cardinal direction; columns a_min_x ... b_max_z are read."""
    sign = F.when(F.substring(direction, 1, 1) == "-", -distance).otherwise(distance)
    out = {}
    for axis in "xyz":
        shift = F.when(F.substring(direction, 2, 1) == axis, sign).otherwise(0.0)
        out |= {f"b_{end}_{axis}": F.col(f"b_{end}_{axis}") + shift for end in ("min", "max")}
    return out


def source_shards(counts: DataFrame, source: str, n: str, size: int) -> DataFrame:
    """Fixed windows over each source: (source, shard, offset, rows)."""
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / size))
    each = counts.where(F.col(n) > 0).select(source, n, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("shard"))
    return each.select(source, "shard", (F.col("shard") * size).alias("offset"), F.least(F.lit(size).cast("long"), F.col(n) - F.col("shard") * size).alias("rows"))


def unfinished(shards: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    """Shards whose last status isn't done and checked; progress is (keys..., at, status)."""
    last = progress.groupBy(*keys).agg(F.max_by("status", "at").alias("status"))
    return shards.join(last.where("status = 'validated'"), keys, "left_anti")
