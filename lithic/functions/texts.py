"""Texts built from columns: prompts, scripts, reasoning targets, names, tags. Prompts and sentences are this engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import finite

#: What an edit prompt asks for, and the form of its answer.
EDIT_PROMPTS = {
    "repair_direction": ("Which direction frees object_b with the least movement?", "one of +x -x +y -y +z -z"),
    "repair_translation": ("Give the least separating move of object_b.", "<direction> <distance with six decimals>"),
    "axis_aligned_repair": ("Give the least exact move of object_b along an axis that ends the overlap.", "direction=<d>, distance_mm=<x.x>"),
    "axis_aligned_repair_vector": ("Give that least exact move as a vector.", "dx=<x.x>, dy=<x.x>, dz=<x.x>"),
    "axis_aligned_repair_program": ("Give that least exact move as a program line.", "object_b = object_b.translate((<x.x>, <x.x>, <x.x>))"),
    "target_clearance_repair": ("Give the least move along an axis that reaches the target clearance.", "direction=<d>, distance_mm=<x.x>"),
    "target_clearance_move": ("How far must object_b move along the allowed direction for the target clearance?", "distance_mm=<x.x>"),
    "target_contact_move": ("How far must object_b move along the allowed direction until it touches?", "distance_mm=<x.x>"),
    "centroid_distance_move": ("How far must object_b move along the line of centroids for the target distance?", "distance_mm=<x.x>"),
    "edit_candidate_selection": ("Which candidate edit is best?", "one of A B C D"),
    "edit_candidate_ranking": ("Rank the candidate edits from best to worst.", "four letters"),
}
#: Kinds of output by task, and the tags that edit rows may have.
OUTPUT_TAGS = {
    "repair_direction": "output_direction",
    "repair_translation": "output_axis_distance",
    "axis_aligned_repair": "output_axis_distance",
    "target_clearance_repair": "output_axis_distance",
    "target_clearance_move": "output_signed_distance",
    "target_contact_move": "output_signed_distance",
    "centroid_distance_move": "output_signed_distance",
    "axis_aligned_repair_vector": "output_vector",
    "axis_aligned_repair_program": "output_edit_program",
    "edit_candidate_selection": "output_candidate_selection",
    "edit_candidate_ranking": "output_candidate_ranking",
}
EDIT_TAGS = tuple(
    "axis_aligned_intersection_repair axis_aligned_intersection_repair_vector axis_aligned_intersection_repair_program conservative_axis_aligned_repair "
    "axis_aligned_target_clearance_repair axis_aligned_target_clearance_move axis_aligned_target_contact_move centroid_distance_move target_clearance_candidate_set "
    "candidate_selection candidate_ranking output_direction output_axis_distance output_signed_distance output_vector output_edit_program output_candidate_selection "
    "output_candidate_ranking ambiguous_direction move_closer move_farther move_none initial_axis_aligned initial_rotated initial_cavity_or_concavity initial_near_boundary "
    "initial_aabb_exact_disagreement counterfactual_edit_group multi_object_planned".split()
)


def _by_task(task: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(task == name, F.lit(text)).otherwise(out)
    return out


def edit_prompt(task: Column, script: Column, detail: Column | None = None) -> Column:
    """Question, script, detail (such as a target or candidates) and the form of the answer; null for other tasks."""
    ask, form = (_by_task(task, {t: p[k] for t, p in EDIT_PROMPTS.items()}) for k in (0, 1))
    lines = [ask, script, *([detail] if detail is not None else []), F.concat(F.lit("Answer with: "), form)]
    return F.when(task.isin(*EDIT_PROMPTS), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"))


def edit_tags(task: Column, difficulty: Column, move_kind: Column, ambiguous: Column, family: Column, counterfactual: Column, tags: Column) -> Column:
    """Sorted difficulty tags of an edit row; names outside the vocabulary are marked as unknown. Other rows have none."""
    known = lambda x: F.when(x.isin(*EDIT_TAGS), x)
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    found = [
        F.when(difficulty != "", F.when(difficulty.isin(*EDIT_TAGS), difficulty).otherwise(F.concat(F.lit("unknown:"), difficulty))),
        F.when(move_kind.isin("closer", "farther", "none"), F.concat(F.lit("move_"), move_kind)),
        F.when(ambiguous, "ambiguous_direction"),
        known(family),
        _by_task(task, OUTPUT_TAGS),
        F.when(counterfactual != "", "counterfactual_edit_group"),
        F.when(has("axis_aligned"), "initial_axis_aligned"),
        F.when(has("rotated"), "initial_rotated"),
        F.when(has("cavity_targeted", "compound_boolean"), "initial_cavity_or_concavity"),
        F.when(has("near_boundary"), "initial_near_boundary"),
        F.when(has("aabb_exact_disagreement"), "initial_aabb_exact_disagreement"),
    ]
    return F.when(task.isin(*OUTPUT_TAGS), F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))


def renamed_function(code: Column, old: Column, new: Column) -> Column:
    """The first `def old(` becomes `def new(`; code without it stops the run."""
    head, mark = F.concat(F.lit("def "), old, F.lit("(")), F.concat(F.lit("def "), new, F.lit("("))
    at = F.position(head, code)
    moved = F.concat(F.substr(code, F.lit(1), at - 1), mark, F.substr(code, at + F.length(head)))
    missing = F.raise_error(F.concat(F.lit("cannot rename "), old, F.lit(" to "), new)).cast("string")
    return F.when(old == new, code).when(at > 0, moved).otherwise(missing)


def source_subset(path: Column) -> Column:
    """The first two folders of a path that has more than two parts, else its first part."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def generator_id(path: Column, prefix: str) -> Column:
    slug = F.regexp_replace(source_subset(path), "[^A-Za-z0-9]+", "_")
    return F.concat(F.lit(prefix), F.lower(F.trim(slug, F.lit("_"))))


def normalized_path(path: Column) -> Column:
    """Slashes one way, without leading ./ or /."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")


def number_list(numbers: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *[x.cast("string") for x in numbers]), F.lit("]"))


def transform_block(a: tuple[list[Column], list[Column]], b: tuple[list[Column], list[Column]]) -> Column:
    """Translations and rotations of both objects, a line each."""
    lines = []
    for name, (move, turn) in (("object_a", a), ("object_b", b)):
        lines += [F.lit(f"{name}:"), F.concat(F.lit("  translation: "), number_list(move)), F.concat(F.lit("  rotation_xyz_deg: "), number_list(turn)), F.lit("  rotation_order: XYZ")]
    return F.concat_ws("\n", *lines)


def pair_code(a: Column, b: Column) -> Column:
    """Code of two objects under one import, ends trimmed."""
    return F.concat_ws("\n", F.lit("import cadquery as cq"), F.lit(""), F.trim(a, F.lit(" \t\r\n")), F.lit(""), F.trim(b, F.lit(" \t\r\n")), F.lit(""))


def assembly_script(code: Column, block: Column) -> Column:
    """Object code, then the placement as comments, set apart by a marker line."""
    return F.concat(F.trim(code, F.lit(" \t\r\n")), F.lit("\n\n# placement\n"), F.regexp_replace(block, "(?m)^", "# "))


def script_code(script: Column) -> Column:
    """The object code of a script: what stands before the placement."""
    return F.concat(F.split_part(script, F.lit("\n\n# placement\n"), F.lit(1)), F.lit("\n"))


def script_numbers(script: Column, kind: str) -> Column:
    """All `kind` triplets of a script's placement, in order, as arrays of doubles."""
    found = F.regexp_extract_all(script, F.lit(rf"{kind}: \[([^\]]*)\]"), F.lit(1))
    return F.transform(found, lambda x: F.transform(F.split(x, ",\\s*"), lambda y: y.cast("double")))


def indented_function(code: Column, name: str) -> Column:
    """Code as the body of a function, blank lines left empty."""
    body = F.regexp_replace(F.trim(code, F.lit(" \t\r\n")), r"(?m)^(?=.*\S)", "    ")
    return F.concat(F.lit(f"def {name}():\n"), body, F.lit("\n"))


#: Sentences of reasoning targets for tasks that need no numbers.
SENTENCES = {
    "binary_interference": "A shared volume means yes; contact or a gap means no.",
    "relation_classification": "Name the relation that the exact geometry has.",
    "volume_bucket": "Find the bucket that holds the shared part of the smaller volume.",
    "clearance_bucket": "Find the bucket that holds the gap.",
    "tolerance_fit": "Check the gap against the required clearance.",
    "pairwise_interference": "Check each variant for a shared volume.",
    "ranking_normalized_intersection": "Order the variants by shared volume, greatest first.",
    "edit_candidate_selection": "Prefer edits on target, then without overlap, then small ones.",
    "edit_candidate_ranking": "Order edits by target, overlap, then movement.",
}


def reasoning_sentence(task: Column, direction: Column, distance: Column) -> Column:
    """A short reason; direction and distance are of the selected edit, null if there is none."""
    moved = F.when(direction.isNotNull() & finite(distance), F.format_string("The least of the allowed moves is %s by %.1f mm.", direction, distance)).otherwise("Take the least of the allowed moves.")
    signed = F.when(finite(distance), F.format_string("The signed move that meets the target is %.1f mm.", distance)).otherwise("Take the signed move that meets the target.")
    edits = task.isin("repair_direction", "repair_translation", "axis_aligned_repair", "target_clearance_repair", "axis_aligned_repair_vector", "axis_aligned_repair_program")
    return F.coalesce(_by_task(task, SENTENCES), F.when(edits, moved).when(task.isin("target_clearance_move", "target_contact_move", "centroid_distance_move"), signed).otherwise("Apply the task's rule."))


def reasoning_target(task: Column, answer: Column, direction: Column, distance: Column) -> Column:
    return F.concat(F.lit("<think>"), reasoning_sentence(task, direction, distance), F.lit("</think><answer>"), answer, F.lit("</answer>"))


# Size categories of dataset cards.
SIZES = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"))


def size_category(n: Column) -> Column:
    out = F.lit("n>1M")
    for bound, name in reversed(SIZES):
        out = F.when(n < bound, name).otherwise(out)
    return out


MEANINGS = {"disjoint": "apart", "touching": "in contact", "near_miss": "a narrow gap", "intersecting": "sharing volume", "contained": "one inside the other", "invalid": "not measured"}
HOLDOUTS = {"test_random": "random groups", "test_generator_heldout": "whole generators", "test_object_pair_heldout": "whole pairs", "test_near_boundary": "groups near a boundary"}


def relation_meaning(rel: Column) -> Column:
    return F.coalesce(_by_task(rel, MEANINGS), F.lit("unknown"))


def holdout_rule(split: Column) -> Column:
    return F.coalesce(_by_task(split, HOLDOUTS), F.lit("none"))


def formatted_counts(names: Column, counts: Column) -> Column:
    """'a=1, b=2' of two arrays of one length."""
    return F.array_join(F.zip_with(names, counts, lambda a, n: F.concat(a, F.lit("="), n.cast("string"))), ", ")
