"""Contracts of public rows: answers recomputed from labels and edit metadata, as named rules.

A rule is true where a row breaks it; labels.broken() lists the names. Tolerances are 1e-9, absolute or relative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L
from .materialized import ranked_labels

# Directions in tie-break order, policies, and the tasks that need an overlap or none.
DIRECTIONS = ("+x", "-x", "+y", "-y", "+z", "-z")
REPAIR_POLICY = "conservative_aabb_separating_translation_v01"
EDIT_POLICY = "exact_axis_aligned_cardinal_search_v01"
CENTROID_POLICY = "exact_centroid_direction_move_v01"
NEED_OVERLAP = ("repair_direction", "repair_translation", "axis_aligned_repair", "target_clearance_repair", "axis_aligned_repair_vector", "axis_aligned_repair_program")
NEED_GAP = ("target_clearance_move", "target_contact_move")


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1e-9), 1e-9 * F.greatest(F.abs(a), F.abs(b)))


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def l1(v: Column) -> Column:
    return F.abs(v[0]) + F.abs(v[1]) + F.abs(v[2])


def l2(v: Column) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def along(direction: Column, v: Column) -> Column:
    """Whether a vector points along a cardinal direction and nowhere else; a vector of no length does."""
    out = F.lit(False)
    for name in DIRECTIONS:
        k, sign = "xyz".index(name[1]), 1 if name[0] == "+" else -1
        rest = [F.abs(v[i]) <= 1e-9 for i in range(3) if i != k]
        out = F.when(direction == name, (sign * v[k] >= -1e-9) & rest[0] & rest[1]).otherwise(out)
    return out


def vector(direction: Column, magnitude: Column) -> Column:
    """The vector of a move along a cardinal direction."""
    sign = F.when(F.substring(direction, 1, 1) == "+", magnitude).otherwise(-magnitude)
    return F.array(*[F.when(F.substring(direction, 2, 1) == a, sign).otherwise(F.lit(0.0)) for a in "xyz"])


def row_rules(c: dict[str, Column]) -> dict[str, Column]:
    """c: task, answer, relation, norm, distance, required_mm, status, geometry_ids, prompt_hash, hashes (array)."""
    task, answer, rel = c["task"], c["answer"], c["relation"]

    def wrong(name: str, expected: Column) -> Column:
        return (task == name) & differs(answer, expected)

    return {
        "no_geometry": F.coalesce(F.size(c["geometry_ids"]), F.lit(0)) <= 0,
        "label_status": c["status"] != "ok",
        "binary_answer": wrong("binary_interference", L.binary_answer(rel)) | ((task == "binary_interference") & (rel == "invalid")),
        "relation_answer": wrong("relation_classification", rel),
        "volume_bucket_answer": wrong("volume_bucket", L.volume_bucket(c["norm"])),
        "clearance_bucket_answer": wrong("clearance_bucket", L.clearance_bucket(rel, c["distance"])),
        "tolerance_answer": wrong("tolerance_fit", L.tolerance_fit(c["distance"], 1.0)) if "required_mm" not in c else wrong("tolerance_fit", L.tolerance_fit(c["distance"], c["required_mm"])),
        "needs_overlap": task.isin(*NEED_OVERLAP) & ~rel.isin(*L.OVERLAPS),
        "needs_gap": task.isin(*NEED_GAP) & ~rel.isin("disjoint", "near_miss"),
        "needs_no_overlap": (task == "centroid_distance_move") & ~rel.isin("disjoint", "near_miss", "touching"),
        "prompt_hash": c["prompt_hash"].isNull(),
        "hashes": F.exists(c["hashes"], lambda h: h.isNull()),
    }


def group_rules(task: Column, answer: Column, relations: Column, norms: Column) -> dict[str, Column]:
    """Answers over variants: relations of the two of a pair, normalised volumes of the up to five of a ranking."""
    first, second = F.get(relations, F.lit(0)), F.get(relations, F.lit(1))
    ranked = F.array_sort(F.transform(norms, lambda v, i: F.struct((-v).alias("v"), F.char(F.lit(65) + i).alias("letter"))))
    return {
        "pairwise_answer": (task == "pairwise_interference") & differs(answer, L.pairwise_answer(first, second)),
        "ranking_answer": (task == "ranking_normalized_intersection") & differs(answer, F.array_join(F.transform(ranked, lambda x: x["letter"]), "")),
    }


def repair_rules(m: Column, task: Column, answer: Column) -> dict[str, Column]:
    """m: policy, movable, fixed, selected (direction, magnitude, vector), candidates (array of the same)."""
    s, cands = m["selected"], m["candidates"]
    rank = lambda d: F.array_position(F.array(*map(F.lit, DIRECTIONS)), d)
    least = F.array_min(F.transform(cands, lambda x: F.struct(x["magnitude"].alias("m"), rank(x["direction"]).alias("r"), x["direction"].alias("d"))))
    own = F.get(F.filter(cands, lambda x: x["direction"] == s["direction"]), F.lit(0))
    text = F.when(task == "repair_translation", F.format_string("%s %.6f", s["direction"], s["magnitude"])).otherwise(s["direction"])
    return {
        "policy": differs(m["policy"], F.lit(REPAIR_POLICY)),
        "objects": differs(m["movable"], F.lit("object_b")) | differs(m["fixed"], F.lit("object_a")),
        "selected_direction": ~F.coalesce(s["direction"].isin(*DIRECTIONS), F.lit(False)),
        "magnitude_differs": ~close(s["magnitude"], l1(s["vector"])),
        "vector_direction": ~along(s["direction"], s["vector"]),
        "six_candidates": F.size(cands) != 6,
        "directions_repeat": F.size(F.array_distinct(F.transform(cands, lambda x: x["direction"]))) != F.size(cands),
        "candidate_magnitude": F.exists(cands, lambda x: ~close(x["magnitude"], l1(x["vector"])) | (x["magnitude"] < 0)),
        "candidate_direction": F.exists(cands, lambda x: ~along(x["direction"], x["vector"])),
        "selected_not_least": differs(least["d"], s["direction"]),
        "selected_vector_differs": differs(own["vector"], s["vector"]),
        "answer": differs(answer, text),
    }


def exact_rules(m: Column, task: Column, answer: Column) -> dict[str, Column]:
    """m: policy, movable, fixed, direction, exact, label, vector, structured (direction, distance, translation), satisfies, target."""
    v = m["vector"]
    program = F.format_string("object_b = object_b.translate((%.1f, %.1f, %.1f))", v[0], v[1], v[2])
    text = F.when(task == "axis_aligned_repair_vector", F.format_string("dx=%.1f, dy=%.1f, dz=%.1f", v[0], v[1], v[2])).when(task == "axis_aligned_repair_program", program)
    return {
        "policy": differs(m["policy"], F.lit(EDIT_POLICY)),
        "objects": differs(m["movable"], F.lit("object_b")) | differs(m["fixed"], F.lit("object_a")),
        "selected_direction": ~F.coalesce(m["direction"].isin(*DIRECTIONS), F.lit(False)),
        "undershoots": m["label"] + 1e-9 < m["exact"],
        "magnitude_differs": ~close(m["label"], l1(v)),
        "vector_direction": ~along(m["direction"], v),
        "structured_direction": differs(m["structured"]["direction"], m["direction"]),
        "structured_distance": ~close(m["structured"]["distance"], m["label"]),
        "structured_translation": F.exists(F.zip_with(m["structured"]["translation"], v, lambda a, b: ~close(a, b)), lambda x: x),
        "not_satisfied": ~F.coalesce(m["satisfies"], F.lit(False)),
        "target": ~F.coalesce(m["target"].isin("non_intersection", "clearance"), F.lit(False)),
        "answer": differs(answer, text.otherwise(F.format_string("direction=%s, distance_mm=%.1f", m["direction"], m["label"]))),
    }


def signed_rules(m: Column, answer: Column) -> dict[str, Column]:
    """Moves by a signed distance. m: policy, direction_vector (of unit length), signed, exact, vector, structured_distance, satisfies, target, wanted_target, wanted_policy."""
    d, v = m["direction_vector"], m["vector"]
    return {
        "policy": differs(m["policy"], m["wanted_policy"]),
        "unit_direction": ~close(l2(d), F.lit(1.0)),
        "too_far_from_exact": F.abs(m["signed"] - m["exact"]) > 0.2,
        "magnitude_differs": ~close(F.abs(m["signed"]), l2(v)),
        "vector_direction": F.exists(F.zip_with(d, v, lambda a, b: ~close(a * m["signed"], b)), lambda x: x),
        "structured_distance": ~close(m["structured_distance"], m["signed"]),
        "not_satisfied": ~F.coalesce(m["satisfies"], F.lit(False)),
        "target": differs(m["target"], m["wanted_target"]),
        "answer": differs(answer, F.format_string("distance_mm=%.1f", m["signed"])),
    }


def candidate_rules(candidates: Column, stored: Column, task: Column, answer: Column) -> dict[str, Column]:
    """candidates: array of (label, direction, magnitude, movement, vector, satisfies, no_interference, error)."""
    labels = F.array_sort(F.transform(candidates, lambda x: x["label"]))
    ranked = ranked_labels(candidates)
    expected = F.when(task == "edit_candidate_selection", F.substring(ranked, 1, 1)).otherwise(ranked)
    return {
        "four_candidates": differs(labels, F.array(*map(F.lit, "ABCD"))),
        "candidate_direction": F.exists(candidates, lambda x: ~F.coalesce(x["direction"].isin(*DIRECTIONS), F.lit(False)) | ~along(x["direction"], x["vector"])),
        "movement_differs": F.exists(candidates, lambda x: ~close(x["magnitude"], x["movement"])),
        "magnitude_differs": F.exists(candidates, lambda x: ~close(x["magnitude"], l1(x["vector"]))),
        "flags_missing": F.exists(candidates, lambda x: x["satisfies"].isNull() | x["no_interference"].isNull()),
        "stored_answer": differs(stored, expected),
        "answer": differs(answer, expected),
    }
