"""Relation labels, answers and buckets from raw measurements, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelPolicy:
    volume_ratio: float = 1e-6
    touching_mm: float = 1e-4
    near_miss_mm: float = 1.0

    def epsilon_volume(self, va: Column, vb: Column) -> Column:
        return F.lit(self.volume_ratio) * F.least(va, vb)


POLICY = LabelPolicy()
# Relations in precedence of reports, and the bounds of buckets.
RELATIONS = ("disjoint", "touching", "near_miss", "intersecting", "contained", "invalid")
OVERLAPS = ("intersecting", "contained")
VOLUME_BOUNDS = ((0.01, "(0, 0.01]"), (0.05, "(0.01, 0.05]"), (0.20, "(0.05, 0.20]"), (0.50, "(0.20, 0.50]"))
CLEARANCE_BOUNDS = ((0.1, "(0, 0.1]"), (1.0, "(0.1, 1]"), (5.0, "(1, 5]"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def positive(x: Column) -> Column:
    return finite(x) & (x > 0)


def not_negative(x: Column) -> Column:
    return finite(x) & (x >= 0)


def normalized_intersection(va: Column, vb: Column, iv: Column) -> Column:
    """Share of the smaller volume; null unless both volumes are positive and the intersection finite."""
    return F.when(positive(va) & positive(vb) & finite(iv), F.try_divide(iv, F.least(va, vb)))


def relation(va: Column, vb: Column, iv: Column, distance: Column, a_in_b: Column, b_in_a: Column, boolean_status: Column, distance_status: Column, policy: LabelPolicy = POLICY) -> Column:
    """The relation of two placed objects; the first rule that holds decides."""
    overlap = iv > policy.epsilon_volume(va, vb)
    inside = F.coalesce(a_in_b, F.lit(False)) | F.coalesce(b_in_a, F.lit(False))
    return (
        F.when(~(positive(va) & positive(vb)), "invalid")
        .when(~not_negative(iv), "invalid")
        .when(~F.coalesce(boolean_status.isin("ok", "skipped_aabb_disjoint"), F.lit(False)), "invalid")
        .when(inside & overlap, "contained")
        .when(inside, "invalid")
        .when(overlap, "intersecting")
        .when(~(F.coalesce(distance_status == "ok", F.lit(False)) & not_negative(distance)), "invalid")
        .when(distance <= policy.touching_mm, "touching")
        .when(distance <= policy.near_miss_mm, "near_miss")
        .otherwise("disjoint")
    )


def interferes(rel: Column) -> Column:
    return F.coalesce(rel.isin(*OVERLAPS), F.lit(False))


def binary_answer(rel: Column) -> Column:
    return F.when(rel.isin(*OVERLAPS), "yes").when(rel.isin("disjoint", "touching", "near_miss"), "no")


def volume_bucket(norm: Column) -> Column:
    """Upper bounds belong to their bucket."""
    out = F.when(norm <= 0, "0")
    for bound, name in VOLUME_BOUNDS:
        out = out.when(norm <= bound, name)
    return out.when(norm.isNotNull(), ">0.50")


def clearance_bucket(rel: Column, distance: Column, policy: LabelPolicy = POLICY) -> Column:
    out = F.when(interferes(rel), "intersecting").when((rel == "touching") | (distance <= policy.touching_mm), "touching")
    for bound, name in CLEARANCE_BOUNDS:
        out = out.when(distance <= bound, name)
    return out.when(distance.isNotNull(), ">5")


def tolerance_fit(distance: Column, required_mm: float | Column, policy: LabelPolicy = POLICY) -> Column:
    return F.when(distance <= policy.touching_mm, "no").when(distance >= required_mm, "yes").otherwise("no")


def pairwise_answer(first: Column, second: Column) -> Column:
    a, b = interferes(first), interferes(second)
    return F.when(a & b, "both").when(a, "A").when(b, "B").otherwise("neither")


def label_rules(c: dict[str, Column], policy: LabelPolicy = POLICY) -> dict[str, Column]:
    """Rule name -> true where a row breaks it. c: va, vb, iv, norm, distance, relation, exact_overlap, aabb, a_in_b, b_in_a, status."""
    eps = policy.epsilon_volume(c["va"], c["vb"])
    rel, over = c["relation"], c["relation"].isin(*OVERLAPS)
    return {
        "status_needs_invalid": (c["status"] != "ok") & (rel != "invalid"),
        "volume_a_positive": ~(c["va"] > 0),
        "volume_b_positive": ~(c["vb"] > 0),
        "intersection_negative": c["iv"] < 0,
        "normalized_negative": c["norm"] < 0,
        "normalized_above_one": c["norm"] > 1 + policy.volume_ratio,
        "exact_overlap_differs": c["exact_overlap"] != (c["iv"] > eps),
        "overlap_without_aabb": (c["iv"] > eps) & ~c["aabb"],
        "contact_without_aabb": ~c["aabb"] & (c["distance"] <= policy.touching_mm),
        "relation_without_overlap": over & ~(c["iv"] > eps),
        "contained_without_flag": (rel == "contained") & ~(c["a_in_b"] | c["b_in_a"]),
        "contained_volume_differs": (rel == "contained") & (F.abs(c["iv"] - F.least(c["va"], c["vb"])) > eps),
        "touching_distance": (rel == "touching") & (c["distance"] > policy.touching_mm),
        "near_miss_distance": (rel == "near_miss") & ~((c["distance"] > policy.touching_mm) & (c["distance"] <= policy.near_miss_mm)),
        "disjoint_distance": (rel == "disjoint") & ~(c["distance"] > policy.near_miss_mm),
    }


def broken(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that a row breaks; an unknown outcome breaks nothing."""
    names = F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()])
    return F.array_sort(F.filter(names, lambda x: x.isNotNull()))
