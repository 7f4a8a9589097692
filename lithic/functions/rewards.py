"""Partial-credit rewards of edit answers, row by row. The weights are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parsing as P

TOLERANCE = 0.15


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def flag(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)


def fine(error: Column, tolerance: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - error / (4 * tolerance))


def coarse(expected: Column, mine: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(mine - expected) / F.greatest(F.abs(expected), F.abs(mine), F.lit(1.0)))


def movement(expected: Column, mine: Column, target: Column | None = None) -> Column:
    """Credit falls with how far a move goes beyond the expected one."""
    reference = F.greatest(expected, F.coalesce(target, F.lit(0.0)) if target is not None else F.lit(0.0), F.lit(1e-9))
    return F.when(mine < 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), mine - expected) / reference))


def final(reward: Column, output: Column, parsed: Column) -> Column:
    """Times the format score, at least a twentieth of it; an invalid answer gets a little for an answer element alone."""
    score = P.format_score(output)
    scaffold = F.when(P.has_tag(output), 0.03 + 0.02 * flag(P.has_reasoning(output))).otherwise(0.0)
    return F.when(parsed.isNull(), scaffold).otherwise(F.greatest(clamp(reward * score), 0.05 * score))


def axis_reward(gold: Column, mine: Column, tolerance: float = TOLERANCE) -> Column:
    (ed, e), (pd, p) = P.axis_parts(gold), P.axis_parts(mine)
    d, error = flag(ed == pd), F.abs(p - e)
    return 0.10 + 0.30 * d + 0.35 * fine(error, tolerance) * d + 0.15 * movement(e, p) * d + 0.10 * d * flag(error <= tolerance)


def signed_reward(gold: Column, mine: Column, tolerance: float = TOLERANCE) -> Column:
    e, p = P.signed_part(gold), P.signed_part(mine)
    error = F.abs(p - e)
    sign = flag(((p == 0) & (e == 0)) | (p * e > 0))
    return 0.08 + 0.12 * sign + 0.30 * coarse(e, p) + 0.25 * fine(error, tolerance) + 0.15 * movement(F.abs(e), F.abs(p)) + 0.10 * flag(error <= tolerance)


def vector_reward(gold: Column, mine: Column, tolerance: float = TOLERANCE) -> Column:
    e, p = P.vector_parts(gold), P.vector_parts(mine)
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    error = norm([b - a for a, b in zip(e, p, strict=True)])
    dot = e[0] * p[0] + e[1] * p[1] + e[2] * p[2]
    same = flag((norm(e) > 1e-9) & (norm(p) > 1e-9) & (dot >= (1 - 1e-6) * norm(e) * norm(p)))
    return 0.10 + 0.25 * same + 0.40 * fine(error, tolerance) + 0.15 * movement(norm(e), norm(p)) + 0.10 * flag(error <= tolerance)


def direction_reward(gold: Column, mine: Column, best: Column, chosen: Column) -> Column:
    """best, chosen: magnitudes of the best move and of the one named."""
    return F.when(gold == mine, 1.0).otherwise(0.10 + 0.55 * F.coalesce(coarse(best, chosen), F.lit(0.0)))


def selection_reward(exact: Column, edit: Column, edits: Column) -> Column:
    """edit: the chosen struct (movement, satisfies, error); edits: all of them."""
    least = F.array_min(F.transform(F.filter(edits, lambda x: x["satisfies"]), lambda x: x["movement"]))
    reference = F.coalesce(least, edit["movement"])
    ratio = reference / F.greatest(edit["movement"], reference, F.lit(1e-9))
    score = F.when(edit["satisfies"], 0.70 + 0.30 * ratio).otherwise(0.10 * ratio)
    return F.greatest(flag(exact), score)


def ranking_reward(gold: Column, mine: Column) -> Column:
    top = flag(F.substring(gold, 1, 1) == F.substring(mine, 1, 1))
    same = F.array_sort(F.split(gold, "")) == F.array_sort(F.split(mine, ""))
    return F.when(same, 0.15 + 0.70 * P.ranking_agreement(gold, mine) + 0.15 * top).otherwise(0.0)


def translation_reward(gold: Column, mine: Column, candidate_score: Column, tolerance: float = TOLERANCE) -> Column:
    pattern = P.PATTERNS["repair_translation"]
    ed, pd = (F.regexp_extract(x, pattern, 1) for x in (gold, mine))
    e, p = P.number(gold, pattern, 2), P.number(mine, pattern, 2)
    d, error = flag(ed == pd), F.abs(p - e)
    return 0.08 + 0.25 * d + 0.15 * candidate_score + 0.25 * coarse(e, p) * d + 0.12 * fine(error, tolerance) * d + 0.10 * movement(e, p) * d + 0.05 * d * flag(error <= tolerance)
