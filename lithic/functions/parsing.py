"""Strict answer grammars and numeric parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed vocabularies and patterns of the answers, by task.
CHOICES = {
    "binary_interference": ("yes", "no"),
    "tolerance_fit": ("yes", "no"),
    "relation_classification": ("disjoint", "touching", "near_miss", "intersecting", "contained", "invalid"),
    "volume_bucket": ("0", "(0, 0.01]", "(0.01, 0.05]", "(0.05, 0.20]", "(0.20, 0.50]", ">0.50"),
    "clearance_bucket": ("intersecting", "touching", "(0, 0.1]", "(0.1, 1]", "(1, 5]", ">5"),
    "pairwise_interference": ("A", "B", "both", "neither"),
    "repair_direction": ("+x", "-x", "+y", "-y", "+z", "-z"),
    "edit_candidate_selection": ("A", "B", "C", "D"),
}
_NUM = r"(-?[0-9]+\.[0-9])"
PATTERNS = {
    "repair_translation": r"^([+-][xyz]) ([0-9]+\.[0-9]{6})$",
    "axis_aligned_repair": r"^direction=([+-][xyz]), distance_mm=([0-9]+\.[0-9])$",
    "target_clearance_repair": r"^direction=([+-][xyz]), distance_mm=([0-9]+\.[0-9])$",
    "target_clearance_move": rf"^distance_mm={_NUM}$",
    "target_contact_move": rf"^distance_mm={_NUM}$",
    "centroid_distance_move": rf"^distance_mm={_NUM}$",
    "axis_aligned_repair_vector": rf"^dx={_NUM}, dy={_NUM}, dz={_NUM}$",
    "axis_aligned_repair_program": rf"^object_b = object_b\.translate\(\({_NUM}, {_NUM}, {_NUM}\)\)$",
}
#: Rankings: letters they are made of, and how many at least.
RANKINGS = {"ranking_normalized_intersection": ("ABCDE", 3), "edit_candidate_ranking": ("ABCD", 4)}
ANSWER_TAG = r"(?s)<answer>\s*(.*?)\s*</answer>"


def has_tag(output: Column) -> Column:
    return output.rlike(ANSWER_TAG)


def has_reasoning(output: Column) -> Column:
    """A think element that starts before the answer element."""
    return output.contains("<think>") & output.contains("</think>") & (F.instr(output, "<think>") < F.instr(output, "<answer>"))


def candidate(output: Column) -> Column:
    """The content of the first answer element, else the whole output."""
    return F.when(has_tag(output), F.trim(F.regexp_extract(output, ANSWER_TAG, 1), F.lit(" \t\r\n"))).otherwise(output)


def format_score(output: Column) -> Column:
    return F.when(~has_tag(output), 1.0).when(has_reasoning(output), 1.0).otherwise(0.85)


def is_permutation(s: Column, letters: str, least: int) -> Column:
    """Distinct letters out of `letters`, at least so many."""
    return s.rlike(f"^[{letters}]{{{least},{len(letters)}}}$") & (F.size(F.array_distinct(F.split(s, ""))) == F.length(s))


def require_known(task: Column) -> Column:
    """The task itself; a run that meets one without a grammar fails and names it. A null task stays null."""
    known = task.isNull() | task.isin(*RANKINGS, *PATTERNS, *CHOICES)
    return F.when(known, task).otherwise(F.raise_error(F.concat(F.lit("unknown task: "), task)).cast("string"))


def parse_answer(task: Column, output: Column) -> Column:
    """The trimmed answer if it fits the task's grammar, else null. Unknown tasks are null; require_known() stops at them."""
    s = F.trim(output, F.lit(" \t\r\n"))
    # Closed vocabularies are one look-up of task and answer, so the code of the whole expression stays small.
    out = F.when(F.concat(task, F.lit("\0"), s).isin(*[f"{name}\0{v}" for name, values in CHOICES.items() for v in values]), s)
    for name, pattern in PATTERNS.items():
        out = out.when((task == name) & s.rlike(pattern), s)
    for name, (letters, least) in RANKINGS.items():
        out = out.when((task == name) & is_permutation(s, letters, least), s)
    return out


def number(text: Column, pattern: str, group: int) -> Column:
    """A group of the pattern as a double; null where the text doesn't fit."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).try_cast("double")


def axis_parts(text: Column) -> tuple[Column, Column]:
    p = PATTERNS["axis_aligned_repair"]
    return F.when(text.rlike(p), F.regexp_extract(text, p, 1)), number(text, p, 2)


def signed_part(text: Column) -> Column:
    return number(text, PATTERNS["target_clearance_move"], 1)


def vector_parts(text: Column) -> list[Column]:
    return [number(text, PATTERNS["axis_aligned_repair_vector"], k) for k in (1, 2, 3)]


def ranking_agreement(gold: Column, mine: Column) -> Column:
    """Share of letter pairs of `gold` that stand in the same order in `mine`; 0 without a pair or for other letters."""
    letters = F.split(gold, "")
    at = F.transform(letters, lambda c: F.instr(mine, c))
    pairs = F.flatten(F.transform(at, lambda x, i: F.transform(F.slice(at, i + 2, F.length(gold)), lambda y: F.when((x > 0) & (y > 0) & (x < y), 1).otherwise(0))))
    total = F.size(pairs)
    good = F.aggregate(pairs, F.lit(0), lambda a, x: a + x)
    same = F.array_sort(letters) == F.array_sort(F.split(mine, ""))
    return F.when(same & (total > 0), good / total).otherwise(0.0)
