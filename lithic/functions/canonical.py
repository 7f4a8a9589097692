"""Canonical JSON and the hashes on it: sorted keys, no spaces, ASCII escapes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(StringType())
def _canonical(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else canonical(json.loads(t)))


def canonical_json(text: Column) -> Column:
    """The canonical form of a JSON text; null for null. Built-in writers keep the order of keys and print other numbers."""
    return _canonical(text)


def canonical_struct(**fields: Column) -> Column:
    """Canonical JSON of an object; null fields stay as null."""
    return canonical_json(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}))


def quoted(text: Column) -> Column:
    """A text as a string of canonical JSON; null stays as null. Few texts need more than the common escapes."""
    plain = text
    for c, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(c), F.lit(name))
    rare = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), _escaped), "")
    body = F.when(text.rlike(r"[^ -~\n\r\t]"), rare).otherwise(plain)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def _escaped(c: Column) -> Column:
    k = F.ascii(c)
    unit = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
    out = F.when(k.between(32, 126) & ~c.isin('"', "\\"), c)
    for x in '"\\\n\r\t\f\b':
        out = out.when(c == x, json.dumps(x)[1:-1])
    far = k - 0x10000
    return out.when(k < 0x10000, unit(k)).otherwise(F.concat(unit(F.lit(0xD800) + F.shiftright(far, 10)), unit(F.lit(0xDC00) + far.bitwiseAND(0x3FF))))


def json_array(items: Column) -> Column:
    """JSON of an array of JSON texts; null for a null array."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), F.lit("null"))


def json_object(**members: object) -> Column:
    """Canonical JSON of an object without Python: columns are JSON texts of their members, other values are written as they are."""
    parts: list[Column] = []
    for i, (k, v) in enumerate(sorted(members.items())):
        parts += [F.lit(f'{"," if i else "{"}{canonical(k)}:'), v if isinstance(v, Column) else F.lit(canonical(v))]
    return F.concat(*parts, F.lit("}"))


def sha256_text(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def sha256_list(hashes: Column) -> Column:
    """Hash of the canonical JSON of an array of plain ASCII strings, such as hashes: no Python is needed for it."""
    quoted = F.transform(hashes, lambda h: F.coalesce(F.concat(F.lit('"'), h, F.lit('"')), F.lit("null")))
    return sha256_text(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")))


def prompt_hash(prompt: Column, task: Column, geometry_ids: Column, version: Column) -> Column:
    return sha256_text(json_object(template_version=quoted(version), task_type=quoted(task), prompt=quoted(prompt), geometry_ids=json_array(F.transform(geometry_ids, quoted))))


HASHES = ("source_code_hash", "object_hash", "transform_hash", "geometry_hash", "config_hash")


def row_hashes(hashes: Column, prompt: Column, task: Column, geometry_id: Column, version: Column) -> Column:
    """The record's hashes and that of its prompt."""
    return F.struct(*[hashes[h].alias(h) for h in HASHES], prompt_hash(prompt, task, F.array(geometry_id), version).alias("prompt_hash"))


def group_row_hashes(records: Column, prompt: Column, task: Column, version: Column) -> Column:
    """records: an array of structs (geometry_id, hashes) in row order. Hashes of lists of hashes; the first one's config."""
    lists = [sha256_list(F.transform(records, lambda r: r["hashes"][h])).alias(h) for h in HASHES[:-1]]  # noqa: B023
    first = F.get(records, F.lit(0))["hashes"]["config_hash"].alias("config_hash")
    return F.struct(*lists, first, prompt_hash(prompt, task, F.transform(records, lambda r: r["geometry_id"]), version).alias("prompt_hash"))
