"""The evidence contract as column expressions: what a fact, a set of field values and a training target may hold.

The contract is a set of lines (category, field, value), values written as JSON, so that types count: 1 is not true, and
"true" is neither.  Each check is a list of (name, condition that breaks it); a row's faults are the names that hold.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions import signals as S
from shelfmark.functions.text import SEPARATOR, stable_json

_LINES = [(c, f, v) for c, fields in S.FIELDS.items() for f, values in fields.items() for v in values]
_KEYS = {"field", "value", "source", "text", "image_index"}


def _joined(*columns: Column) -> Column:
    return F.concat(*[x for c in columns for x in (F.lit(SEPARATOR), c)][1:])


def _listed(lines: list[tuple], *columns: Column) -> Column:
    """Whether the columns' values are one of the lines."""
    return F.coalesce(_joined(*columns).isin([SEPARATOR.join(x) for x in lines]), F.lit(False))


def _part(json: Column, path: str) -> Column:
    """The JSON text at path; null where there is nothing, 'null' where a null stands."""
    return F.to_json(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def _text_of(json: Column) -> Column:
    """A JSON string's content; null for other JSON."""
    return F.when(json.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x"))


def _faults(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in checks]))


def fact_faults(category: Column, fact: Column) -> Column:
    """Names of what is wrong with one fact (JSON): field, value and source, a text or an image index as its source asks for."""
    field, value, source, text, index = (_part(fact, f"$.{k}") for k in ("field", "value", "source", "text", "image_index"))
    keys = F.json_object_keys(fact)
    name, origin = _text_of(field), _text_of(source)
    says, shows = (_listed([(s,) for s, needs in S.SOURCES.items() if needs[i]], origin) for i in (0, 1))
    known = _listed([(s,) for s in S.SOURCES], origin)
    has_text, has_index = F.coalesce(text != "null", F.lit(False)), F.coalesce(index != "null", F.lit(False))
    return _faults([
        ("shape", keys.isNull() | (F.size(F.array_except(keys, F.array(*map(F.lit, sorted(_KEYS))))) > 0) | field.isNull() | value.isNull() | source.isNull()),
        ("field", ~_listed(sorted({(c, f) for c, f, _ in _LINES}), category, name)),
        ("value", ~_listed([(c, f, stable_json(v)) for c, f, v in _LINES], category, name, value)),
        ("unknown", value == stable_json(S.UNKNOWN)),
        ("source", ~known),
        ("text", (has_text & ~F.coalesce(_text_of(text).rlike(r"(?U)\S"), F.lit(False))) | (says & ~has_text)),
        ("image_index", (has_index & ~index.rlike("^[0-9]+$")) | (known & (shows != has_index))),
    ])


def facts(evidence: Column) -> Column:
    """The facts of a JSON list, each as JSON text; null if it is no list."""
    return F.from_json(evidence, "array<string>")


def value_faults(category: Column, values: Column, more: tuple[str, ...] = ()) -> Column:
    """Names of what is wrong with a flat object of all fields of a category, and the keys `more`."""
    keys = F.json_object_keys(values)
    checks = [("shape", keys.isNull()), ("category", ~_listed([(c,) for c in S.FIELDS], category))]
    for c, fields in S.FIELDS.items():
        own = category == c
        wanted = F.array(*[F.lit(k) for k in (*fields, *more)])
        checks += [("missing", own & (F.size(F.array_except(wanted, keys)) > 0)), ("more", own & (F.size(F.array_except(keys, wanted)) > 0))]
        checks += [(f, own & F.array_contains(keys, f) & ~F.coalesce(_part(values, f"$.{f}").isin([stable_json(v) for v in allowed]), F.lit(False))) for f, allowed in fields.items()]
    return _faults(checks)


def target(category: Column, values: Column, rule_id: Column, verdict: Column) -> Column:
    """A training target as JSON: the fields in the contract's order, then rule_id and verdict."""
    quoted = lambda c: F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1))
    out = F.lit(None).cast("string")
    for c, fields in S.FIELDS.items():
        parts = [(f, _part(values, f"$.{f}")) for f in fields] + [("rule_id", quoted(rule_id)), ("verdict", verdict.cast("string"))]
        flat = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in parts]), F.lit("}"))
        out = F.when(category == c, flat).otherwise(out)
    return out


def target_faults(category: Column, payload: Column) -> Column:
    """Names of what is wrong with a target: its fields, a rule of the category, a verdict that is the number 0 or 1."""
    rules = [(c, stable_json(r)) for c, own in S.RULE_IDS.items() for r in own]
    own = _faults([("rule_id", ~_listed(rules, category, _part(payload, "$.rule_id"))), ("verdict", ~F.coalesce(_part(payload, "$.verdict").isin("0", "1"), F.lit(False)))])
    return F.concat(value_faults(category, payload, ("rule_id", "verdict")), own)
