"""Evidence and conservative verdicts from a product's name and description.

One Arrow UDF finds phrases; everything after it is column expressions over its list of matches.  A category is described
by tables: which signals make a field true or false, which make a verdict positive or negative, in order of precedence.
"""

from __future__ import annotations

import re
from re import _parser
from collections.abc import Iterator, Mapping
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.contracts import BASE, check_schema, conform, demand, join_one_to_one, table, violations
from shelfmark.functions import evidence as E, signals as S
from shelfmark.functions.numbers import one_hot, tri_state
from shelfmark.functions.text import rule_text

MATCHES = "matches array<struct<signal: string, source: string, text: string, start: int, stop: int>>, negation boolean"
#: field: (signals that make it true, signals that make it false)
FIELD_SIGNALS: dict[str, dict[str, tuple[tuple[str, ...], tuple[str, ...]]]] = {
    S.SUPPLEMENT: {f: ((f,), ()) for f in ("explicit_bad_marker", "dietary_supplement_marker", "explicit_not_bad", "sport_nutrition")},
    S.FLAMMABLE: {
        "fuel_present": (("fuel_present",), ("explicit_without_fuel",)),
        "fuel_included": (("fuel_included",), ("explicit_without_fuel",)),
        "requires_external_fuel": (("requires_external_fuel",), ()),
        "independent_ignition_source": (("independent_ignition_source",), ("device_with_embedded_ignition",)),
        "flammable_item_in_kit": (("flammable_item_in_kit",), ("flammable_item_not_in_kit",)),
        "explicit_without_fuel": (("explicit_without_fuel",), ()),
    },
}
#: verdict: rules in order of precedence, each with signal sets of which any must be found whole
VERDICTS: dict[str, dict[int, list[tuple[str, tuple[tuple[str, ...], ...]]]]] = {
    S.SUPPLEMENT: {
        0: [("EXPLICIT_NOT_BAD", (("explicit_not_bad",),)), ("SPORT_NUTRITION", (("sport_nutrition",),))],
        1: [("EXPLICIT_BAD_MARKER", (("explicit_bad_marker",),)), ("DIETARY_SUPPLEMENT_MARKER", (("dietary_supplement_marker",),))],
    },
    S.FLAMMABLE: {
        0: [
            ("DEVICE_WITHOUT_INCLUDED_FUEL", (("requires_external_fuel", "explicit_without_fuel"),)),
            ("DEVICE_WITH_EMBEDDED_IGNITION", (("device_with_embedded_ignition",),)),
            ("FLAMMABLE_COMPONENT_ONLY", (("flammable_component",),)),
            ("NO_FLAMMABLE_CONTENT", (("explicit_without_fuel",), ("flammable_item_not_in_kit",))),
        ],
        1: [
            ("INDEPENDENT_IGNITION_SOURCE", (("independent_ignition_source",),)),
            ("FLAMMABLE_CONTENT", (("fuel_present",),)),
            ("FLAMMABLE_ITEM_IN_KIT", (("flammable_item_in_kit",),)),
        ],
    },
}
#: What kind of object a flammable product is, by the first of these signals.
OBJECT_TYPES = (
    ("kit", "flammable_item_in_kit"),
    ("independent_ignition_source", "independent_ignition_source"),
    ("combustible_content", "fuel_present"),
    ("device_requiring_external_fuel", "requires_external_fuel"),
    ("device_with_embedded_ignition", "device_with_embedded_ignition"),
    ("flammable_component", "flammable_component"),
)
MARKERS = ("explicit_bad_marker", "dietary_supplement_marker")
TRI_STATES = (*FIELD_SIGNALS[S.SUPPLEMENT], *FIELD_SIGNALS[S.FLAMMABLE])
MARKER_SOURCES = ("name", "description", S.UNKNOWN)
FEATURES = table(
    "id long, category string, fold byte, group_id string, true_label long,"
    + ", ".join(f"text_{f} byte" for f in (*TRI_STATES, "combustible_device", *(f"marker_source_{v}" for v in MARKER_SOURCES), *(f"object_type_{v}" for v in S.FIELDS[S.FLAMMABLE]["object_type"])))
    + ", text_rule_id string, text_rule_verdict byte, text_rule_has_verdict boolean, text_rule_conflict boolean, text_has_negation boolean, text_evidence_count int,"
    "text_name_evidence_count int, text_description_evidence_count int, text_matched_signals_json string, text_values_json string, text_evidence_json string"
)


#: Rows whose texts a task holds as Python strings at once.
BATCH_ROWS = 256


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


def _needs(items) -> frozenset[str] | None:
    """Texts of which any match of the parsed pattern holds one at least, in lower case; None where there are none to tell."""
    found: list[frozenset[str] | None] = []
    run = ""
    for op, value in [*items, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run.lower()]))
            run = ""
        if op is _parser.SUBPATTERN:
            found.append(_needs(value[3]))
        elif op is _parser.BRANCH:
            own = [_needs(branch) for branch in value[1]]
            found.append(None if None in own else frozenset().union(*own))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and value[0]:
            found.append(_needs(value[2]))
    return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)


@lru_cache(maxsize=None)
def _needed(pattern: str) -> tuple[str, ...]:
    return tuple(sorted(_needs(_parser.parse(pattern, re.IGNORECASE)) or ()))


@lru_cache(maxsize=None)
def _variants(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """Characters that count as another letter of the patterns' needed texts where case is ignored, but are not its upper case: ı for i."""
    letters = {c for p in patterns for text in _needed(p) for c in text}
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return tuple(sorted({v for c in letters for v in re.findall(f"[{re.escape(c)}]", everything, re.IGNORECASE) if v.lower() != c}))


class _Text:
    """A text that tells at little cost that a pattern has no match in it: the texts that any match needs are looked up once."""

    def __init__(self, text: str, variants: tuple[str, ...]):
        self.text, self.low, self.seen = text, text.lower(), {}
        self.plain = not any(v in t for t in {text, self.low} for v in variants)  # the lower case of a text can depend on what stands beside a letter

    def _holds(self, part: str) -> bool:
        if part not in self.seen:
            self.seen[part] = part in self.low
        return self.seen[part]

    def may_match(self, pattern: str) -> bool:
        needed = _needed(pattern)
        return not (needed and self.plain) or any(map(self._holds, needed))

    def matches(self, pattern: str) -> Iterator[re.Match]:
        return _compiled(pattern).finditer(self.text) if self.may_match(pattern) else iter(())


def check_signals(signals: Mapping[str, Mapping[str, S.Signal]] = S.SIGNALS, window: int = S.WINDOW) -> None:
    """Raise on a pattern that does not compile, a signal without patterns or a negative window."""
    problems = ["window is negative"] if window < 0 else []
    for category, own in signals.items():
        for name, signal in own.items():
            if not signal.patterns:
                problems.append(f"{category}.{name} has no patterns")
            for p in (*signal.patterns, *signal.excluded_by):
                try:
                    _compiled(p)
                except re.error as e:
                    problems.append(f"{category}.{name}: invalid regex {p!r}: {e}")
    demand(problems, "signals")


def read_signals(path: str) -> dict[str, object]:
    """signals, negations and window for decide, from a YAML file of the form

        version: 1
        exclusion_window: 80
        negation_patterns: [...]
        categories: {name: {signals: {signal: {patterns: [...], exclude_patterns: [...]}}}}

    Unknown or missing keys, patterns that repeat or do not compile, and signals that the rules do not know are errors.
    """
    from shelfmark.sources.tables import read_config

    c = read_config(path, {"version": int, "exclusion_window": int, "negation_patterns": list, "categories": dict})
    problems, out = [], {}

    def keys(what: str, found: object, wanted: set[str]) -> bool:
        if not isinstance(found, dict) or set(found) != wanted:
            problems.append(f"{what}: keys are not {', '.join(sorted(wanted))}")
            return False
        return True

    def texts(what: str, found: object) -> tuple[str, ...]:
        if not isinstance(found, list) or not all(isinstance(x, str) and x for x in found) or len(set(found)) != len(found):
            problems.append(f"{what}: not a list of different patterns")
            return ()
        return tuple(found)

    negations = texts("negation_patterns", c["negation_patterns"])
    keys("categories", c["categories"], set(S.SIGNALS))
    for category, own in c["categories"].items():
        if category in S.SIGNALS and keys(category, own, {"signals"}) and keys(f"{category}.signals", own["signals"], set(S.SIGNALS[category])):
            out[category] = {n: S.Signal(texts(f"{category}.{n}", x["patterns"]), texts(f"{category}.{n}", x["exclude_patterns"])) for n, x in own["signals"].items() if keys(f"{category}.{n}", x, {"patterns", "exclude_patterns"})}
    demand(problems, path)
    check_signals(out, c["exclusion_window"])
    return {"signals": out, "negations": negations, "window": c["exclusion_window"]}


def phrase_matches(texts: Mapping[str, str], signals: Mapping[str, S.Signal], window: int = S.WINDOW) -> list[tuple[str, str, str, int, int]]:
    """(signal, source, text, start, stop) by signal, source and place; those within window of an excluding phrase are left out."""
    variants = _variants(tuple(dict.fromkeys(p for s in signals.values() for p in (*s.patterns, *s.excluded_by))))
    return _phrases({source: _Text(text, variants) for source, text in texts.items()}, signals, window)


def _phrases(texts: Mapping[str, _Text], signals: Mapping[str, S.Signal], window: int) -> list[tuple[str, str, str, int, int]]:
    out = []
    for name, signal in signals.items():
        for source, text in texts.items():
            spans = {m.span(): m.group().strip() for p in signal.patterns for m in text.matches(p)}
            void = [m.span() for p in signal.excluded_by for m in text.matches(p)] if spans else []
            free = sorted(s for s in spans if all(s[1] + window < a or b + window < s[0] for a, b in void))
            out += [(name, source, spans[s], *s) for s in free]
    return out


def _matcher(signals: Mapping[str, Mapping[str, S.Signal]], negations: tuple[str, ...], window: int):
    kind = pa.struct([("matches", pa.list_(pa.struct([("signal", pa.string()), ("source", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))), ("negation", pa.bool_())])

    def rows(names: list, descriptions: list, categories: list) -> pa.Array:
        out = []
        variants = _variants((*dict.fromkeys(p for own in signals.values() for s in own.values() for p in (*s.patterns, *s.excluded_by)), *negations))
        for name, description, category in zip(names, descriptions, categories, strict=True):
            if category not in signals:
                raise ValueError(f"unknown category: {category}")
            texts = {"name": _Text(rule_text(name), variants), "description": _Text(rule_text(description), variants)}
            negated = any(t.may_match(p) and _compiled(p).search(t.text) for t in texts.values() for p in negations)
            found = [dict(zip(("signal", "source", "text", "start", "stop"), m, strict=True)) for m in _phrases(texts, signals[category], window)]
            out.append({"matches": found, "negation": negated})
        return pa.array(out, kind)

    @F.arrow_udf(MATCHES)
    def find(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for part in parts:
            done = [rows(*(c.slice(i, BATCH_ROWS).to_pylist() for c in part)) for i in range(0, len(part[0]), BATCH_ROWS)]
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return find


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _is(name: str):
    return lambda match: match["signal"] == name


def _of(*names: str) -> Column:
    """Matches of the signals, in the order of names."""
    return F.concat(*[F.filter("m.matches", _is(n)) for n in names])


def _has(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.exists("m.matches", _is(n)) for n in names])


def _records(field: str, value: str | Column, matches: Column) -> Column:
    """Evidence of a field as JSON texts with their source; value is JSON too."""
    value = F.lit(value) if isinstance(value, str) else value
    one = lambda x: F.struct(
        x["source"].alias("source"),
        F.concat(F.regexp_replace(F.to_json(F.struct(F.lit(field).alias("field"), x["source"].alias("source"), x["text"].alias("text"))), r"\}$", ""), F.lit(',"value":'), value, F.lit("}")).alias("json"),
    )
    return F.array_distinct(F.transform(matches, one))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _decision(category: str) -> dict[str, Column]:
    """Columns of one category: fields, evidence, conflict, verdict, rule."""
    fields, evidence, broken = {}, [], []
    for name, (yes, no) in FIELD_SIGNALS[category].items():
        true, false = _any([_has(s) for s in yes]), _any([_has(s) for s in no])
        fields[name] = F.when(true & ~false, True).when(false & ~true, False)
        broken.append(true & false)
        evidence += [_records(name, "true", _of(*yes)), *([_records(name, "false", _of(*no))] if no else [])]
    if category == S.SUPPLEMENT:
        marks = _of(*MARKERS)
        source = F.when(F.exists(marks, lambda x: x["source"] == "description"), "description").when(F.size(marks) > 0, "name")
        kind, first = "marker_source", F.slice(F.filter(marks, lambda x: x["source"] == source), 1, 1)
        fields[kind] = source
    else:
        kind = "object_type"
        fields[kind] = F.coalesce(*[F.when(_has(signal), value) for value, signal in OBJECT_TYPES])
        first = F.coalesce(*[F.when(_has(signal), _of(signal)) for _, signal in OBJECT_TYPES], F.filter("m.matches", lambda x: F.lit(False)))
    evidence.append(_records(kind, F.coalesce(_quoted(fields[kind]), F.lit("null")), first))
    holds = {v: [(rule, _any([_has(*need) for need in needs])) for rule, needs in rules] for v, rules in VERDICTS[category].items()}
    yes, no = (_any([h for _, h in holds[v]]) for v in (1, 0))
    conflict = (yes & no) | _any(broken)
    rule = F.coalesce(*[F.when(~conflict & h, r) for v in (1, 0) for r, h in holds[v]], F.lit(S.UNDECIDED))
    text = lambda f, c: F.coalesce(_quoted(c) if f == kind else c.cast("string"), F.lit(f'"{S.UNKNOWN}"'))
    values = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), text(f, c)) for f, c in sorted(fields.items())]), F.lit("}"))
    return {f"f_{f}": c for f, c in fields.items()} | {"evidence": F.concat(*evidence), "conflict": conflict, "verdict": F.when(~conflict & yes, 1).when(~conflict & no, 0), "rule_id": rule, "values": values}


def decide(products: DataFrame, signals: Mapping[str, Mapping[str, S.Signal]] = S.SIGNALS, window: int = S.WINDOW, negations: tuple[str, ...] = S.NEGATIONS) -> DataFrame:
    """products (id, name, description, category) with the text_ columns of FEATURES; an unknown category raises when run."""
    check_signals(signals, window)
    found = products.select("id", "category", _matcher(signals, negations, window)("name", "description", "category").alias("m"))
    parts = {c: _decision(c) for c in S.SIGNALS}
    names = list(dict.fromkeys(n for own in parts.values() for n in own))

    def pick(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("category") == c, own[name]) for c, own in parts.items() if name in own])

    rows = found.withColumns({n: pick(n) for n in names})
    is_of = lambda c: F.col("category") == c
    count = lambda s: F.size(F.filter("evidence", lambda x: x["source"] == s))
    return rows.select(
        "id",
        "category",
        *[tri_state(f"f_{f}").alias(f"text_{f}") for f in TRI_STATES],
        _has("combustible_device").cast("byte").alias("text_combustible_device"),
        *one_hot(F.when(is_of(S.SUPPLEMENT), F.coalesce("f_marker_source", F.lit(S.UNKNOWN))), MARKER_SOURCES, "text_marker_source"),
        *one_hot(F.when(is_of(S.FLAMMABLE), F.coalesce("f_object_type", F.lit(S.UNKNOWN))), S.FIELDS[S.FLAMMABLE]["object_type"], "text_object_type"),
        F.col("rule_id").alias("text_rule_id"),
        F.col("verdict").cast("byte").alias("text_rule_verdict"),
        F.col("verdict").isNotNull().alias("text_rule_has_verdict"),
        F.col("conflict").alias("text_rule_conflict"),
        F.col("m.negation").alias("text_has_negation"),
        F.size("evidence").alias("text_evidence_count"),
        count("name").alias("text_name_evidence_count"),
        count("description").alias("text_description_evidence_count"),
        F.to_json(F.filter(F.array(*[F.when(_has(s), s) for s in dict.fromkeys(s for own in signals.values() for s in own)]), lambda x: x.isNotNull())).alias("text_matched_signals_json"),
        F.col("values").alias("text_values_json"),
        F.concat(F.lit("["), F.concat_ws(",", F.transform("evidence", lambda x: x["json"])), F.lit("]")).alias("text_evidence_json"),
    )


def rule_features(products: DataFrame, folds: DataFrame) -> DataFrame:
    """FEATURES: folds and labels are joined only after the rules have seen the texts alone."""
    text = decide(products.select("id", "name", "description", "category"))
    base = folds.select("id", F.col("category").alias("_category"), "fold", "group_id", F.col("label").alias("true_label"))
    both = join_one_to_one(text, base, what="products and folds")
    if not both.filter("category <> _category").isEmpty():
        raise ValueError("products and folds: categories differ")
    return conform(both.drop("_category"), FEATURES)


def validate_features(features: DataFrame) -> None:
    check_schema(features, FEATURES, "rule features")
    allowed = [(F.col("category") == c) & ~F.col("text_rule_id").isin(*ids) for c, ids in S.RULE_IDS.items()]
    rules = {f"null {c}": F.col(c).isNull() for c in FEATURES.names if c != "text_rule_verdict"} | {
        "verdict in conflict": F.col("text_rule_conflict") & F.col("text_rule_verdict").isNotNull(),
        "has_verdict differs": F.col("text_rule_has_verdict") != F.col("text_rule_verdict").isNotNull(),
        "verdict outside 0/1": ~F.col("text_rule_verdict").isin(0, 1),
        "undecided with a rule": F.col("text_rule_verdict").isNull() & (F.col("text_rule_id") != S.UNDECIDED),
        "counts differ": F.col("text_evidence_count") != F.col("text_name_evidence_count") + F.col("text_description_evidence_count"),
        "rule outside the contract": _any(allowed),
        "evidence outside the contract": F.exists(E.facts(F.col("text_evidence_json")), lambda x: F.size(E.fact_faults(F.col("category"), x)) > 0),
        "values outside the contract": F.size(E.value_faults(F.col("category"), F.col("text_values_json"))) > 0,
        "evidence is not JSON": F.coalesce(F.json_array_length("text_evidence_json"), F.lit(-1)) != F.col("text_evidence_count"),
    }
    demand([f"{name}: {n}" for name, n in violations(features, rules).items()], "rule features")


def rule_coverage(features: DataFrame) -> DataFrame:
    """category, rows, decided, coverage, conflicts, right, accuracy among decided rows (null without any)."""
    hit = (F.col("text_rule_verdict") == F.col("true_label")).cast("int")
    out = features.groupBy("category").agg(F.count("*").alias("rows"), F.count("text_rule_verdict").alias("decided"), F.count_if("text_rule_conflict").alias("conflicts"), F.coalesce(F.sum(hit), F.lit(0)).alias("right"))
    return out.withColumns({"coverage": F.col("decided") / F.col("rows"), "accuracy": F.try_divide("right", "decided")})


def rule_distribution(features: DataFrame) -> DataFrame:
    """category, rule, rows."""
    return features.groupBy("category", "text_rule_id").agg(F.count("*").alias("rows"))


def verdict_quality(features: DataFrame) -> DataFrame:
    """category, verdict, rows, share of them whose label agrees."""
    hit = (F.col("text_rule_verdict") == F.col("true_label")).cast("int")
    return features.filter("text_rule_verdict is not null").groupBy("category", "text_rule_verdict").agg(F.count("*").alias("rows"), F.avg(hit).alias("accuracy"))


def ocr_disagreement(products: DataFrame) -> DataFrame:
    """(id, text_verdict, ocr_verdict, ocr_rule_id, text_ocr_disagreement) of products with a column ocr_text.

    The rules run over name and description, and apart from them over the text read from images; they disagree where both
    decide and differ.
    """
    text = decide(products.select("id", "name", "description", "category")).select("id", F.col("text_rule_verdict").alias("text_verdict"))
    seen = decide(products.select("id", F.lit(None).cast("string").alias("name"), F.col("ocr_text").alias("description"), "category"))
    seen = seen.select("id", F.col("text_rule_verdict").alias("ocr_verdict"), F.col("text_rule_id").alias("ocr_rule_id"))
    return join_one_to_one(text, seen).withColumn("text_ocr_disagreement", F.coalesce(F.col("text_verdict") != F.col("ocr_verdict"), F.lit(False)))
