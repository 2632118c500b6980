import json

import pytest
from pyspark.sql import functions as F

from shelfmark.contracts import CATEGORIES
from shelfmark.functions import evidence as E, signals as S
from shelfmark.functions.text import plain_text, rule_text
from shelfmark.operators import explain, rules
from shelfmark.plans.queries import CARDS

B, FL = CATEGORIES


@pytest.fixture(scope="module")
def cards(spark):
    more = [(1, "Чехол для газового баллона", "Сумка с подогревом для баллона"), (0, None, None)]
    rows = [(i, n, d, FL if c else B) for i, (c, n, d, *_) in enumerate([*CARDS, *more])]
    return spark.createDataFrame(rows, "id long, name string, description string, category string")


@pytest.fixture(scope="module")
def decided(cards):
    return {r.id: r for r in rules.decide(cards).collect()}


def test_verdicts(decided):
    for i, (_, _, _, rule, verdict, conflict) in enumerate(CARDS):
        assert (decided[i].text_rule_id, decided[i].text_rule_verdict, decided[i].text_rule_conflict) == (rule, verdict, conflict)
    assert decided[12].text_fuel_present == -1 and decided[13].text_rule_id == S.UNDECIDED


def test_fields(decided):
    assert decided[0].text_marker_source_description == 1 and decided[1].text_marker_source_unknown == 1 and decided[1].text_explicit_bad_marker == -1
    burner = decided[7]
    assert (burner.text_fuel_included, burner.text_fuel_present, burner.text_object_type_device_requiring_external_fuel) == (0, 0, 1)
    facts = json.loads(decided[11].text_evidence_json)
    assert {f["value"] for f in facts if f["field"] == "fuel_present"} == {True, False} and decided[11].text_fuel_present == -1
    for i, r in decided.items():
        category = FL if i < 13 and i >= 5 else B
        assert json.loads(r.text_matched_signals_json) == [s for s in S.SIGNALS[category] if s in json.loads(r.text_matched_signals_json)]


def folds_of(cards, flip=False):
    label = F.col("id") % 2
    return cards.select("id", "category", (1 - label if flip else label).alias("label"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("group_id"), (F.col("id") % 3).cast("byte").alias("fold"))


def test_features_do_not_look_at_labels(cards):
    a, b = (rules.rule_features(cards, folds_of(cards, flip)).drop("true_label").orderBy("id").collect() for flip in (False, True))
    assert a == b
    rules.validate_features(rules.rule_features(cards, folds_of(cards)))


def test_feature_rejections(cards):
    f = rules.rule_features(cards, folds_of(cards))
    with pytest.raises(ValueError, match="categories differ"):
        rules.rule_features(cards, folds_of(cards).withColumn("category", F.lit(B)))
    with pytest.raises(ValueError, match="verdict in conflict"):
        rules.validate_features(f.withColumn("text_rule_conflict", F.lit(True)))
    with pytest.raises(ValueError, match="counts differ"):
        rules.validate_features(f.withColumn("text_evidence_count", F.lit(99)))
    with pytest.raises(Exception, match="unknown category"):
        rules.decide(cards.withColumn("category", F.lit("x"))).collect()
    with pytest.raises(ValueError, match="invalid regex"):
        rules.check_signals({B: {"x": S.Signal(("(",))}})


def test_exclusion_window_is_inclusive():
    signal = {"s": S.Signal(("hit",), ("void",))}
    assert rules.phrase_matches({"name": "hit" + " " * 80 + "void"}, signal) == []
    assert len(rules.phrase_matches({"name": "hit" + " " * 81 + "void"}, signal)) == 1
    assert len(rules.phrase_matches({"name": "hit", "description": "void"}, signal)) == 1


@pytest.mark.parametrize(("value", "want"), [("  БАД&nbsp; ДЛЯ&nbsp;ЕДЫ  ", "бад для еды"), ("Ёлка", "елка"), (None, "")])
def test_rule_text(value, want):
    assert rule_text(value) == want


def test_plain_text():
    assert plain_text("<p>БАД&nbsp; ТЕКСТ</p>") == "бад текст" and plain_text("&amp;lt;b&amp;gt;") == "<b>"


GOOD = {"field": "explicit_bad_marker", "value": True, "source": "name", "text": "бад"}
IMAGE = {"field": "marker_source", "value": "image", "source": "image", "image_index": 0}
FACTS = [
    (GOOD, []), (IMAGE, []), (IMAGE | {"text": "seen"}, []), (IMAGE | {"source": "ocr", "value": "ocr", "text": "read"}, []), (GOOD | {"image_index": None}, []),
    (GOOD | {"text": None}, ["text"]), (GOOD | {"text": " "}, ["text"]), (GOOD | {"text": 5}, ["text"]), (GOOD | {"source": "ocr"}, ["image_index"]),
    (GOOD | {"source": "description", "image_index": 1}, ["image_index"]), (IMAGE | {"image_index": -1}, ["image_index"]), (IMAGE | {"image_index": "0"}, ["image_index"]), (IMAGE | {"image_index": True}, ["image_index"]),
    (GOOD | {"value": "unknown"}, ["unknown"]), (GOOD | {"value": 1}, ["value"]), (GOOD | {"value": "true"}, ["value"]), (GOOD | {"value": None}, ["value"]),
    (GOOD | {"field": "nope"}, ["field", "value"]), (GOOD | {"source": "label"}, ["source"]), (GOOD | {"label": 1}, ["shape"]),
]


def test_faults_of_facts(spark):
    rows = spark.createDataFrame([(i, json.dumps(f)) for i, (f, _) in enumerate(FACTS)] + [(98, "text"), (99, json.dumps({k: v for k, v in GOOD.items() if k != "value"}))], "i int, fact string")
    got = {r.i: r.faults for r in rows.select("i", E.fact_faults(F.lit(B), F.col("fact")).alias("faults")).collect()}
    assert [got[i] for i in range(len(FACTS))] == [want for _, want in FACTS]
    assert "shape" in got[98] and "shape" in got[99]
    whole = spark.createDataFrame([(json.dumps([GOOD, IMAGE]),), ("text",)], "j string").select(E.facts(F.col("j")).alias("f")).collect()
    assert [json.loads(x) for x in whole[0].f] == [GOOD, IMAGE] and not whole[1].f


def test_targets(spark):
    values = dict.fromkeys(S.FIELDS[B], "unknown") | {"sport_nutrition": False}
    rows = spark.createDataFrame([(json.dumps(dict(reversed(values.items()))), "NO_BAD_MARKER", 0)], "v string, r string, y int")
    made = rows.select(E.target(F.lit(B), F.col("v"), F.col("r"), F.col("y")).alias("t")).first().t
    assert list(json.loads(made).items()) == [*values.items(), ("rule_id", "NO_BAD_MARKER"), ("verdict", 0)]
    good = json.loads(made)
    cases = [(good, []), (good | {"verdict": True}, ["verdict"]), (good | {"verdict": "1"}, ["verdict"]), (good | {"rule_id": "X"}, ["rule_id"]), (good | {"more": 1}, ["more"]), ({k: v for k, v in good.items() if k != "verdict"}, ["missing", "verdict"]), (good | {"sport_nutrition": 0}, ["sport_nutrition"])]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", E.target_faults(F.lit(B), F.col("t")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    own = df.filter("i = 0").select(E.value_faults(F.lit("x"), F.col("t")).alias("a"), E.value_faults(F.lit(B), F.lit(json.dumps(values))).alias("b"), E.value_faults(F.lit(B), F.lit("[1]")).alias("c")).first()
    assert own == (["category"], [], ["shape"])


def test_explanations(spark, cards):
    done = explain.explained(rules.decide(cards))
    explain.validate_submission(done, cards)
    assert all(50 <= len(r.result) - 1 <= 300 and r.result[-1] in "01" for r in done.collect())
    long = spark.range(1).select(explain.explanation(F.lit("SPORT_NUTRITION"), F.repeat(F.lit("x"), 900), F.lit(0)).alias("t")).first().t
    assert len(long) <= 300 and "…" in long
    with pytest.raises(ValueError, match="ids"):
        explain.validate_submission(done.limit(3), cards)
    with pytest.raises(ValueError, match="comment"):
        explain.validate_submission(done.withColumn("result", F.lit("short1")), cards)


def test_signals_from_a_file(spark, cards, tmp_path):
    import yaml

    whole = {
        "version": 1, "exclusion_window": S.WINDOW, "negation_patterns": list(S.NEGATIONS),
        "categories": {c: {"signals": {n: {"patterns": list(x.patterns), "exclude_patterns": list(x.excluded_by)} for n, x in own.items()}} for c, own in S.SIGNALS.items()},
    }
    path = tmp_path / "rules.yaml"
    path.write_text(yaml.safe_dump(whole, allow_unicode=True))
    read = rules.read_signals(str(path))
    assert read == {"signals": S.SIGNALS, "negations": S.NEGATIONS, "window": S.WINDOW}
    assert rules.decide(cards, **read).select("text_rule_id").collect() == rules.decide(cards).select("text_rule_id").collect()
    first = next(iter(S.SIGNALS[B]))
    for change, match in (
        (lambda w: w.update(version=2), "version"), (lambda w: w.update(more=1), "unknown"), (lambda w: w["categories"].pop(B), "categories: keys"),
        (lambda w: w["categories"][B]["signals"].pop(first), "signals: keys"), (lambda w: w["categories"][B]["signals"][first].pop("patterns"), "keys are not"),
        (lambda w: w["categories"][B]["signals"][first].update(patterns=["a", "a"]), "different patterns"), (lambda w: w["categories"][B]["signals"][first].update(patterns=["("]), "invalid regex"),
        (lambda w: w.update(exclusion_window=-1), "window"),
    ):
        bad = yaml.safe_load(yaml.safe_dump(whole, allow_unicode=True))
        change(bad)
        path.write_text(yaml.safe_dump(bad, allow_unicode=True))
        with pytest.raises(ValueError, match=match):
            rules.read_signals(str(path))
