"""Short explanations of verdicts from rule and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.contracts import demand, violations

LEAST, MOST = 50, 300
#: What each rule says; %s is the phrase found.
TEMPLATES = {
    "EXPLICIT_BAD_MARKER": "В описании товара прямо указано, что это биологически активная добавка: «%s».",
    "DIETARY_SUPPLEMENT_MARKER": "На товаре есть маркировка пищевой добавки, которая относит его к категории: «%s».",
    "EXPLICIT_NOT_BAD": "В описании прямо указано, что товар не является биологически активной добавкой: «%s».",
    "SPORT_NUTRITION": "Товар относится к спортивному питанию, а не к биологически активным добавкам: «%s».",
    "INDEPENDENT_IGNITION_SOURCE": "Товар сам является источником воспламенения, на это указывает фраза: «%s».",
    "FLAMMABLE_CONTENT": "Товар содержит горючее вещество или газ, на это указывает фраза: «%s».",
    "FLAMMABLE_ITEM_IN_KIT": "В комплект входит легковоспламеняющийся предмет, на это указывает фраза: «%s».",
    "DEVICE_WITHOUT_INCLUDED_FUEL": "Устройство работает от внешнего топлива, которое в комплект не входит: «%s».",
    "DEVICE_WITH_EMBEDDED_IGNITION": "Устройство имеет встроенный розжиг и не является источником огня: «%s».",
    "FLAMMABLE_COMPONENT_ONLY": "Товар содержит лишь компонент, который не считается горючим: «%s».",
    "NO_FLAMMABLE_CONTENT": "В описании указано, что горючего содержимого в товаре нет: «%s».",
}
FALLBACK = {1: "По совокупности признаков карточки товар соответствует требованиям указанной категории.", 0: "По совокупности признаков карточки товар не соответствует требованиям указанной категории."}


def explanation(rule_id: Column, evidence_text: Column, verdict: Column) -> Column:
    """LEAST to MOST characters: the rule's template with its phrase, shortened to fit; the fallback without rule or phrase."""
    phrase = F.trim(F.regexp_replace(F.coalesce(evidence_text, F.lit("")), r"(?U)\s+", " "))
    filled = F.lit(None).cast("string")
    for rule, text in TEMPLATES.items():
        room = MOST - len(text) + 2
        short = F.when(F.length(phrase) > room, F.concat(F.substring(phrase, 1, room - 1), F.lit("…"))).otherwise(phrase)
        before, after = text.split("%s")
        filled = F.when(rule_id == rule, F.concat(F.lit(before), short, F.lit(after))).otherwise(filled)
    safe = F.when(verdict == 1, FALLBACK[1]).otherwise(FALLBACK[0])
    return F.when(filled.isNotNull() & (phrase != "") & F.length(filled).between(LEAST, MOST), filled).otherwise(safe)


def explained(features: DataFrame) -> DataFrame:
    """id, result: explanation and verdict of rule features (undecided: the fallback of prediction, else of 1)."""
    first = F.get_json_object("text_evidence_json", "$[0].text")
    verdict = F.coalesce(F.col("text_rule_verdict").cast("int"), F.col("prediction").cast("int") if "prediction" in features.columns else F.lit(1))
    return features.select("id", F.concat(explanation(F.col("text_rule_id"), first, verdict), verdict.cast("string")).alias("result"))


def validate_submission(submission: DataFrame, ids: DataFrame) -> None:
    """One result for each id: a comment of LEAST to MOST characters, then 0 or 1."""
    problems = [] if submission.columns == ["id", "result"] else ["columns are not id, result"]
    if not problems:
        size = F.length("result") - 1
        bad = violations(submission, {"result is not a comment and a verdict": F.col("result").isNull() | ~F.col("result").rlike("(?s)[01]$"), "comment length": ~size.between(LEAST, MOST)})
        problems += [f"{k}: {n}" for k, n in bad.items()]
        if not submission.select("id").exceptAll(ids.select("id")).isEmpty() or not ids.select("id").exceptAll(submission.select("id")).isEmpty():
            problems.append("ids are not those of the input, once each")
    demand(problems, "submission")
