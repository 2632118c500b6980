import random

from shelfmark.functions import signals as S
from shelfmark.operators import rules


def plain(texts, signals, window):
    """Every pattern over every text."""
    out = []
    for name, signal in signals.items():
        for source, text in texts.items():
            void = [m.span() for p in signal.excluded_by for m in rules._compiled(p).finditer(text)]
            spans = {m.span(): m.group().strip() for p in signal.patterns for m in rules._compiled(p).finditer(text)}
            out += [(name, source, spans[s], *s) for s in sorted(s for s in spans if all(s[1] + window < a or b + window < s[0] for a, b in void))]
    return out


def test_patterns_do_not_run_where_nothing_can_match(monkeypatch):
    run, real = [], rules._compiled
    monkeypatch.setattr(rules, "_compiled", lambda p: (run.append(p), real(p))[1])
    texts = {"name": "plain words", "description": "nothing of the kind stands here " * 50}
    assert [rules.phrase_matches(texts, own) for own in S.SIGNALS.values()] == [[], []] and not run
    assert rules.phrase_matches({"name": "BCAA 2:1:1"}, S.SIGNALS[S.SUPPLEMENT]) == [("sport_nutrition", "name", "BCAA", 0, 4)] and len(run) == 1


def test_matches_are_those_of_all_patterns():
    r = random.Random(2)
    words = "не является без газа баллон баллоны пуст в комплект входит зажигалка чехол спички БАД б.а.д. food supplement dıetary ſupplements Dietary SUPPLEMENT creatİne creatine protein сухое топливо ᲀез угольный фильтр активированным углем для рисования".split()
    found = 0
    for _ in range(400):
        texts = {k: " ".join(r.choices(words, k=r.randrange(12))) for k in ("name", "description")}
        for own in S.SIGNALS.values():
            want = plain(texts, own, S.WINDOW)
            found += len(want)
            assert rules.phrase_matches(texts, own) == want
    assert found > 500
    odd = {"x": S.Signal((r"(?:ab|c*)d?", "[aß]σ+", r"(?i:ος)\b", "(?=x)y|x"), ("q?",))}
    for text in ("", "ABD", "ΟΣ", "ος aΣ", "ßσ x", "yx"):
        assert rules.phrase_matches({"name": text}, odd, 0) == plain({"name": text}, odd, 0)
