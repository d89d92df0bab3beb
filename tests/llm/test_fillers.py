from caselight.llm import fillers
from caselight.llm.fillers import TokenModel, cleaned, fit_tokens

LINES = [f"{s} the {a} uh, {b} is {c}." for s in ("So", "Now", "But") for a in ("map", "tool", "plan") for b in ("page", "file") for c in ("late", "safe", "long")] + ["They like the plan.", "We like the map.", "You know the way."] * 20 + ["Now um, we are late.", "er, The page is safe."] * 10


def test_phrases_by_context():
    model = fit_tokens(LINES)
    assert cleaned("The map is like, late.", model) == ("The map is late.", True)
    assert cleaned("They like the plan.", model) == ("They like the plan.", True)


def test_the_model_decides(monkeypatch):
    model = fit_tokens(LINES)
    held_out = [("So the like, plan is late.", 1), ("We like the file.", 0), ("Now you know, we are safe.", 1), ("You know the page.", 0)]
    right = lambda m: sum((len(cleaned(t, m)[0].split()) < len(t.split())) == bool(y) for t, y in held_out)
    assert right(model) == len(held_out)
    for constant in (1.0, -1.0):
        monkeypatch.setattr(fillers, "score_row", lambda m, x, c=constant: c)
        assert right(model) < len(held_out)


def test_marks_do_not_hang_on_a_filler():
    for text in ("well , ok then", "um well , ok then"):
        assert cleaned(text, TokenModel()) == ("well, ok then", True)
    assert cleaned("wait. We got it. uh... As agreed", TokenModel())[0] == "wait. We got it. As agreed"


def test_edges():
    for text in ("", " ", "Um.", "uhhhm, ermm", "[noise]", "*coughs*- *coughs*", "…"):
        assert not cleaned(text, TokenModel())[1], text
    assert fit_tokens([]).trees is None
    assert cleaned("x" * 100_000, TokenModel()) == ("x" * 100_000, True)
    assert cleaned("He met Erma and her mum.", TokenModel()) == ("He met Erma and her mum.", True)
