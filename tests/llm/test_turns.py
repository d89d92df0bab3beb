import pandas as pd

from caselight.llm import turns as T
from caselight.llm.turns import read_line, resolved, speaker_turns

PEOPLE = '[{"spk_id": "1", "spk_name": "Pascal Kelstead"}, {"spk_id": "2", "spk_name": "Leonardo Pellhaven"}]'


def test_labels():
    for label in ("Pascal", ">> Pascal", " Pascal:", "KELSTEAD, PASCAL", "P. Kelstead", "Pascal K.", "spk1", "SPK_1", "Speaker 1", "Pascal Kelstead (Orion)", "Pascal Kelstead - host", "Pascal Kelsteda"):
        assert resolved(label, PEOPLE)[0] == "1", label
    assert resolved("Zelda", PEOPLE)[0] is None
    assert resolved("Pascal", None)[0] is None


def test_lines():
    assert read_line(None, "00:00:39.727 --> 00:00:41.627\nLeonardo (Customer): um, yes", None, PEOPLE) == (39727.0, "2", 2, True, "yes", True)
    for text in ("Um. [laughter]", "...", "*coughs*- *coughs*", "uhm -  [Applause]", "[00:01:27]", "", None, "hmm ((pause))"):
        assert not read_line("Pascal", text, 5.0, PEOPLE)[5], text
    assert read_line("Pascal", "The- the app may hmm, be clear, you know, on Thursday.", 1.0, PEOPLE)[4] == "The app may be clear, on Thursday."
    assert read_line("Pascal", "They like the form.", 1.0, PEOPLE)[4] == "They like the form."


def test_turns(spark):
    rows = [
        (1, 1, 1, "Pascal", "Hello there.", 1000.0), (2, 1, 1, "Pascal", "Hello there.", 1000.0), (3, 1, 2, "", "And more.", 2000.0), (4, 1, 9, "spk2", "Right.", 3000.0), (5, 1, 3, "Leonardo", "uh [noise]", 3500.0), (6, 1, 4, None, "Pascal Kelstead: [00:00:04] Yes.", 4000.0),
        (7, 2, 2, "Speaker 2", "Second.", 0.0), (8, 2, 1, "Pascal", "First.", None), (9, 3, 1, "Who", "Nobody knows.", 5.0), (10, 1, 5, "Pascal", None, 5000.0),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "turn_row_id long, call_id long, line_no int, speaker string, text string, start_ms double, speakers string")
    people = [("1", "Pascal Kelstead"), ("2", "Leonardo Pellhaven")]
    calls = spark.createDataFrame([(1, people), (2, people), (3, None)], "call_id long, speakers array<struct<spk_id:string,spk_name:string>>")
    got = sorted((r.call_id, r.turn_no, r.spk_id, r.start_ms, r.text) for r in speaker_turns(turns, calls).collect())
    assert [g[:4] for g in got] == [(1, 1, "1", 1000), (1, 2, "2", 3000), (1, 3, "1", 4000), (2, 1, "1", 0), (2, 2, "2", 0)]
    assert got[0][4] == "Hello there. And more."
    assert speaker_turns(turns.limit(0), calls).count() == 0


def test_slips_hide_the_target():
    names = {"1": "Pascal Kelstead", "2": "Leonardo Pellhaven"}
    rows = [(names[spk], PEOPLE, spk, "1", 30.0 if spk == "2" else 2.0, 9.0, 9.0) for spk in "12" * 300]
    x, y = T.training_rows(pd.DataFrame(rows, columns=["label", "people", "spk", "prev", "gap", "size", "before"]))
    hidden = x[:, 0] == 0
    assert set(y[hidden]) == {0.0, 1.0}
    column = T.fit(x[hidden], y[hidden])
    assert column["trees"][0]["feature"] == 2


def test_the_model_decides_unsure_lines(spark, monkeypatch):
    rows = [(1, i, ("Leonardo Pellhaven" if i % 3 == 0 else "Pascal Kelstead"), f"Line {i}.", 1000.0 * i) for i in range(300)] + [(1, 300, "Leonardo Pelhavven", "Unsure.", 300_000.0), (1, 301, None, "After.", 301_000.0)]
    turns = spark.createDataFrame(rows, "call_id long, line_no int, speaker string, text string, start_ms double")
    calls = spark.createDataFrame([(1, [("1", "Pascal Kelstead"), ("2", "Leonardo Pellhaven")])], "call_id long, speakers array<struct<spk_id:string,spk_name:string>>")
    said = lambda: {r.clean: (r.speaker, r.opens) for r in T.attributed(turns, calls).collect()}
    fitted = said()
    assert (fitted["Unsure."], fitted["After."]) == (("2", 1), ("2", 0))
    monkeypatch.setattr(T, "fit", lambda x, y: {"base": -5.0, "rate": 0.4, "trees": []})
    never = said()
    assert (never["Unsure."], never["After."]) == (("1", 0), ("1", 0))
    assert never["Line 3."] == fitted["Line 3."] == ("2", 1)


def test_a_line_without_time_stays_behind_the_one_before(spark):
    rows = [(1, 1, "Pascal", "One.", 1000.0), (1, 2, "Leonardo", "Two.", 2000.0), (1, 3, "Pascal", "Three.", None), (1, 4, "Leonardo", "Four.", 4000.0), (1, 500, "Pascal", "Late.", None)]
    turns = spark.createDataFrame(rows, "call_id long, line_no int, speaker string, text string, start_ms double")
    calls = spark.createDataFrame([(1, [("1", "Pascal Kelstead"), ("2", "Leonardo Pellhaven")])], "call_id long, speakers array<struct<spk_id:string,spk_name:string>>")
    got = [(r.spk_id, r.start_ms, r.text) for r in speaker_turns(turns, calls).orderBy("turn_no").collect()]
    assert got == [("1", 1000, "One."), ("2", 2000, "Two."), ("1", 2000, "Three."), ("2", 4000, "Four."), ("1", 4000, "Late.")]
