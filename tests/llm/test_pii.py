import pytest

from caselight.llm.pii import find_pii, sanitised, shaped


@pytest.mark.parametrize(
    ("text", "kind", "item"),
    [
        ("write to a_b90@x.example now", "EMAIL", "a_b90@x.example"), ("mail A-B @ x.test", "EMAIL", "A-B @ x.test"), ("of w.b [at] x [dot] co [dot] example twice", "EMAIL", "w.b [at] x [dot] co [dot] example"), ("k(at)p.invalid", "EMAIL", "k(at)p.invalid"),
        ("tel:+1 299 555 0155", "PHONE", "+1 299 555 0155"), ("on (263) 555-0160 before", "PHONE", "(263) 555-0160"), ("at five five five, oh one six seven after", "PHONE", "five five five, oh one six seven"), ("ring 030/23125-136 first", "PHONE", "030/23125-136"),
        ("delete 000 40 4240 from", "ID_NUMBER", "000 40 4240"), ("is QQ 93 06 20 C, ok", "ID_NUMBER", "QQ 93 06 20 C"), ("44-381.058-4 x", "ID_NUMBER", "44-381.058-4"), ("X01728871, I think", "ID_NUMBER", "X01728871"),
        ("at Flat 4, 2126 Daskcroft Row, Ironmere QX6 7TR has", "ADDRESS", "Flat 4, 2126 Daskcroft Row, Ironmere QX6 7TR"), ("to 69 rue des Eskstead, 00595 Fennbridge.", "ADDRESS", "69 rue des Eskstead, 00595 Fennbridge"), ("to Burlvalegasse 49, 00364 Kilnhurst has", "ADDRESS", "Burlvalegasse 49, 00364 Kilnhurst"),
    ],
)
def test_shapes(text, kind, item):
    assert [(k, text[a:b]) for k, a, b, *_ in shaped(text, False) if k in ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS")] == [(kind, item)]


@pytest.mark.parametrize("text", ["Batch 555-239-77 was replayed.", "Meter 4471-8820-862 reads zero.", "Order 900114-22-273", "node at 192.0.2.853", "Build 2024.10.691-555", "00:02:56.458 --> 00:02:58.358", "Ping @channel in thread 16.", "Street light project, phase 476, is open.", "", "a" * 200_000])
def test_look_alikes(text):
    assert [x for x in shaped(text, True) if x[0] in ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS")] == []


def test_names_by_disclosure(spark):
    people = spark.createDataFrame([(n,) for n in ["Halsson, Esme", "esme.halsson@a.example", "Kenji B. Ostfeld", "kenji.ostfeld", None, ""] * 3], "name string")
    texts = [
        (1, "Please call Esme Løvdorn or Ostfeld, Kenji about Harbor Vault.", False), (2, "Esme Halsson: so KENJI VARBERG called.", True), (3, "Harbor Vault is full. Harbor Vault failed.", False), (4, None, False), (5, "", False),
        (6, "Ask Platform Engineering about Harbor Vault.", False),
    ]
    df = spark.createDataFrame([("t", *x, "extra", f"e{x[0]}") for x in texts], "src_table string, row_id long, text string, labelled boolean, name string, entity string")
    found = find_pii(df, people)
    by_row = {i: t for i, t, _ in texts}
    assert sorted((r.row_id, r.pii_type, by_row[r.row_id][r.start_char : r.end_char]) for r in found.collect()) == [(1, "NAME", "Esme Løvdorn"), (1, "NAME", "Ostfeld, Kenji"), (2, "NAME", "KENJI VARBERG")]
    clean = {r.row_id: r.clean_text for r in sanitised(df.select("src_table", "row_id", "text"), found).collect()}
    assert clean[1] == "Please call [NAME] or [NAME] about Harbor Vault."
    assert clean[3] == by_row[3]
    assert clean[4] is None
    assert find_pii(df.limit(0), people).count() == 0


def test_copies_do_not_hide_a_name(spark):
    people = spark.createDataFrame([(f"{g}.{s}",) for g in ("esme", "kenji", "orla", "tomas", "wanda", "piet", "runa", "idris", "vera", "lars") for s in ("halsson", "ostfeld", "varberg")] * 2, "name string")
    texts = [("t", i, "Please call Esme Halsson today.", False) for i in range(400)] + [("t", 1000 + i, f"See Harbor Vault{'abcdefghij'[i]} again.", False) for i in range(10)]
    df = spark.createDataFrame([(*x, None) for x in texts], "src_table string, row_id long, text string, labelled boolean, entity string")
    found = find_pii(df, people).filter("pii_type = 'NAME'")
    assert found.count() == 400


def test_disclosure_decides_spans(spark):
    own = [("t", i, f"account{i % 6}", f"Call +1 299 555 01{i:02d} or the hotline +1 299 555 9999 today.", False) for i in range(60)]
    copies = [("t", 100 + i, "account0", "Ring 030/23125-136 first.", False) for i in range(40)]
    df = spark.createDataFrame(own + copies, "src_table string, row_id long, entity string, text string, labelled boolean")
    people = spark.createDataFrame([], "name string")
    text = {r[1]: r[3] for r in own + copies}
    by = {}
    for bits in (-1.0, 0.5, 9.0):
        found = find_pii(df, people, span_bits=bits).collect()
        by[bits] = [text[r.row_id][r.start_char : r.end_char] for r in found]
    assert (len(by[-1.0]), len(by[0.5]), len(by[9.0])) == (160, 100, 0)  # everything; all but the hotline; nothing
    assert "+1 299 555 9999" not in by[0.5] and by[0.5].count("030/23125-136") == 40


def test_overlapping_spans_are_replaced_together(spark):
    df = spark.createDataFrame([("t", 1, "Call Anna Maria Schmidt today.")], "src_table string, row_id long, text string")
    found = spark.createDataFrame([("t", 1, "NAME", 5, 15), ("t", 1, "NAME", 10, 23)], "src_table string, row_id long, pii_type string, start_char long, end_char long")
    assert sanitised(df, found).first().clean_text == "Call [NAME] today."


def test_little_is_left_after_sanitising(spark):
    people = spark.createDataFrame([(f"{s}, {g}",) for g in ("Esme", "Kenji", "Orla") for s in ("Halsson", "Ostfeld")] * 2, "name string")
    texts = [("t", i, f"e{i % 5}", f"Ask {g} {s}{i} at {g.lower()}{i}@x.example or +1 299 555 01{i:02d}; badge 000 40 42{i:02d}.", False) for i, (g, s) in enumerate((g, s) for g in ("Esme", "Kenji", "Orla") for s in ("Halsson", "Ostfeld", "Varberg"))]
    df = spark.createDataFrame(texts, "src_table string, row_id long, entity string, text string, labelled boolean")
    clean = sanitised(df, find_pii(df, people)).join(df.drop("text"), ["src_table", "row_id"]).withColumnRenamed("clean_text", "text")
    assert find_pii(df, people).count() == 4 * len(texts)
    assert find_pii(clean, people).count() == 0
