from caselight.llm.names import link_names, linked_pairs, parsed

SAME = [
    ["Anselm Drenland", "anselm drenland", "Drenland, Anselm", "Drenland Anselm", "A. Drenland", "adrenland", "Anselm Drenladn", "Anselm J. Drenland", "Anselm Drenland - FDE", "anselm.drenland@acme.example", "Anselm D."],
    ["Frederick Lindby", "Fritz Lindby", "Fred Lindby", "Lindby, Frederick"],
    ["Björk Hobmark", "bjork.hobmark", "BJÖRK HOBMARK", "Bjork Hobmark [contractor]"],
    ["Site Reliability", "SiteReliability", "site-reliability", "Site Relibility", "Site Reliability Team"],
]


def test_classes(spark):
    rows = [("acme", n) for c in SAME for n in c] * 2 + [("other", "Anselm Drenland"), ("acme", None), ("acme", " "), (None, "Anselm Drenland")]
    out = link_names(spark.createDataFrame(rows, "grp string, name string"))
    got = {}
    for r in out.collect():
        got.setdefault((r.grp, r.class_id), set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, [*SAME, ["Anselm Drenland"]]))
    pairs = {(r.grp, r.name_a, r.name_b) for r in linked_pairs(out).collect()}
    assert pairs == {("acme", a, b) for c in SAME for a in c for b in c if a < b}


def test_relatives_and_ambiguous_initials(spark):
    rows = [("acme", n) for n in ("Edda Malaro", "Margaret Malaro", "Elena Malaro", "E. Malaro", "Margaret M.")]
    out = {r.name: r.class_id for r in link_names(spark.createDataFrame(rows, "grp string, name string")).collect()}
    assert len({out["Edda Malaro"], out["Margaret Malaro"], out["Elena Malaro"], out["E. Malaro"]}) == 4
    assert out["Margaret M."] == out["Margaret Malaro"]


def test_no_names(spark):
    assert link_names(spark.createDataFrame([], "grp string, name string")).count() == 0
    assert parsed(None)[0] == parsed("..")[0] == "none"
    assert parsed("x" * 10_000)[0] == "part"


def test_nicknames_that_are_also_short_team_words(spark):
    classes = [["Bill Smith", "William Smith", "Smith, William", "Smith, Bill"], ["Kim Site", "Site, Kim"], ["Billing Operations", "Bill. Ops", "billing-operations", "Biling Operations"]]
    rows = [("acme", n) for c in classes for n in c]
    got = {}
    for r in link_names(spark.createDataFrame(rows, "grp string, name string")).collect():
        got.setdefault(r.class_id, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes))


def test_no_link_is_lost_to_a_frequent_neighbour(spark):
    rows = [("acme", "Marten, Dax"), ("acme", "Marsen, Dax")]
    pair = lambda extra: len({r.class_id for r in link_names(spark.createDataFrame(rows + extra, "grp string, name string")).filter("name LIKE 'Mar_en,%'").collect()})
    assert pair([]) == 1
    assert pair([("acme", "Mareno, Dax")] * 5) == 1


def test_recall_on_generated_slips(spark):
    import random

    rng = random.Random(11)
    given, surname = ["Anselm", "Isolde", "Kenji", "Theodore", "Magdalena", "Ruben", "Odette", "Cyprian"], ["Drenland", "Fitchtead", "Quarholm", "Ostfeld", "Varberg", "Pellhaven", "Brinmark", "Yargrove"]
    rows, want = [], set()
    for g in given:
        for s in surname:
            name = f"{g} {s}"
            rows += [("acme", name)] * 3
            for _ in range(2):
                i = rng.randrange(1, len(name) - 1)
                slip = rng.choice([name[:i] + name[i + 1 :], name[:i] + name[i] + name[i:], name[:i] + "x" + name[i + 1 :], name[:i] + name[i + 1] + name[i] + name[i + 2 :]])
                if " " not in name[i : i + 2] and slip != name and " " not in (slip[0], slip[-1]) and len(slip.split()) == 2:
                    rows.append(("acme", slip))
                    want.add((name, slip))
    of = {r.name: r.class_id for r in link_names(spark.createDataFrame(rows, "grp string, name string")).collect()}
    assert sum(of[a] == of[b] for a, b in want) >= 0.95 * len(want)
    assert len(set(of.values())) >= len(given) * len(surname) * 0.95


def test_initials_follow_a_profile_that_is_merged_itself(spark):
    rows = [("acme", n) for n in ("Ilse Carry", "Ilse Carry", "Ilse Carrby", "Ilse  Carrby", "I. Carrby", "I Carrby", "Ilse C.")]
    assert len({r.class_id for r in link_names(spark.createDataFrame(rows, "grp string, name string")).collect()}) == 1
