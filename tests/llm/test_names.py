import pytest

from minuteworks.llm import names as N

MEMBERS = [
    (1, "Rolf", "Lüderhoff", "abc", ["rat", "a1"]), (2, "Susanne", "Brandgruber", "xyz", ["rat"]), (3, "Jürgen", "Brandgruber", "abc", ["rat"]),
    (4, "Elisabeth", "Immenbach-Pöhlsiek", None, ["a1"]), (5, None, None, "abc", ["rat"]), (6, "Karl", "Ziemkehoff", "abc", None),
]
FACTIONS = [("abc", "Bürgerliche Mitte Lindenrode", "BML"), ("xyz", "Grüne Stadtliste", "GSL"), ("hkv", "Heimat- und Kulturverein", "HuK"), ("fwt", "Freie Wählergemeinschaft Talbrück", "FWT")]


def link(spark, rows):
    data = spark.createDataFrame(rows, "id long, document_id long, last_name_extracted string, faction_extracted string, entry string, block string")
    docs = spark.createDataFrame([(10, "rat"), (11, "a1"), (12, None)], "id long, gremium_key string")
    members = spark.createDataFrame(MEMBERS, "member_id long, first_name string, last_name string, faction_key string, gremium_keys array<string>")
    factions = spark.createDataFrame(FACTIONS, "faction_key string, name string, short_name string")
    return {(r["row_id"], r["field"][:4]): r["entity_key"] for r in N.link_attendance(data, docs, members, factions).where("not exact").collect()}


PERSONS = [
    ("LÜDERHOFF", 10, None, "1"), ("Lüderhof", 10, None, "1"), ("Luederhoff, R.", 10, None, "1"), ("L ü d e r h o f f", 10, None, "1"), ("Herr Dr. Lüderhoff (ab 17:20 Uhr)", 10, None, "1"),
    ("Rolf Lüderhoff", 10, None, "1"), ("Lderhoff", 10, None, "1"), ("Lüderh0ff", 10, None, "1"), ("Lüderho.", 10, None, "1"), ("S. Brandgruber", 10, None, "2"), ("Jürgen Brandgruber", 10, None, "3"),
    ("BRANDGRUBER", 10, "GSL", "2"), ("Brandgruber (J.)", 10, None, "3"), ("Pöhlsiek-Immenbach", 11, None, "4"), ("I.-Pöhlsiek", 11, None, "4"), ("Lisbeth Immenbach-Pöhlsiek", 11, None, "4"),
    ("BRANDGRUBER", 10, None, None), ("Gerda Lüderhoff", 10, None, None), ("Brandgruber S.", 11, None, None), ("Wolbeckmann", 10, None, None), ("", 10, None, None), (None, 10, None, None), ("LÜDERHOFF", 12, None, None), ("LÜDERHOFF", 99, None, None), ("…", 10, None, None),
]
GROUPS = [
    ("BML", "abc"), ("B.M.L.", "abc"), ("Fraktion BML", "abc"), ("Bürgerliche Mitte Lindenrode (BML)", "abc"), ("Bürgerl. Mitte Lindenrode", "abc"), ("Bürgermitte", "abc"), ("Brgerliche Mitte Lindenrode", "abc"), ("Bürgerliche Mitte", "abc"),
    ("Grüne Liste Stadt", "xyz"), ("Die Grüne Stadtliste", "xyz"), ("Stadtliste Grüne", "xyz"), ("(GSL)", "xyz"), ("Kultur- und Heimatverein", "hkv"), ("Heimat/Kultur-Verein", "hkv"), ("Freie Wähler Talbrück", "fwt"), ("Fr. Wählergem. Talbrück", "fwt"),
    ("parteilos", None), ("Amt 79", None), ("-", None), ("", None), (None, None), ("Verwaltung", None), ("Grüne Stadtliste", None),
]


def test_persons(spark):
    got = link(spark, [(i, d, n, f, "x", "y") for i, (n, d, f, _) in enumerate(PERSONS)])
    for i, (name, _, _, entry) in enumerate(PERSONS):
        assert got.get((i, "last")) == entry, name


def test_groups(spark):
    got = link(spark, [(i, 10, None, g, "x", "y") for i, (g, _) in enumerate(GROUPS)])
    for i, (name, entry) in enumerate(GROUPS):
        assert got.get((i, "fact")) == entry, name


def test_empty_and_repeated(spark):
    assert link(spark, []) == {}
    assert len(link(spark, [(1, 10, "LÜDERHOFF", None, "", "")] * 2)) == 1


@pytest.mark.parametrize("word", ["", "a", "x" * 5000])
def test_forms_of_odd_words(word):
    assert isinstance(N.person_mention(word, frozenset()), list)


def test_nicknames_of_people_outside_the_members_table(spark):
    """Given names in general use, none of them taken from the tables of the tests."""
    people = [("Heinrich", "Grote"), ("Johannes", "Grote"), ("Josef", "Grote"), ("Alexander", "Grote"), ("Michael", "Grote"), ("Thomas", "Grote"), ("Andreas", "Grote"), ("Wilhelm", "Grote")]
    typed = {"Heinz Grote": "Heinrich", "Grote, Hannes": "Johannes", "Sepp Grote": "Josef", "Sascha Grote": "Alexander", "Micha Grote": "Michael", "Tom Grote": "Thomas", "Andi Grote": "Andreas", "Willy Grote": "Wilhelm"}
    entries = spark.createDataFrame([(f, f, n, None, ["rat"]) for f, n in people], "entry string, first_name string, last_name string, hint string, blocks array<string>")
    mentions = spark.createDataFrame([("rat", t, None) for t in typed], "block string, name string, hint string")
    got = {r["name"]: r["entry"] for r in N.link_persons(mentions, entries).collect()}
    assert got == typed
    without = {r["name"]: r["entry"] for r in N.link_persons(spark.createDataFrame([("rat", "Grote", None)], mentions.schema), entries).collect()}
    assert without == {}


def test_too_many_given_names_raise(spark):
    import pytest

    entries = spark.createDataFrame([(str(i), f"N{i}", "Grote", None, ["rat"]) for i in range(5)], "entry string, first_name string, last_name string, hint string, blocks array<string>")
    with pytest.raises(ValueError):
        N.link_persons(spark.createDataFrame([("rat", "Grote", None)], "block string, name string, hint string"), entries, max_given=3)
