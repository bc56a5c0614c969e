import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import name_links as N
from tidemark.llm.name_forms import organization_forms, person_forms

SCHEMA = "id string, name string, entity_type string, space string, main string, second string"


def links(spark, rows, **options):
    df = spark.createDataFrame([(*r, "s", "m", "t") for r in rows], SCHEMA)
    got = [tuple(r) for r in N.linked_names(df, **options).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


word = st.text("abc", max_size=6)


@given(word, word, word)
@settings(max_examples=300, deadline=None)
def test_distance_is_a_metric(a, b, c):
    d = lambda x, y: N.edit_distance(x, y, 99)
    assert d(a, a) == 0 and d(a, b) == d(b, a) and (a == b or d(a, b) > 0)
    assert d(a, c) <= d(a, b) + d(b, c)
    assert (N.letters(a) ^ N.letters(b)).bit_count() <= 2 * d(a, b)


def test_transposition_counts_once():
    assert N.edit_distance("abcd", "abdc", 9) == 1 and N.edit_distance("ca", "abc", 9) == 2 and N.edit_distance("abc", "xyz", 1) == 2


def test_forms():
    assert person_forms("Dr. Stokorguzder, Sasha")[0] == ("person", "stokorguzder", "alexander")
    assert person_forms("A. Stokorguzder") == person_forms("Stokorguzder, A.") == [("initial", "stokorguzder", "a")]
    assert person_forms("Tabumpek Celeste jun.")[0] == ("person", "tabumpek", "celeste")
    assert person_forms("") == person_forms("...") == [] and person_forms("User") == [("alone", "user", "")]
    assert organization_forms("Brewing Brothers of Nastabish") == organization_forms("The Nastabish Brew. Bros., S.A.") == [("organization", "nastabish", "brewing brothers")]
    assert organization_forms("X-software University (XSU)") == [("organization", "x", "software university")]


def test_variants_meet_and_relatives_do_not(spark):
    rows = [
        ("1", "James Skindapantewrez", "person"), ("2", "Skindapantewrez, James", " PERSON"), ("3", "jimmy skindapanteurez", "Person "), ("4", "Mx James R. Skindapatnewrez", "person"), ("5", "J. Skindapantewrez", "person"),
        ("6", "Patricia Skindapantewrez", "person"), ("7", "James Skindapantewrez", "place"), ("8", "Skindapantewrez Timber Brothers", "org"), ("9", "The Skindapantewrez Tbr Bros. Ltd", "organisation"), ("10", "Skindapantewrez Ferry Brothers", "organization"),
        ("11", None, "person"), (None, "James Skindapantewrez", "person"), ("12", "", "person"), ("1", "James Skindapantewrez", "person"), ("13", "x", None),
    ]
    same = ["1", "2", "3", "4", "5"]
    assert links(spark, rows) == {(a, b) for a in same for b in same if a < b} | {("8", "9")}


def test_an_initial_that_fits_several_is_linked_to_none(spark):
    rows = [("1", "Rosa Giduntepriff", "person"), ("2", "Robert Giduntepriff", "person"), ("3", "R. Giduntepriff", "person"), ("4", "Giduntepriff, R.", "person")]
    assert links(spark, rows) == {("3", "4")}


def test_cells_lose_no_pair_and_blocks_change_nothing(spark):
    rng = random.Random(9)
    given = ["omar", "amara", "rosa", "femi", "emre", "peter"]
    main = ["".join(rng.choice("abde") for _ in range(8)) for _ in range(30)]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :], w])

    points = sorted({("person", slip(rng.choice(main)), slip(rng.choice(given))) for _ in range(300)})
    keys = spark.createDataFrame(points, "space string, main string, second string")
    want = {(a, b) for a in points for b in points if a < b and N.same_name(a, b, 2)}
    for block in (4000, 20):
        got = {((r[0], r[1], r[2]), (r[3], r[4], r[5])) for r in N.near_points(keys, 2, block).collect()}
        assert got == want


def test_empty(spark):
    assert links(spark, []) == set()


def test_many_equal_names_go_through_the_first(spark):
    rows = [(f"i{k}", "Omar Gibuzontox", "person") for k in range(6)] + [("j", "Omar Gibuzontx", "person"), ("s", "O. Gibuzontox", "person")]
    got = links(spark, rows, expand=3)
    assert got == {("i0", f"i{k}") for k in range(1, 6)} | {("i0", "j"), ("i0", "s"), ("j", "s")}
    assert len(links(spark, rows)) == 8 * 7 // 2


def test_no_pair_is_lost_where_few_names_are_pivots_and_cells_are_split(spark):
    rng = random.Random(21)
    given = ["francisco", "leonard", "nora", "omar", "noor", "nell", "ned", "ted", "len", "ben", "hana", "nadia", "marek", "emre", "greta", "peter"]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "u" + w[k + 1 :], w])

    main = ["".join(rng.choice("abde") for _ in range(7)) for _ in range(12)]
    points = {("person", slip(rng.choice(main)), slip(slip(rng.choice(given)))) for _ in range(500)}
    points |= {("organization", slip(rng.choice(main)), " ".join(slip(w) for w in rng.sample(["brewing", "brothers", "timber", "ferry"], 2))) for _ in range(150)}
    points |= {(space, slip(rng.choice(main)), rng.choice("abc")) for space in ("initial", "expanded") for _ in range(60)}
    points = sorted(p for p in points if p[2])
    keys = spark.createDataFrame(points, "space string, main string, second string")
    # a full name and an initial are matched by initial, the other spaces by themselves
    together = lambda a, b: a[0] == b[0] != "expanded" or {a[0], b[0]} == {"initial", "expanded"}
    want = {(a, b) for a in points for b in points if a < b and together(a, b) and N.same_name(a, b, 2)}
    for options in ({"n_pivots": 5}, {"n_pivots": 5, "crowd": 40, "inner": 6}, {"n_pivots": 2, "crowd": 25, "inner": 3, "block": 30}):
        got = {((r[0], r[1], r[2]), (r[3], r[4], r[5])) for r in N.near_points(keys, 2, options.pop("block", 4000), **options).collect()}
        assert {p for p in got if together(*p)} == want


def test_a_split_is_taken_only_where_it_saves_work(spark):
    rng = random.Random(5)
    near = {("person", f"{a * 9}{b}{c}", "omar") for a in "abcdnopq" for b in "efgh" for c in "ijklm"}  # eight knots of names
    far = {("person", "".join(rng.choice("abcdefghiklmnoprst") for _ in range(9)), "rosa") for _ in range(80)}
    placed = N.placed_points(spark.createDataFrame(sorted(near | far), "space string, main string, second string"), 2, crowd=50, inner=8)
    sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    assert sizes["person:rosa"] == 80 and "person:omar" not in sizes
    assert sum(n * n for cell, n in sizes.items() if cell.startswith("person:omar")) < 0.5 * 160 * 160


def test_name_classes(spark):
    rows = [("1", "James Skindapantewrez", "person"), ("2", "Skindapantewrez, James", "person"), ("3", "James Skindapanteurez", "person"), ("4", "Nastabish Brewing", "org"), ("4", "Nastabish Brewing", "org"), ("5", None, "org")]
    df = spark.createDataFrame([(*r, "s", "m", "t") for r in rows], SCHEMA)
    got = {(r.id, r.kind): (r.copies, r.links) for r in N.name_classes(df).collect()}
    assert got == {("1", "person"): (2, 1), ("2", "person"): (2, 1), ("3", "person"): (1, 1), ("4", "organization"): (1, 0)}
    assert len({r.class_id for r in N.name_classes(df).collect()}) == 3 and N.name_classes(df.limit(0)).count() == 0
