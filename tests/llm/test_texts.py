import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import line_shapes as LS
from tidemark.llm import personal_data as PD
from tidemark.llm import phrase_index as PI
from tidemark.llm import spm_codec as SC
from tidemark.llm.page_layout import reading_order

BOX = "array<struct<x0 int, y0 int, x1 int, y1 int, conf int>>"


# ------------------------------------------------------------ personal data
def found(text):
    return [(text[a:b], kind) for a, b, kind in PD.detect(text)]


def test_pieces_as_written():
    text = "Ask Dr. Rosa Giduntepriff or Mx NOOR BRAVOGEKSAX at rosa_g (at) example (dot) org or ring +44 (0)7700 900635, near Belmonik."
    assert found(text) == [("Rosa Giduntepriff", "name"), ("NOOR BRAVOGEKSAX", "name"), ("rosa_g (at) example (dot) org", "email"), ("+44 (0)7700 900635", "phone")]
    assert PD.redact(text) == "Ask Dr. [NAME] or Mx [NAME] at [EMAIL] or ring [PHONE], near Belmonik."


@pytest.mark.parametrize(("text", "want"), [
    ("the quarry belongs to friedrich quunurodmon who", [("friedrich quunurodmon", "name")]),
    ("I talked to Ms Milmerkashkalt, Amara about it", [("Milmerkashkalt, Amara", "name")]),
    ("Is E. Kerkobuntoff's oven at Belhaven?", [("E. Kerkobuntoff", "name")]),
    ("He gave 666-06-5936 as proof", [("666-06-5936", "id_number")]),
    ("Order number 666-06-5936 and Part no. 5071-47-4852, version 960.482, ticket 302-849", []),
    ("shows tax id 06 888 210 816, passport no. Y1957223, NI number QQ 19 28 78 C and DNI 00914716F.", [("06 888 210 816", "id_number"), ("Y1957223", "id_number"), ("QQ 19 28 78 C", "id_number"), ("00914716F", "id_number")]),
    ("Send it to 219a Kesdenburg Rd, Selton or 12, rue de Norton or Calle Ashel 30 or Falhamstraße 18 before", [("219a Kesdenburg Rd, Selton", "address"), ("12, rue de Norton", "address"), ("Calle Ashel 30", "address"), ("Falhamstraße 18", "address")]),
    ("or else on (415) 555-0163 ext. 12 or 030/23125-170 or 617.555.0177 or 0012125550181", [("(415) 555-0163", "phone"), ("030/23125-170", "phone"), ("617.555.0177", "phone"), ("0012125550181", "phone")]),
    ("Node 192.0.2.141 served 2025-03-22 to 2025-03-14 at 16:20, the rose may bloom and will have to wait", []),
    ("call oh one six three two nine six oh one four nine", [("oh one six three two nine six oh one four nine", "phone")]),
    ("", []), (None, []),
])
def test_kinds(text, want):
    assert found(text) == want


def test_lookalikes_map_back():
    text = "écrire à rоsa.g@еxample.org ou Rоsa"  # Cyrillic o and e inside
    assert found(text) == [("rоsa.g@еxample.org", "email"), ("Rоsa", "name")]


@given(st.text(max_size=120))
@settings(max_examples=150, deadline=None)
def test_any_text_keeps_what_is_not_found(text):
    spans = PD.detect(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans)
    if not spans:
        assert PD.redact(text) == text


def test_personal_frames(spark):
    rows = [("e1", "Ask Rosa about it", None), ("e1", "Ask Rosa about it", None), (None, "x", ""), ("e2", "word " * 50000 + "Rosa", "Omar")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "id string, content string, summary string, kind string")
    got = sorted(tuple(r) for r in PD.personal_pieces(df).collect())
    assert got == [("e1", "content", "name", 5), ("e2", "content", "name", 250001), ("e2", "summary", "name", 1)]
    assert PD.redacted(df).count() == 4 and PD.personal_pieces(df.limit(0)).count() == 0


# ------------------------------------------------------------ encoding
@pytest.fixture(scope="module")
def codec():
    return SC.Codec(SC.serialise(SC.read_ranks(SC.DEFAULT_VOCABULARY)))


@pytest.fixture(scope="module")
def reference():
    import os

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(SC.DEFAULT_VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_reference_and_round_trip(codec, reference, text):
    ids = codec.encode_batch([text])[0]
    assert ids == reference.encode(text, add_special_tokens=False).ids and codec.decode(ids) == text


def test_hard_texts(codec, reference):
    texts = ["it's <|endoftext|> 's", "  \n\n x", "Ⅳ ²½ ǅ", "a\x1cb\x85c\xa0d", "é" * 30000, " " * 5000, "𝔄𝔖 ﬁ ■ — �", "ſtreet x"]
    for text, ids in zip(texts, codec.encode_batch(texts)):
        assert ids == reference.encode(text, add_special_tokens=False).ids and codec.decode(ids) == text


def test_encoding_frames(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a cat", 5), (3, "a cat", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in SC.encode_corpus(df).collect())
    assert [g[1] for g in got[:2]] == [[], []] and got[2] == got[3] and len(got[2][1]) == 2
    assert {r.text for r in SC.decode_corpus(SC.encode_corpus(df)).collect()} == {"", "a cat"}
    assert SC.encode_corpus(df.limit(0)).count() == 0


# ------------------------------------------------------------ pages
def boxed(lines, x0, y0):
    return [(x, y, x + 10 * len(t), y + 20, 90) for t, x, y in zip(lines, x0, y0)]


def test_columns():
    left, right = [f"left words {i}" for i in range(5)], [f"right words {i}" for i in range(5)]
    across = [t for pair in zip(left, right) for t in pair]
    lefts = [100 if t.startswith("left") else 400 for t in across]
    tops = [y for i in range(5) for y in (100 + 25 * i, 102 + 25 * i)]
    rights = [x + 10 * len(t) for x, t in zip(lefts, across)]
    assert reading_order("\n".join(across), lefts, rights, tops) == left + right
    run = [f"{a}    {b}" for a, b in zip(left, right)]
    assert reading_order("\n".join(run), [100] * 5, [520] * 5, [100 + 25 * i for i in range(5)]) == left + right
    assert reading_order("a\nb\nc\nd", [], [], []) == ["a", "b", "c", "d"]


def words(rng, n):
    return ["".join(rng.choice("abdegiklmnoprstuvz") for _ in range(rng.randrange(3, 10))) for _ in range(n)]


def test_leaks_through_breaks_adverts_and_misreadings(spark):
    rng = random.Random(6)
    item, other = words(rng, 45), words(rng, 45)
    filler = lambda n: words(rng, n)

    def page(seq, width=6):
        return [" ".join(seq[i : i + width]) for i in range(0, len(seq), width)]

    broken = " ".join(item[5:30])
    broken = broken.replace(item[10], item[10][:2] + "-\n" + item[10][2:]).replace(item[18], item[18].replace("e", "c").replace("l", "1"))
    docs = [
        (1, "\n".join(page(filler(12) + item + filler(12)))), (2, "\n".join(page(filler(10))) + "\n" + broken + "\n" + "\n".join(page(filler(10)))),
        (3, "\n".join([*page(filler(12)), *page(item[3:15]), "FINEST LEDGER IN TOWN", "Tel. 555-0100", *page(item[15:27]), *page(filler(9))])), (4, "\n".join(page(filler(12) + item[:19] + filler(12)))),
        (5, "\n".join(page(filler(60)))), (6, None), (7, ""), (1, "\n".join(page(filler(12) + item + filler(12)))),
    ]
    df = spark.createDataFrame([(i, t, None, 9, "h") for i, t in docs], f"doc_id long, text string, line_boxes {BOX}, pos int, hits string")
    items = spark.createDataFrame([(10, " ".join(item), 1), (11, " ".join(other), 1), (12, None, 1), (13, "too short", 1), (10, " ".join(item), 1)], "item_id long, text string, at int")
    got = {(r.doc_id, r.item_id): r.words for r in PI.leaked_passages(df, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (3, 10)} and all(n >= 20 for n in got.values())
    assert PI.leaked_passages(df.limit(0), items).count() == 0 == PI.leaked_passages(df, items.limit(0)).count()


def test_a_passage_beyond_a_break_on_the_same_offset():
    item = words(random.Random(8), 40)
    seen = [*item[:8], "qqqqqqqqqqqqqqqqqqqq", "qqqqqqqqqqqqqqqqqqqq", *item[10:]]  # two neighbours misread beyond recognition
    page = PI.Page(seen, [k // 6 for k in range(len(seen))])
    assert page.longest_passage(item, [(3, 3)], 20) == 8
    assert page.longest_passage(item, [(3, 3), (15, 15)], 20) >= 20


@pytest.mark.parametrize("n_docs", [1 << 10, 1 << 20])
def test_a_candidate_does_not_depend_on_the_number_of_pages(spark, n_docs):
    n = 4
    shard = PI.index_shards(spark.createDataFrame([(1, "alpha bravo gamma delta")], "doc_id long, text string"), "doc_id", "text", None)
    folder = PI.Folder()
    terms = [int(PI.np.uint32(folder[w][1]).view(PI.np.int32)) for w in ("alpha", "bravo", "gamma", "delta")]
    anchors = [(7, k, term, n_docs >> n) for k, term in enumerate(terms)]  # each in 1 of 16 pages: 16 bits in all
    assert [(r.doc_id, r.item_id) for r in PI.candidates(shard, anchors, n_docs, "bigint", "bigint").collect()] == [(1, 7)]


def test_words_of_no_page_take_no_anchor_and_a_window_has_enough(spark):
    terms = spark.createDataFrame([(1, k, k) for k in range(20)], "item_id int, at int, term int")
    known = spark.createDataFrame([(k, 250) for k in range(6, 20)], "term int, df long")  # 6 words stand in no page; 2 bits each
    assert {r.at for r in PI.rare_anchors(terms, known, 20, 5, 1000).collect()} == set(range(6, 13))  # 6 for 12 bits, one more
    rare = known.withColumn("df", known.df - 249)
    assert {r.at for r in PI.rare_anchors(terms, rare, 20, 5, 1000).collect()} == set(range(6, 11))


def test_spam_kinds_and_their_neighbours(spark):
    ok = "The council of Markil was delayed before a large gathering, and the\nlarge school at Wicklibridge remains as it was in spite of the\nweather, and 200 persons attended during the past fortnight."
    pages = {
        "keywords": "bazaar bazaar cheap prize\ncheap school bazaar chapel\nprize cheap bazaar school\n" * 5,
        "list": "granary Branstow, granary\nAsheim, granary Beldale,\ngranary Quengate, granary\n" * 5,
        "phrases": "old market / new market / old\ncarriage / heavy market / new\ncarriage / heavy carriage /\n" * 5,
        "links": "*\nhttp://www.best-a.example.net/\n> www.b.example.org/p8\n" * 6,
        "tags": "#vestry #vestryonline\n#onlinevestry #committee\n" * 6,
        "codes": "WI-5312 regiment municipal 22.11\nWI-4346 verdict rural 30.23 best verdict\n" * 6,
        "doorway": "cheap vestry Selgate: cheap theatre\nin Dundale, theatre\ncheap vestry Norburg: cheap canal in\nTulcourt, vestry\n" * 4,
        "article": ok, "mostly article": ok + "\n" + ok + "\n#vestry #vestry\n", "few links": ok + "\nProgramme and tickets: www.a.example\n" + ok,
        "returns": "ELECTION RETURNS\n" + "\n".join(f"Town{i}: Namek {3000 + i}, Otherk {400 + i}, majority {i * 7}" for i in range(12)),
        "arrivals": "ARRIVALS\n" + "\n".join(f"Name{i}, steamer, from Port{i} with cargo, {i * 31 + 5} tons" for i in range(12)),
        "prices": "\n".join(f"Goods{i} steady {i + 3} to {i + 40} per ton" for i in range(12)), "want ads": "Wanted, a skilled hand for the\nschooner at Belstead; apply to\nGronox by letter.\n" * 6,
        "verse": "The old mill turns beside the water\nand the miller sings to his daughter\n" * 6, "empty": "", "blank": " \n ", "null": None, "long": "spam cheap " * 100000,
    }
    df = spark.createDataFrame([(n, t, None, 1.0) for n, t in [*pages.items(), ("tags", pages["tags"])]], f"doc_id string, text string, line_boxes {BOX}, share double")
    got = sorted(r.doc_id for r in LS.spam_pages(df).collect())
    assert got == sorted(["keywords", "list", "phrases", "links", "tags", "codes", "doorway", "long"])
    assert LS.spam_pages(df.limit(0)).count() == 0


def printed(seq, width=6):
    return [" ".join(seq[i : i + width]) for i in range(0, len(seq), width)]


def test_leaks_across_long_adverts_and_unreadable_spots(spark):
    rng = random.Random(12)
    item = words(rng, 60)
    blind = [*item[:10], "qqqqqqqqqqqqqqqqqqqq", "xxxxxxxxxxxxxxxxxxxx", *item[12:]]
    advert = printed(words(rng, 240))  # forty lines
    docs = [
        (1, "\n".join(printed(blind))), (2, "\n".join([*printed(item[:14]), *advert, *printed(item[14:28])])), (3, "\n".join([*printed(item[:7]), *advert, *printed(item[7:14]), *advert, *printed(item[14:23])])),
        (4, "\n".join([*printed(item[:14]), *advert])), *((k, "\n".join(printed(words(rng, 90)))) for k in range(5, 65)),
    ]
    df = spark.createDataFrame([(i, t, None) for i, t in docs], f"doc_id long, text string, line_boxes {BOX}")
    items = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in PI.leaked_passages(df, items).collect()} == {1, 2, 3}


def misread(rng, seq, share):
    swap = {"e": "c", "l": "1", "i": "l", "n": "u", "o": "0", "s": "5", "t": "f", "v": "y", "a": "d", "b": "h", "g": "q", "m": "n"}
    out = []
    for w in seq:
        k = rng.randrange(len(w))
        out.append(w[:k] + swap.get(w[k], "z") + w[k + 1 :] if rng.random() < share else w)
    return out


def test_planted_passages_are_found(spark):
    rng = random.Random(13)
    known = words(rng, 3000)
    draw = lambda n: [known[min(len(known) - 1, int(rng.expovariate(1 / 500)))] for _ in range(n)]
    items = {100 + k: draw(70) for k in range(20)}
    docs, planted = [], set()
    for k in range(400):
        seq = draw(150)
        if k % 2 == 0:
            own = rng.choice(list(items))
            at, n = rng.randrange(40), rng.choice([20, 22, 25, 30])
            passage = misread(rng, items[own][at : at + n], rng.choice([0, 0.1, 0.25]))
            cut = rng.randrange(5, n - 5)
            advert = draw(rng.choice([6, 60, 150])) if rng.random() < 0.4 else []
            lines = [*printed(seq[:60]), *printed(passage[:cut]), *printed(advert), *printed(passage[cut:]), *printed(seq[60:])]
            planted.add((k, own))
        else:
            lines = printed(seq)
        docs.append((k, "\n".join(lines), None))
    df = spark.createDataFrame(docs, f"doc_id long, text string, line_boxes {BOX}")
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in PI.leaked_passages(df, asked).collect()}
    assert len(got & planted) >= 0.99 * len(planted) and got <= planted


def test_edit_distance_by_bits():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert PI._distance(a, b, 3) == min(4, plain(a, b)), (a, b)


@pytest.mark.parametrize("seed", range(3))
def test_cheap_refusals_never_refuse_what_is_the_same(seed):
    rng = random.Random(seed)
    for w in words(rng, 400) + ["burn", "corn", "modern", "as", "tfs5"]:
        for v in misread(rng, [w] * 4, 1.0) + [w.replace("rn", "m"), w[1:] or "a", w + "x", w[:-1] + "rn"]:
            if PI.same_word(w, v):
                assert not PI._unlike(PI._record(v), PI._record(w))
            for cut in range(1, len(v)):
                if PI.same_word(w, v):
                    assert not PI._unlike_joined(PI._record(v[:cut]), PI._record(v[cut:]), PI._record(w)), (w, v, cut)


@pytest.mark.parametrize(("text", "want"), [
    ("Call me on oh one two four two six eight one four two six please", [("oh one two four two six eight one four two six", "phone")]),
    ("Tel. null eins sieben drei vier vier zwei eins null drei acht bitte", [("null eins sieben drei vier vier zwei eins null drei acht", "phone")]),
    ("le zéro six un deux trois quatre cinq six sept huit", [("zéro six un deux trois quatre cinq six sept huit", "phone")]),
    ("ring oh double two one six triple four nine six now", [("oh double two one six triple four nine six", "phone")]),
    ("write to ana (at) example.org. Then wait", [("ana (at) example.org", "email")]),
    ("ana arobase exemple point fr", [("ana arobase exemple point fr", "email")]),
    ("We arrive at some point in May, one or two of us, at three", []),
])
def test_disguises_in_four_languages(text, want):
    assert found(text) == want


def test_names_of_no_list_by_their_context():
    rng = random.Random(31)
    given = ["Kwame", "Aiko", "Olena", "Siobhan", "Mohammed", "Wei", "Ingrid", "Thabo", "Zuleika", "Jürgen"]
    family = ["Mensah", "Tanaka", "Kovalenko", "O'Brien", "Abdullahi", "Zhang", "Bergström", "Nkosi", "Haddad", "Müller"]
    assert not {g.lower() for g in given} & PD.GIVEN_NAMES
    said = ["My name is {}.", "Dear {}, thank you.", "Later {} said no.", "She met {} twice.", "Er heißt {} und", "I saw my friend {} there.", "Rosa and {} left."]
    plain = ["The Harbor Timber Brothers said no.", "It lies near Port Selton in North Wexley.", "Ask the Old Mill Company about Grand Lodge.", "On Monday Morning trains said nothing.", "We saw Lake Orvel and River Tarn."]
    right = wrong = total = 0
    for _ in range(200):
        name = f"{rng.choice(given)} {rng.choice(family)}"
        text = f"{rng.choice(plain)} {rng.choice(said).format(name)} {rng.choice(plain)}"
        names = {s for s, kind in found(text) if kind == "name"} - {"Rosa"}
        total += 1
        right += name in names
        wrong += len(names - {name})
    assert right >= 0.95 * total and wrong <= 0.02 * total


def test_few_shapes_hold_a_spam_page():
    share, kind, shapes = LS.spam_share("#vestry #vestryonline\n#onlinevestry #committee\n" * 6, [], [], [])
    assert share > 0.9 and kind == "tag" and 1 <= shapes <= 2
    assert LS.spam_share("The council of Markil was delayed before a large gathering, and the\nlarge school remains as it was.", [], [], [])[2] == 0
    assert LS.spam_share("angebote-heute.de billig\nwww.x.example\nkauf-jetzt.co.uk\n" * 4, [], [], [])[1] == "link"


def test_a_worker_holds_one_shard_and_bounded_memories(spark, tmp_path):
    rows = spark.range(40, numPartitions=1).selectExpr("id", "repeat('x', 100) AS page")
    rows.write.parquet(str(tmp_path / "rows"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    with PI._one_shard_at_a_time(spark):
        assert {r.n for r in spark.read.parquet(str(tmp_path / "rows")).mapInArrow(sizes, "n long").collect()} == {1}
    assert spark.conf.get(key) == before
    assert [b.num_rows for b in PI._sliced(iter([pa.RecordBatch.from_pydict({"a": [1, 2, 3]})]), 2)] == [2, 1]
    remembered = [f.cache_info().maxsize for f in (PI.clean, PI.fold, PI._places, PI._letters, PI.same_word, PI._record)]
    assert sum(remembered) + PI.FOLDED <= 350_000  # about 300 bytes each
