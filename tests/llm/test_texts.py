import random
import unicodedata

import pytest

from chronoloom.llm import leak
from chronoloom.llm.leak import leaked_items
from chronoloom.llm.lookalike import caseless_sql, character_maps, connect, consistent_form, form_sql, look_alikes, look_classes, look_pairs, mapped, pieces
from tests.conftest import rows

DOC = "doc_id bigint, text string, id string, form string, look string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in texts], DOC)


@pytest.fixture(scope="module")
def alikes(spark):
    return look_alikes(spark)


@pytest.fixture(scope="module")
def form(alikes):
    con, sql = connect(), form_sql(alikes)
    return lambda x: con.execute(f"select {sql} from (select ? as text)", [x]).fetchone()[0]


@pytest.mark.parametrize(
    "a,b",
    [
        ("ｆｕｌｌ\u3000ｗｉｄｔｈ！", "full width!"), ("cafe\u0301", "café"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0b\u2009c", "a b c"), ("рaуpal Ѕсоре", "paypal Scope"),
        ("ﬁre", "fire"), ("е\u0301", "é"), ("ё", "ë"), ("e\u200d\u0301", "é"), ("ÅKΩ", "ÅKΩ"), ("µs", "μs"), ("и\u0306", "й"), ("Α", "A"),
        ("օսհ", "ouh"), ("ɡɑ", "ga"), ("ν", "v"), ("𝐚𝒷𝕔", "abc"), ("ꓐꓮ", "BA"), ("\u202fx", " x"),
    ],
)
def test_same_look(form, a, b):
    assert form(a) == form(b) and form(form(a)) == form(a)


@pytest.mark.parametrize("a,b", [("cafe", "café"), ("Run", "run"), ("m²", "m2"), ("a b", "ab"), ("naïve", "naive"), ("x₂", "x2"), ("", " "), ("l", "1"), ("l", "I"), ("rn", "m"), ("Ь", "b"), ("ʙ", "B")])
def test_other_look(form, a, b):
    assert form(a) != form(b)


def test_form_against_unicodedata(alikes, form):
    rng = random.Random(4)
    twins = dict(alikes)
    pool = [chr(c) for c in range(0x20, 0x250)] + [c for c in twins if unicodedata.is_normalized("NFC", c)] + [chr(c) for c in range(0xFF01, 0xFF5F)] + ["\u0301", "\u0308", "\u200b", "\u3000", "ﬁ"]
    keep = lambda c: unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<fraction>")) or unicodedata.normalize("NFKC", c).startswith(" ") and c != " " and unicodedata.category(c) != "Zs"
    hidden = {"\u200b", "\u00ad", "\u034f"}
    texts = ["".join(rng.choice(pool) for _ in range(40)) for _ in range(200)]
    for t in texts:
        x = unicodedata.normalize("NFC", t)
        x = "".join(twins[c] if c in twins else c if keep(c) else unicodedata.normalize("NFKC", c) for c in x if c not in hidden)
        assert form(t) == unicodedata.normalize("NFC", "".join(twins.get(c, c) for c in x))


def test_the_policy_of_look_alike_letters(alikes):
    twins = dict(alikes)
    assert len(twins) > 1000 and all(a.isascii() and a.isalpha() and not c.isascii() for c, a in alikes)
    assert all(a.isupper() for c, a in alikes if unicodedata.category(c) == "Lu") and all(a.islower() for c, a in alikes if unicodedata.category(c) == "Ll")
    single, looks, many = character_maps(alikes)
    assert not set(single) & set(looks) and not set(single) & set(many) and looks["ё"] == "ë"


def test_long_texts_are_cut_where_nothing_composes(monkeypatch, alikes):
    form_of, words_of = form_sql(alikes), caseless_sql(alikes)
    rng = random.Random(6)
    pool = "ab é\u0301\u200d ﬁо,\n" + "e\u0301" * 3
    con = connect()
    for n in (0, 1, 40, 3000):
        t = "".join(rng.choice(pool) for _ in range(n))
        w = "".join("".join(rng.choice("abé\u0301ﬁо") for _ in range(rng.randrange(1, 6))) + rng.choice(" ,\n") for _ in range(n))
        whole = mapped(con, [t, None], form_of), leak._words(con, [w, t, 'x' * n], words_of)
        with monkeypatch.context() as m:
            m.setattr("chronoloom.llm.lookalike.PIECE_CHARS", 16)
            m.setattr("chronoloom.llm.lookalike.pieces", lambda x: pieces(x, 16))
            m.setattr("chronoloom.llm.lookalike.CALL_CHARS", 50)
            assert (mapped(con, [t, None], form_of), leak._words(con, [w, t, 'x' * n], words_of)) == whole
        assert "".join(pieces(t, 7)) == t
    assert len(pieces("x" * 500, 50)) == 10 and pieces("\u0301" * 500, 50) == ["\u0301" * 500]


def test_pairs_classes_and_copies(spark):
    df = docs(spark, [(1, "abc"), (2, "abс"), (3, "abc"), (4, "ABC"), (5, None), (6, ""), (7, "\u200b"), (8, "аbc"), (9, "lone")])
    assert rows(look_pairs(df, "doc_id", "text")) == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8), (6, 7)]
    assert rows(look_classes(df, "doc_id", "text")) == sorted(
        [(1, 1, 1, 3, 2), (2, 1, 2, 3, 3), (3, 1, 1, 3, 2), (4, 4, 4, 1, 0), (6, 6, 6, 2, 1), (7, 6, 7, 2, 1), (8, 1, 8, 3, 3), (9, 9, 9, 1, 0)], key=repr
    )
    assert dict(rows(consistent_form(df, "doc_id", "text")))[5] is None and consistent_form(df, "doc_id", "text").count() == 9
    assert look_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_pairs_follow_from_the_classes(spark):
    rng = random.Random(3)
    df = docs(spark, [(i, rng.choice(["copy", "сopy", "соpy", "coрy", "other", "οther"])) for i in range(300)])
    told = rows(look_classes(df, "doc_id", "text"))
    pairs = sorted(((a[0], b[0]) for a in told for b in told if a[0] < b[0] and a[1] == b[1] and a[2] != b[2]), key=repr)
    assert rows(look_pairs(df, "doc_id", "text")) == pairs
    links = {i: 0 for i, *_ in told}
    for p in pairs:
        for i in p:
            links[i] += 1
    assert links == {i: n for i, *_, n in told}


def test_p9_found_names_every_pair_of_copies(spark, tmp_path):
    from chronoloom.llm.queries import p9_found

    docs(spark, [(i, "copy" if i % 2 else "сopy") for i in range(20)]).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(p9_found(spark, str(tmp_path))) == sorted(((a, b) for a in range(20) for b in range(a + 1, 20, 2)), key=repr)


WORDS = "the quiet lamp near wide harbour turns while seven gulls cross under copper light and every small boat keeps to its own slow line".split()


def brute(texts, items, n, alikes):
    sql = caseless_sql(alikes)
    split = lambda pairs: [(k, w.split()) for (k, _), w in zip(pairs, leak._words(connect(), [t or "" for _, t in pairs], sql))]
    out = []
    wanted = [(i, {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}) for i, v in split(items)]
    for d, w in split(texts):
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        out += [(d, i) for i, own in wanted if own & grams]
    return sorted(out, key=repr)


def test_leaks_against_brute_force(spark, alikes):
    rng = random.Random(7)
    items = [(f"i{k}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(10, 40)))) for k in range(30)] + [("none", None), ("empty", ""), ("short", "only a few words")]
    texts = []
    for d in range(120):
        body = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        item = items[rng.randrange(30)][1].split()
        n = rng.randrange(8, 16)
        at = rng.randrange(0, max(1, len(item) - n))
        cut = rng.randrange(0, len(body) + 1)
        text = " ".join(body[:cut] + item[at : at + n] + body[cut:])
        if d % 3 == 0:
            text = text.upper().replace(" ", ",\u00a0 ")
        if d % 5 == 0:
            text = text.replace("e", "е").replace("S", "Ѕ")
        texts.append((d, text))
    texts += [(500, None), (501, ""), (502, "…!"), (503, items[0][1] + " filler" * 400_000 + " " + items[1][1])]
    df = docs(spark, texts)
    it = spark.createDataFrame(items, "item_id string, text string")
    for kw in ({}, {"max_edits": 0, "q": 8}, {"block_chars": 500, "slice_chars": 300}):
        got = rows(leaked_items(df, it, "doc_id", "text", "item_id", "text", **kw).filter("edits = 0"), "doc_id", "item_id")
        assert got == brute(texts, items, 12, alikes)
    assert leaked_items(df.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked_items(df, it.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_edits_are_counted(spark):
    item = " ".join(WORDS[:14])
    for change, edits in ((lambda t: t, 0), (lambda t: t.replace("harbour", "harbor"), 1), (lambda t: t.replace("quiet", "quietly").replace("copper", "coper").replace("gulls", "gals"), None)):
        got = leaked_items(docs(spark, [(1, "x y " + change(item) + " z")]), spark.createDataFrame([("i", item)], "item_id string, text string"), "doc_id", "text", "item_id", "text", max_edits=2)
        first = got.first()
        assert (first and first["edits"]) == edits or (edits is None and first is None)


def least_edits(item, doc, n):
    """Fewest edits between any window of n words of an item and any stretch of a document, by the full table."""
    codes = leak._codes(item)
    gaps = [i for i, c in enumerate(codes) if c == 32]
    best = None
    for a, b in zip(gaps, gaps[n:]):
        row = [0] * (len(doc) + 1)
        for i, c in enumerate(item[a : b + 1]):
            new = [i + 1]
            for j, x in enumerate(doc):
                new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
            row = new
        best = min(row) if best is None else min(best, min(row))
    return best


@pytest.mark.parametrize("max_edits", [1, 2, 3])
def test_short_words_lose_no_edit(spark, alikes, max_edits):
    rng = random.Random(max_edits)
    letters = "abcdefgh"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 9])))
    items = [(k, " ".join(word() for _ in range(13))) for k in range(12)]
    texts = []
    for d in range(60):
        body = list(items[d % 12][1])
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(body))
            body[at : at + 1] = rng.choice([[], ["z"], [body[at], "y"], [" "]])
        texts.append((d, f"{word()} {''.join(body)} {word()}"))
    sql = caseless_sql(alikes)
    ws = dict(zip([d for d, _ in texts], leak._words(connect(), [t for _, t in texts], sql)))
    ts = dict(zip([i for i, _ in items], leak._words(connect(), [t for _, t in items], sql)))
    want = sorted(((d, i, e) for d, w in ws.items() for i, t in ts.items() if (e := least_edits(t, w, 12)) is not None and e <= max_edits), key=repr)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    for kw in ({}, {"block_chars": 60}):
        assert rows(leaked_items(docs(spark, texts), it, "doc_id", "text", "item_id", "text", max_edits=max_edits, **kw)) == want
    assert len(want) > 20


def test_too_many_edits_are_refused(spark):
    one = spark.createDataFrame([("i", "a b c d e f g h i j k l")], "item_id string, text string")
    with pytest.raises(ValueError):
        leaked_items(docs(spark, [(1, "x")]), one, "doc_id", "text", "item_id", "text", max_edits=12)


def test_a_shared_instruction_line_is_one_passage(spark):
    import time

    rng = random.Random(1)
    line = " ".join(rng.choice(WORDS) for _ in range(40))
    items = [(k, f"{line} {' '.join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(14))}") for k in range(3000)] + [(9999, " ".join(f"word{rng.randrange(10**6)}" for _ in range(20_000)))]
    texts = [(0, f"so {line} end"), (1, "so " + items[7][1]), (2, items[3000][1][1000:3000]), *[(k, " ".join(rng.choice(WORDS) for _ in range(60))) for k in range(3, 60)]]
    it = spark.createDataFrame(items, "item_id bigint, text string")
    began = time.perf_counter()
    got = leaked_items(docs(spark, texts), it, "doc_id", "text", "item_id", "text").filter("edits = 0").groupBy("doc_id").count()
    assert rows(got) == [(0, 3000), (1, 3000), (2, 1)]
    assert time.perf_counter() - began < 60
