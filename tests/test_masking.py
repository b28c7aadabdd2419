import pytest
from pyspark.sql import functions as F

from anontext.operators.automaton import Automaton, PrefixFilter, tails
from anontext.operators.entities import mask_entities, normalise_surfaces
from anontext.operators.rulemask import core_words, mask_article, mask_patterns


@pytest.mark.parametrize("text, masked", [
    ("see http://a.b/c?d=1, or www.x.org.", "see link_x, or link_x."),
    ("on 2024-01-05 at 10:30 am", "on date_x at time_x"),
    ("on March 5, 2019 and 7 May 2018, in Sept. 2020", "on date_x and date_x, in date_x"),
    ("since 1999, in FY2020 (2021)", "since year_x, in year_x (year_x)"),
    ("SYMBOL:TIKR, $TIKR, >TIKR, $ TIKR, SYMBOL TIKR, SYMBOL: TIKR, > TIKR",
     ", ".join(["ticker_x"] * 7)),
    ("up 5.5%, 1,200 units and $3.2 billion dollars, 7 percent", "up number_x, number_x and number_x, number_x"),
    ("Company_1 and item_22 stay", "Company_1 and item_22 stay"),
    ("5 millionaires, 3M", "number_x millionaires, number_x"),
    ("5 6 7 8", "number_x number_x number_x number_x"),
    ("", ""), (None, None),
])
def test_patterns(spark, text, masked):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mask_patterns(F.col("t")).alias("m")).first().m == masked


@pytest.mark.parametrize("text, name, ticker, masked", [
    ("BLUE BOLT Inc. and blue-bolt", "Blue Bolt Inc", "BLBO", "Company_1 and Company_1"),
    ("BLBO rose, $BLBO fell, BLBOX not", "X", "BLBO", "ticker_x rose, ticker_x fell, BLBOX not"),
    ("Snap Inc. and snapping", "Snap Inc.", "SNAP", "Company_1 and snapping"),
    ("the group (A+B) said", "A+B (NEW) Group", "", "the group (Company_1) said"),
    ("nothing known 5", None, None, "nothing known number_x"),
    ("Forever 21 sold 21", "Forever 21 LLC", None, "Company_1 sold number_x"),
    ("Group news", "Group Inc", None, "Group news"),
])
def test_own_firm(spark, text, name, ticker, masked):
    df = spark.createDataFrame([(text, name, ticker)], "t string, n string, k string")
    assert df.select(mask_article(F.col("t"), F.col("n"), F.col("k")).alias("m")).first().m == masked


def test_core_words(spark):
    names = spark.createDataFrame([("Blue Bolt (The) Corp.",), ("Group Holdings",), ("()",)], "n string")
    assert [r.w for r in names.select(core_words(F.col("n")).alias("w")).collect()] == [
        ["blue", "bolt"], ["group", "holdings"], None]


@pytest.mark.parametrize("junk", ["1," * 100_000 + "1", "5" + " m" * 100_000, "Blue Bolt" + ", Inc." * 50_000, "1." * 100_000,
                                  "$" * 100_000, "www." + "a" * 200_000, "9:30" * 50_000])
def test_long_junk_is_no_danger(spark, junk):
    df = spark.createDataFrame([(junk + " end 7", "Blue Bolt Inc", "BLBO")], "t string, n string, k string")
    assert df.select(mask_article(F.col("t"), F.col("n"), F.col("k")).alias("m")).first().m.endswith(" end number_x")


@pytest.mark.parametrize("text, want", [
    ("the 1990s", "the year_x"), ("Q3 and 3Q23", "date_x and date_x"), ("FY23, 2023E", "year_x, year_x"), ("the 5th", "the number_x"),
    ("on Monday in January", "on date_x in date_x"), ("a.b@c.com or example.com", "link_x or link_x"),
    ("at 2024-01-05T10:00:00Z", "at date_x"), ("10 m m m m", "number_x")])
def test_more_classes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(mask_patterns(F.col("t")).alias("m")).first().m == want


@pytest.mark.parametrize("text, want", [
    ("up 3.5x, 10x and 5A", "up number_x, number_x and number_x"), ("on 05.01.2024 or 5.1.24", "on date_x or date_x"),
    ("Q3'23, Q3 '23, Q323, 3Q'23 and Q1 2020", "date_x, date_x, date_x, date_x and date_x"),
    ("o'brien@firm.com at ftp.apple.com, apple.co.uk, sap.de, tesla.io, apple.info or APPLE.COM.", "link_x at link_x, link_x, link_x, link_x, link_x or link_x."),
    ("(NYSE: AAPL) and NASDAQ:BRK.B and NYSE Arca", "(ticker_x) and ticker_x and NYSE Arca"), ("May rose, it may rise", "date_x rose, it may rise"),
    ("at noon, this afternoon", "at time_x, this afternoon"), ("$2000 and 2000 units in 2000", "number_x and number_x in year_x"),
    ("1.2024 and 2024.5", "number_x and number_x"), ("EUR 5, US$7 and ¥9 bn", "number_x, number_x and number_x"),
    ("a 5-year, 10-billion-dollars plan", "a number_x, number_x plan"), ("4x4 and B2B and item_5", "number_x and B2B and item_5"),
    ("1,200 shares; 5 %", "number_x; number_x"), ("e.g. the U.S. firm", "e.g. the U.S. firm")])
def test_values_are_masked_whole(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(mask_patterns(F.col("t")).alias("m")).first().m == want


@pytest.mark.parametrize("text, want", [
    ("five million", "number_x"), ("Two percent", "number_x"), ("one third of it", "number_x of it"), ("the twenty-first time", "the number_x time"),
    ("one hundred and twenty-five thousand dollars, then", "number_x, then"), ("no one of the first", "no one of the first"),
    ("a hundred and one days", "number_x"), ("hundreds of units", "number_x of units"), ("two and three", "number_x and number_x"),
    ("a second look, one year", "a second look, number_x"), ("sixteen, sixty, six", "number_x, number_x, number_x"),
    ("one-half, three quarters", "number_x, number_x"), ("seventeenth and tens", "number_x and tens"), ("someone often listens", "someone often listens"),
    ("two" + " three" * 50_000 + " end", "number_x end"), ("one " * 50_000 + "of", None)])
def test_number_words(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(mask_patterns(F.col("t")).alias("m")).first().m
    assert got == want if want is not None else got.endswith(" of")


@pytest.mark.parametrize("text, want", [
    ("5 and 6, then 5 again", "number_a and number_b, then number_a again"), ("1,200 units or 1200 Units or five", "number_a or number_a or number_b"),
    ("on 2024-01-05 at 9:30 in 1999", "on date_x at time_x in year_x"), ("", ""), (None, None), ("none", "none"), ("7", "number_a"),
    ("$5 million, 5%", "number_a, number_b"), ("$2000 million in 2000 and 1,999.5 or 1999", "number_a in year_x and number_b or year_x"),
    ("x \ufdd0 5 \ufdd1 y 5 $ 5", "x  number_a  y number_a number_b")])
def test_lettered_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(mask_patterns(F.col("t"), lettered=True).alias("m")).first().m == want


def test_letters_run_on(spark):
    text = " ".join(f"{i}.5 {i}.5" for i in range(1, 800))
    got = spark.createDataFrame([(text,)], "t string").select(mask_patterns(F.col("t"), lettered=True).alias("m")).first().m.split(" ")
    assert got[0:3] == ["number_a", "number_a", "number_b"] and got[51] == "number_z" and got[52] == "number_aa" and got[-1] == "number_ads"
    assert len(set(got)) == 799


@pytest.mark.parametrize("ticker, text, want", [
    ("A", "A company, SYMBOL:A rose", "A company, ticker_x rose"), ("BRK.B", "BRK.B and BRKB and $BRK.B", "ticker_x and ticker_x and ticker_x")])
def test_own_ticker(spark, ticker, text, want):
    df = spark.createDataFrame([(text, "Zed", ticker)], "t string, n string, k string")
    assert df.select(mask_article(F.col("t"), F.col("n"), F.col("k")).alias("m")).first().m == want


def naive_mask(text, own, spellings):
    """Leftmost longest spelling by trying all of them at every word."""
    import re
    spans = [m.span() for m in re.finditer(r"\w+", text)]
    words = [text[a:b].lower() for a, b in spans]

    def fits(at, wanted):
        return words[at:at + len(wanted)] == wanted and all(
            re.fullmatch(r"[\s\-&.,']+", text[spans[j - 1][1]:spans[j][0]]) for j in range(at + 1, at + len(wanted)))

    own_entity = spellings.get(" ".join(own), " ".join(own))
    out, i, done, numbers = [], 0, 0, {}
    while i < len(words):
        here = [s for s in spellings if fits(i, s.split())] + ([" ".join(own)] if fits(i, own) else [])
        if not here:
            i += 1
            continue
        best = max(here, key=lambda s: len(s.split()))
        entity = spellings.get(best, " ".join(own))
        label = 1 if best == " ".join(own) or entity == own_entity else numbers.setdefault(entity, len(numbers) + 2)
        size = len(best.split())
        out += [text[done:spans[i][0]], f"Company_{label}"]
        done, i = spans[i + size - 1][1], i + size
    return "".join(out) + text[done:]


def test_automaton_equals_trying_every_spelling(spark):
    import random
    r = random.Random(5)
    for case in range(60):
        letters = "abc"[:r.randint(2, 3)]
        spellings = {" ".join(r.choice(letters) for _ in range(r.randint(1, 5))): f"e{r.randint(0, 6)}" for _ in range(r.randint(1, 14))}
        own = [r.choice(letters) for _ in range(r.randint(1, 3))]
        text = "".join(r.choice(letters + "xC") + r.choice([" ", " ", " ", "-", ", ", "; ", " (", "\n"]) for _ in range(50))
        automaton = Automaton([(s, "company", e) for s, e in spellings.items()])
        assert automaton.mask(text, own) == naive_mask(text, own, spellings), (case, spellings, own, text)


def test_filter_keeps_every_beginning(spark):
    surfaces = spark.createDataFrame([("red rod steel", 3), ("tin", 1), ("new york", 2)], "surface string, n_words int").repartition(3)
    beginnings = PrefixFilter.of(surfaces)
    got = dict(tails("Red rod; steel, RED ROD steel rope. Tin new Yorkshire New-York", beginnings))
    assert got == {0: "red rod", 3: "red rod steel", 7: "tin", 8: "new", 10: "new york"}
    assert list(tails("red", PrefixFilter.of(surfaces.limit(0)))) == []


def test_a_million_names_move_few_bytes(spark, folder, capsys):
    """Of a large dictionary only the spellings that occur travel to the texts, and no text is shuffled."""
    words = F.transform(F.sequence(F.lit(0), F.col("id") % 3), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(50_000)).cast("string")))
    names = spark.range(1_000_000, numPartitions=8).select(F.array_join(words, " ").alias("surface"), F.lit("company").alias("kind"),
                                                           F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.concat(F.lit("v"), F.pmod(F.xxhash64("id", i), F.lit(90_000)).cast("string"))), " ")
    named = F.concat(F.lit(" w"), F.pmod(F.xxhash64(F.col("id") * 6 + 1, F.lit(0)), F.lit(50_000)).cast("string"))
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("Zed").alias("comnam"), F.concat(body, named, F.lit(" end")).alias("text"))
    path = f"{folder}/texts"
    texts.write.parquet(path)
    texts = spark.read.parquet(path)
    masked = mask_entities(texts, names, "text", "comnam", "masked")
    masked.explain()
    assert "Exchange" not in capsys.readouterr().out
    rows = masked.collect()
    assert all(" Company_2" in r.masked or " w" in r.text for r in rows) and sum("Company_2" in r.masked for r in rows) > 300
    size = texts.agg(F.sum(F.length("text"))).first()[0]
    held = PrefixFilter.of(normalise_surfaces(names.limit(0)))
    assert held.size == 64 and size > 400 * 1000


def test_own_firm_by_entity_and_rivals_without(spark):
    dictionary = spark.createDataFrame([("ibm", "company", "e1"), ("big blue", "company", "e1"), ("sap", "company", None),
                                        ("oracle", "company", "e2")], "surface string, kind string, entity string")
    texts = spark.createDataFrame([(1, "IBM", "Big\u00a0Blue and SAP fought Oracle\u2013and IBM")], "doc_id bigint, comnam string, text string")
    for limits in ({}, {"max_surfaces": 3}, {"max_surfaces": 0}):
        got = mask_entities(texts, dictionary, "text", "comnam", "masked", **limits).first().masked
        assert got == "Company_1 and Company_2 fought Company_3\u2013and Company_1"


DICTIONARY = [("Red Rod", "company", "red"), ("Red Rod Steel", "company", "red"), ("Tin", "company", "tin"),
              ("New York", "location", None), ("york", "name", None), ("  widget-maker ", "product_type", None),
              ("red", "sector", None)]
TEXTS = [
    (1, "Blue Bolt Inc", "Tin beat Red Rod Steel; RED  rod and Tin in New York, not York.",
     "Company_2 beat Company_3; Company_3 and Company_2 in location_x, not name_x."),
    (2, "Red Rod", "Red Rod met Tin. Red, rodeo", "Company_1 met Company_2. sector_x, rodeo"),
    (3, "Blue Bolt", "blue bolt, the Widget Maker\nred\nrod", "Company_1, the product_type_x\nCompany_2"),
    (4, "Blue Bolt", "nothing here", "nothing here"),
    (5, None, None, None),
    (6, "Blue Bolt", "", ""),
]


# In place; through the filter, then in place; through the filter, then hits by key.
WAYS = [{}, {"max_surfaces": 6}, {"max_surfaces": 0}]


@pytest.mark.parametrize("limits", WAYS)
def test_entities_all_ways(spark, limits):
    dictionary = spark.createDataFrame(DICTIONARY, "surface string, kind string, entity string")
    texts = spark.createDataFrame([t[:3] for t in TEXTS], "doc_id bigint, comnam string, text string")
    masked = mask_entities(texts, dictionary, "text", "comnam", "masked", **limits)
    assert {r.doc_id: r.masked for r in masked.collect()} == {t[0]: t[3] for t in TEXTS}


def test_empty_dictionary(spark):
    dictionary = spark.createDataFrame([], "surface string, kind string, entity string")
    texts = spark.createDataFrame([(1, "Tin", "Tin and steel")], "doc_id bigint, comnam string, text string")
    for limits in ({}, {"max_surfaces": -1}):
        masked = mask_entities(texts, dictionary, "text", "comnam", "masked", **limits)
        assert [r.masked for r in masked.collect()] == ["Company_1 and steel"]


@pytest.mark.parametrize("mail", ["john.smith@us.berkshirehathaway.com", "bob@mail.3m.com", "jane@mail.example-bank.com",
                                  "a@b.c.d.e.f.co.uk", "x@firm.photography", "x@firm.internationalbank", "x@y.xn--p1ai"])
def test_whole_mail_addresses(spark, mail):
    df = spark.createDataFrame([(f"ask {mail}, ({mail}) or {mail}. Then 100@5.25...",)], "t string")
    assert df.select(mask_patterns(F.col("t")).alias("m")).first().m == "ask link_x, (link_x) or link_x. Then number_x@number_x..."


@pytest.mark.parametrize("text, masked", [
    ("Blue Bolt Technologies Holdings Group Co. Ltd., Inc. rose", "Company_1 rose"),
    ("Blue Bolt Inc.x and Blue Bolt S.A. and Blue Bolt Incas", "Company_1.x and Company_1 and Company_1 Incas")])
def test_all_legal_forms_go(spark, text, masked):
    df = spark.createDataFrame([(text, "Blue Bolt Inc", "BLBO")], "t string, n string, k string")
    assert df.select(mask_article(F.col("t"), F.col("n"), F.col("k")).alias("m")).first().m == masked


def test_long_mail_junk_is_no_danger(spark):
    df = spark.createDataFrame([("a@" + "b." * 100_000 + " " + "a@" + "b-" * 100_000 + " end 7",)], "t string")
    assert df.select(mask_patterns(F.col("t")).alias("m")).first().m.endswith(" end number_x")


def test_texts_travel_to_python_in_small_batches(spark):
    from anontext.operators.entities import mask_entities
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        df = spark.createDataFrame([(1, "Blue Bolt rose", "Blue Bolt")], "doc_id long, text string, comnam string")
        names = spark.createDataFrame([("blue bolt", "company", "b")], "surface string, kind string, entity string")
        assert mask_entities(df, names, "text", "comnam", "masked").first().masked == "Company_1 rose"
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.set(name, before)


def test_first_characters_rule_no_match_out(spark):
    from anontext.operators import rulemask
    text = ("Https://a.b/c WWW.x.org ftp://q f.o'b@sap.de -a.co.uk 10:30 pm Noon 2024-01-05T10:00:00Z 5 May Sept. 3, 2020 Q3'23 3Q 2020 Tuesday "
            "US$7 C$ 8 EUR 9.50 bn £3 12% 4 shares FY20 1999s 2023E NYSE: AB SYMBOL:ZZ $ Q >QQ EPA: X TYO:Y Twenty one one hundred an ODD dozen "
            "third Zero eleven 1,,2..3 x4 4x a million half billionth hundredths")
    df, plain = spark.createDataFrame([(text,), (text.upper(),), (text.lower(),), (None,)], "t string"), F.col("t")
    for i, (_, pattern) in enumerate(rulemask.CLASSES):
        whole = f"{rulemask._BEFORE}(?:{pattern}){rulemask._AFTER}"
        begin = f"(?={rulemask._FIRST[i]})"
        row = df.select(F.regexp_extract_all(plain, F.lit(whole), 0).alias("a"), F.regexp_extract_all(plain, F.lit(begin + whole), 0).alias("b")).collect()
        assert row[0].a and all(r.a == r.b for r in row)


@pytest.mark.parametrize("limits", WAYS)
def test_spellings_that_no_text_can_hold_go_before_the_filter(spark, monkeypatch, limits):
    """A dictionary beyond the filter: only spellings whose words occur reach it, at whichever place the others differ."""
    from anontext.operators import entities
    monkeypatch.setattr(PrefixFilter, "MOST", 1 << 10)
    strange = [(f"unheard {i} red", "name", None) for i in range(400)] + [(f"Tin unheard{i}", "name", None) for i in range(400)]
    strange += [(f"red rod unheard{i} steel", "name", None) for i in range(400)] + [("Blue Bolt", "company", "own"), ("nobody's", "name", None)]
    dictionary = spark.createDataFrame(DICTIONARY + strange, "surface string, kind string, entity string")
    texts = spark.createDataFrame([t[:3] for t in TEXTS], "doc_id bigint, comnam string, text string")
    asked, fits = [], entities._fits
    monkeypatch.setattr(entities, "_fits", lambda surfaces, *rest: asked.append(surfaces.count()) or fits(surfaces, *rest))
    masked = mask_entities(texts, dictionary, "text", "comnam", "masked", **limits)
    assert {r.doc_id: r.masked for r in masked.collect()} == {t[0]: t[3] for t in TEXTS}
    # Place by place: what begins with a word of the texts, then what goes on with one, and so on.
    known = len(DICTIONARY) + 1
    assert asked[:2] == [known + 800, known + 800] if not limits else asked[:3] == [known + 800, known + 400, known]


def test_words_are_handed_on_in_portions():
    import pyarrow as pa
    from anontext.operators.automaton import distinct_words
    batch = pa.RecordBatch.from_arrays([pa.array(["Red rod RED", None, "Tin-tin É_1", ""]), pa.array([["own"], None, ["rod"], []], pa.list_(pa.string()))],
                                       names=["text", "own"])
    assert sorted(w for words in distinct_words([batch], 100) for w in words) == ["own", "red", "rod", "tin", "é_1"]
    portions = [sorted(words) for words in distinct_words([batch], 2)]
    assert portions == [["own", "red", "rod"], ["rod", "tin", "é_1"], []]
