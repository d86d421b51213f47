"""Plain forms, predicates, titles, dates and numbers of wikitext."""

from pyspark.sql import functions as F

from corpusmill.functions import wikitext as W


def values(spark, f, texts):
    return [r.o for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t")).alias("o")).collect()]


def test_plain_forms(spark):
    t = "{{Infobox|a={{b}}}}<!-- x -->'''Anna''' is a [[physicist|scientist]]<ref>cite</ref> in [[Paris]].\n== Life ==\n[[File:a.jpg|thumb]]\n{| x\n| y\n|}\nShe won &amp; left.[[Category:X]]"
    assert values(spark, W.claims, [t, None, ""]) == ["Anna is a scientist in Paris.\n\nShe won &amp; left.".replace("\n\n", "\n"), None, ""]
    assert values(spark, W.prose, [t]) == ["Anna is a scientist in Paris. She won & left."]
    assert "[[physicist|scientist]]" in values(spark, W.for_extraction, [t])[0] and "cite" not in values(spark, W.for_extraction, [t])[0]
    s = "Dr. Smith paid 3.5 million. He left at once! Ok. They came back later."
    assert values(spark, W.sentences, [s]) == [["Dr. Smith paid 3.5 million.", "He left at once!", "They came back later."]]
    assert [round(x, 2) for x in values(spark, W.average_sentence_length, [s, "", None])[:2]] == [4.67, 0.0]


def test_candidates_and_entities(spark):
    t = 'The [[Battle of Borodino|battle]] near "strange word" and \'\'La Mer\'\' of Duke of Wellington in New York with a blue-collar Mozart.'
    got = {(r.family, r.term) for r in values(spark, W.candidates, [t])[0]}
    assert got >= {("link", "Battle of Borodino"), ("alias", "battle"), ("quoted", "strange word"), ("italic", "La Mer"), ("joined", "Duke of Wellington"), ("phrase", "New York"), ("compound", "blue-collar"), ("name", "Mozart")}
    names = values(spark, W.entities, [t])[0]
    assert "Battle of Borodino" in names and "Borodino" not in names and "New York" in names


def test_predicates(spark):
    assert values(spark, W.english_title, ["Products and applications of OpenAI", "Agen cerdas", "history", "war history"]) == [True, False, True, True]
    assert values(spark, W.target_title, ["Pemberhentian dari perusahaan", "Foundation model"]) == [True, False]
    assert values(spark, lambda c: W.generic_title(c, F.lit("Removal of Sam Altman")), ["pemberhentian", "Pemberhentian Sam"]) == [True, False]
    assert values(spark, W.language_code, ["en", "invalid_code", "zh-yue", "e"]) == [True, False, True, False]
    assert values(spark, lambda c: W.listed_share(c) >= 0.55, ["* a\n* b\ntext", "text\n* a\ntext", ""]) == [True, False, False]
    assert values(spark, lambda c: W.boilerplate(F.lit("References"), c, ["references"]), ["{{reflist}}\n* [[A]]", "This is a line with more than six plain words in it"]) == [True, False]
    assert values(spark, W.magic_word, ["PAGENAME", "#if:x", "Infobox"]) == [True, True, False]
    assert values(spark, W.topic, ["sutradara film itu", "perang dan raja", "apa pun"]) == ["film", "history_social", "general"]
    assert [r.ok for r in values(spark, W.film_consensus, ["Film Indonesia tahun 2021", "Film laga tahun 2024", "Film drama komedi", "Film Inggris", "Film horor Jepang", "Tokoh"])] == [True, False, False, False, False, True]
    assert values(spark, W.film_category, ["American films", "Film Indonesia", "Filmografi"]) == [True, True, False]
    assert values(spark, W.edit_summary, [None, "mengalihkan ke [[Bandung]] oleh bot", "rapikan (draf", "gemini", "x" * 30 + " " + "y" * 90]) == ["rapikan draf", "mengalihkan ke [[Bandung]]", "rapikan (draf)", "rapikan draf", "x" * 30]
    assert spark.range(1).select(W.verdict(F.lit(95), F.lit(1)).alias("a"), W.verdict(F.lit(80), F.lit(0)).alias("b"), W.verdict(F.lit(95), F.lit(0)).alias("c")).first() == ("rework", "revise", "passed")


def test_titles_dates_numbers(spark):
    assert values(spark, W.title_in, ["template: foo_bar", "Category:x", "sherlock Holmes: a game", None]) == ["Templat:Foo bar", "Kategori:X", "Sherlock Holmes: a game", None]
    assert values(spark, W.localised_title, ["Mercury (film)", "Mercury (2010 film)", "Plain", "X (unknown)"]) == ["Mercury (film)", "Mercury (film 2010)", "Plain", "X (unknown)"]
    assert [tuple(x)[1:] for x in values(spark, W.interlanguage_links, ["{{ill|Produk|en|Products|lt=P}} {{ill|Satu|de}}"])[0]] == [("Produk", "en", "Products", "P"), ("Satu", "de", "Satu", None)]
    assert values(spark, W.one_language, ["{{ill|P|en|A (2001)|ru|Б}}", "{{ill|T|ru|М|de|L}}", "{{ill|T|ru|М|en|E}}", "{{ill|S|en|E}}"]) == ["{{ill|P|en|A (2001)}}", "{{ill|T|ru|М}}", "{{ill|T|en|E}}", "{{ill|S|en|E}}"]
    assert values(spark, W.iso_date, ["5 Januari 2020", "17 Agustus 1945", "x"]) == ["2020-01-05", "1945-08-17", None]
    assert values(spark, W.swapped_separators, ["1,234.5 dan 1,234,567 atau 2.5"]) == ["1.234,5 dan 1.234.567 atau 2,5"]
    assert values(spark, W.crores, ["2.5 crore dan 3 lakh"]) == ["25 juta dan 300 ribu"]
    assert values(spark, W.category_parts, ["1990s American comedy-drama films", "2005 horror films"]) == [["Film Amerika Serikat", "Film dasawarsa 1990-an", "Film drama", "Film komedi"], ["Film tahun 2005", "Film horor"]]
