"""Ordered rewrite passes: each pass alone, the suites in their order, and repair until nothing is open."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import rewrites as R

ALONE = [
    (R.TYPOGRAPHY, "strip_metadata_templates", "{{Short description|x}}\n{{Use dmy dates|date=May 2020}}Teks", "Teks"),
    (R.TYPOGRAPHY, "citation_dates", "{{cite web|date=January 5, 2020|access-date=7 March 2021|archive-date=2020-01-02}}", "{{cite web|date=5 Januari 2020|access-date=7 Maret 2021|archive-date=2020-01-02}}"),
    (R.TYPOGRAPHY, "headings", "== Kehidupan Awal di Indonesia ==\nTeks Biasa\n=== NASA Dan Luar ===", "== Kehidupan awal di Indonesia ==\nTeks Biasa\n=== NASA dan luar ==="),
    (R.TYPOGRAPHY, "bound_morphemes_before_links", "pasca-[[Bencana Chernobyl]], Pasca-[[Pembubaran Uni Soviet|pembubaran Uni Soviet]], pro-[[Barat]]", "pascabencana [[Bencana Chernobyl|Chernobyl]], Pascapembubaran [[Pembubaran Uni Soviet|Uni Soviet]], pro-[[Barat]]"),
    (R.TYPOGRAPHY, "en_dashes", "tahun 1939-1945, musim 2023-24 dan era 1990-an, hlm. 45-50, {{cite|pages=105-120|date=2020-01-05}}", "tahun 1939–1945, musim 2023–24 dan era 1990-an, hlm. 45–50, {{cite|pages=105–120|date=2020-01-05}}"),
    (R.TYPOGRAPHY, "em_dashes", "Sutradara — seorang sineas — memulai.<ref>Catatan — sumber</ref>", "Sutradara, seorang sineas, memulai.<ref>Catatan — sumber</ref>"),
    (R.TYPOGRAPHY, "quotations", "“Ini” dan ‘itu’", "\"Ini\" dan 'itu'"),
    (R.TYPOGRAPHY, "bound_morphemes", "Pasca-kematian, non blok, pro-Soviet, anti Barat", "Pascakematian, nonblok, pro-Soviet, anti-Barat"),
    (R.TYPOGRAPHY, "spelling", "AKTIFITAS Praktek didalam [[Analisa]]", "AKTIVITAS Praktik di dalam [[Analisa]]"),
    (R.TYPOGRAPHY, "collocations", "Pada bulan Oktober 1980, misalnya, ia adalah merupakan salah satu tokoh di sebuah rumah sakit", "Sebagai contoh, pada Oktober 1980 ia merupakan salah seorang tokoh di rumah sakit"),
    (R.TYPOGRAPHY, "double_temporal_markers", "Tak lama kemudian, pada November, ia datang. Dua tahun berselang, pada Juni 2002, ia pergi. Lalu kemudian", "Pada November tahun yang sama, ia datang. Pada Juni 2002, ia pergi. kemudian"),
    (R.TYPOGRAPHY, "year_classifiers", "Pada 2000, sejak 1985 hingga 1991. Pada Juni 2002, 1985–1991. {{sfn|pada 2017}}", "Pada tahun 2000, sejak tahun 1985 hingga tahun 1991. Pada Juni 2002, 1985–1991. {{sfn|pada 2017}}"),
    (R.TYPOGRAPHY, "appositive_commas", "menikahi sesama mahasiswa, Raisa Titarenko, pada 1953", "menikahi sesama mahasiswa Raisa Titarenko pada 1953"),
    (R.TYPOGRAPHY, "conjunction_commas", "belajar giat, dan lulus; London, Paris, dan Berlin; Jerman, dan menjalani", "belajar giat dan lulus; London, Paris, dan Berlin; Jerman dan menjalani"),
    (R.TYPOGRAPHY, "conjunction_commas", "Ia memasak, berlari, dan berenang. Ia pulang, tidak menulis lagi, lalu tidur, dan pergi. Pada 1990, ia memasak, dan berenang", "Ia memasak, berlari, dan berenang. Ia pulang, tidak menulis lagi, lalu tidur dan pergi. Pada 1990, ia memasak dan berenang"),
    (R.TYPOGRAPHY, "introductory_commas", "Namun, pada Agustus 1968, ia diangkat. Namun, Kamerad, janganlah. Tak lama berselang, pada Juli, Raisa", "Namun, pada Agustus 1968 ia diangkat. Namun, Kamerad, janganlah. Tak lama berselang, pada Juli, Raisa"),
    (R.TYPOGRAPHY, "relative_commas", "staf Komite, yang saat itu mencapai 3.000 orang, dipangkas", "staf Komite yang saat itu mencapai 3.000 orang dipangkas"),
    (R.TYPOGRAPHY, "modifier_commas", "banyak pihak, terutama di Barat, memandangnya", "banyak pihak terutama di Barat memandangnya"),
    (R.TYPOGRAPHY, "comma_clutter", "Miller, dan ia juga membaca,, lalu selesai,.", "Miller. Selain itu, ia membaca, lalu selesai."),
    (R.TYPOGRAPHY, "number_separators", "US$ 4.5 juta, 15.8%, versi 1.25, <code>0.75%</code>", "US$ 4,5 juta, 15,8%, versi 1.25, <code>0.75%</code>"),
    (R.TYPOGRAPHY, "semicolons", "musim semi; namun tertunda; para kru bersiap; Penayangan (a; b) &amp; lain", "musim semi, namun tertunda, dan para kru bersiap. Penayangan (a; b) &amp; lain"),
    (R.TYPOGRAPHY, "parenthetical_quotes", '("catatan") lain', "(catatan) lain"),
    (R.TYPOGRAPHY, "link_italics", "[[''Film'']] dan [[Judul|''Film'']]", "''[[Film]]'' dan ''[[Judul|Film]]''"),
    (R.TYPOGRAPHY, "sentence_case", "memuaskan. {{sfn|X|1986}} tugas akhirnya. selesai pada hlm. 45 dan dkk. mereka.<ref>S</ref> sebulan", "memuaskan. {{sfn|X|1986}} Tugas akhirnya. Selesai pada hlm. 45 dan dkk. mereka.<ref>S</ref> Sebulan"),
    (R.TYPOGRAPHY, "image_syntax", "[[File:A.jpg|thumb|right|Kota]] [[Gambar: B.png|left]] thumb|right", "[[Berkas:A.jpg|jmpl|ka|Kota]] [[Berkas:B.png|ki]] thumb|right"),
    (R.TYPOGRAPHY, "quotation_order", 'film "The Runner," dan "Lari."', 'film "The Runner", dan "Lari".'),
    (R.TYPOGRAPHY, "speech_fragments", 'menuturkan bahwa itu "sangat membekas" dalam; sebagai "partai penguasa" di', "menuturkan bahwa itu sangat membekas dalam; sebagai partai penguasa di"),
    (R.TYPOGRAPHY, "compound_hyphens", "pro-Palestina dan anti-perang", "pendukung Palestina dan antiperang"),
    (R.GENERAL_FIXES, "deduplicate_references", 'a<ref name="s">X</ref> b<ref name="s">X</ref> c<ref name="t">Y</ref>', 'a<ref name="s">X</ref> b<ref name="s" /> c<ref name="t">Y</ref>'),
    (R.GENERAL_FIXES, "citation_punctuation", 'satu .<ref>s</ref> dua <ref>s</ref> tiga<ref>1</ref><ref name="r" />.', 'satu.<ref>s</ref> dua<ref>s</ref> tiga.<ref>1</ref><ref name="r" />'),
    (R.GENERAL_FIXES, "duplicate_punctuation", "a,, b.. c... d ; e", "a, b. c... d; e"),
    (R.GENERAL_FIXES, "page_ranges", "pp. 12-15, pages 100-105, p. 42 {{cite|pages=50-60 }}", "hlm. 12–15, hlm. 100–105, hlm. 42 {{cite|pages=50–60 }}"),
    (R.GENERAL_FIXES, "empty_parameters", "{{cite web |url=u |access-date= |archive-url= |url-status= |df= }}", "{{cite web |url=u }}"),
    (R.GENERAL_FIXES, "deprecated_parameters", "{{cite web |url=u |dead-url=no |language=en}}", "{{cite web |url=u |url-status=live }}"),
    (R.GENERAL_FIXES, "glue_references", 'Kota. <ref name="a" /> <ref name="a" /> lain', 'Kota.<ref name="a" /> lain'),
    (R.GENERAL_FIXES, "pleonastic_conjunctions", "Meskipun ditolak, namun ia tetap. Karena arsitek, maka ia suka.", "Meskipun ditolak, ia tetap. Karena arsitek, ia suka."),
    (R.GENERAL_FIXES, "geographic_names", "laut Jawa, selat Sunda, gunung tinggi", "Laut Jawa, Selat Sunda, gunung tinggi"),
    (R.GENERAL_FIXES, "parallel_modifiers", "persahabatan erat serta persekutuan erat", "persahabatan serta persekutuan erat"),
    (R.GENERAL_FIXES, "quote_brackets", 'sebagai "tiga tokoh [feminis] utama"', 'sebagai "tiga tokoh feminis utama"'),
    (R.GENERAL_FIXES, "narrative_colons", "hasilnya jelas: ia menang", "hasilnya jelas. Ia menang"),
    (R.GENERAL_FIXES, "reciprocal_doubling", "mereka saling tolong-menolong", "mereka tolong-menolong"),
    (R.GENERAL_FIXES, "pleonasms", "sangat besar sekali, para tokoh-tokoh naik ke atas", "sangat besar, para tokoh naik"),
    (R.GENERAL_FIXES, "age_phrases", "berumur 20 tahun", "berusia 20 tahun"),
    (R.GENERAL_FIXES, "family_name_notes", "{{Family name hatnote|Kim|lang=Korean}}", "{{efn|Nama keluarganya adalah ''Kim''.}}"),
    (R.GENERAL_FIXES, "image_directions", "Tokoh (left) dan (right)", "Tokoh (kiri) dan (kanan)"),
    (R.GENERAL_FIXES, "fused_words", "tahun1945 ke10 semidan panas medan", "tahun 1945 ke-10 semi dan panas medan"),
    (R.SYNTAX_REPAIR, "paired_tags", "<code>x dan <blockquote>y", "<code>x dan <blockquote>y</code></blockquote>"),
    (R.SYNTAX_REPAIR, "ref_tags", 'a<ref name="s">Buku\n== B ==\nc</ref> d<ref>e</ref>', 'a<ref name="s">Buku</ref>\n== B ==\nc d<ref>e</ref>'),
    (R.SYNTAX_REPAIR, "orphan_references", 'Enoch<ref name="TV" /> lahir<ref name="X">y</ref><ref name="X" />', 'Enoch lahir<ref name="X">y</ref><ref name="X" />'),
    (R.SYNTAX_REPAIR, "quotes", "Ini '''tebal\nlain ''miring", "Ini '''tebal'''\nlain ''miring''"),
    (R.SYNTAX_REPAIR, "links", "Lihat [[Indonesia untuk info]] lain. [[Jakarta|kota]] [[Baru lalu. sisa]]", "Lihat [[Indonesia untuk info]] lain. [[Jakarta|kota]] [[Baru lalu. sisa]]"),
    (R.SYNTAX_REPAIR, "links", "Lihat [[Indonesia untuk info.\nlebih]]. <nowiki>[[x</nowiki>", "Lihat [[Indonesia untuk info.\nlebih]]. <nowiki>[[x</nowiki>"),
    (R.SYNTAX_REPAIR, "links", "Lihat artikel [[Indonesia untuk info. Berlebih", "Lihat artikel [[Indonesia]] untuk info. Berlebih"),
    (R.SYNTAX_REPAIR, "links", "Teks berlebih]].", "Teks berlebih."),
    (R.SYNTAX_REPAIR, "templates", "{{Utama|Sejarah\nArtikel {{a|{{b}}}} }}", "{{Utama|Sejarah\nArtikel {{a|{{b}}}} }}"),
    (R.SYNTAX_REPAIR, "templates", "{{Utama|Sejarah\nArtikel", "{{Utama|Sejarah}}\nArtikel"),
    (R.SYNTAX_REPAIR, "tables", "{| class\n|-\n| a", "{| class\n|-\n| a\n|}"),
    (R.SYNTAX_REPAIR, "note_groups", "{{Efn|Satu.{{sfn|L}}lower-greek}} {{Efn|Tiga.|group=Lower-greek}}", "{{Efn|Satu.{{sfn|L}}|group=lower-greek}} {{Efn|Tiga.|group=lower-greek}}"),
]


@pytest.fixture(scope="module")
def results(spark):
    """All passes in one job."""
    df = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(ALONE)], "i int, text string")
    out = F.lit(None).cast("string")
    for i, (suite, name, _, _) in reversed(list(enumerate(ALONE))):
        out = F.when(F.col("i") == i, R.apply(F.col("text"), suite, only=name)).otherwise(out)
    return {r.i: r.out for r in df.select("i", out.alias("out")).collect()}


@pytest.mark.parametrize("i", range(len(ALONE)), ids=[f"{n}-{i}" for i, (_, n, _, _) in enumerate(ALONE)])
def test_pass(results, i):
    assert results[i] == ALONE[i][3]


def test_numbers_of_passes():
    assert (len(R.TYPOGRAPHY), len(R.SYNTAX_REPAIR)) == (27, 8) and len(R.GENERAL_FIXES) == 21
    assert [p.name for p in R.SYNTAX_REPAIR][:4] == ["paired_tags", "ref_tags", "orphan_references", "quotes"]


def test_appendices(spark):
    text = "Lead.\n\n== Pranala luar ==\n* [https://x y]\n\n== Referensi ==\n{{reflist}}\n\n== Karier ==\nTeks\n\n== Catatan ==\n{{notelist}}\n\n[[Kategori:Uji]]\n"
    out = spark.createDataFrame([(text,), ("tanpa bagian",), (None,), ("",)], "t string").select(R.reorder_appendices(F.col("t")).alias("o")).collect()
    places = [out[0].o.find(x) for x in ("Lead.", "== Karier", "== Catatan", "== Referensi", "== Pranala", "[[Kategori")]
    assert places == sorted(places) and places[0] >= 0 and [r.o for r in out[1:]] == ["tanpa bagian", None, ""]


def test_orphans_take_the_source(spark):
    row = spark.createDataFrame([('a<ref name="TV Guide" /> b', 'x<ref name="TV Guide">{{cite web|title=T}}</ref>')], "t string, s string")
    assert row.select(R.orphan_references(F.col("t"), F.col("s")).alias("o")).first().o == 'a<ref name="TV Guide">{{cite web|title=T}}</ref> b'


def test_suites_and_repair_leave_no_issue(spark):
    broken = ["[[Indonesia untuk", "lebih]]", "{{Utama|x\ny", "a<ref name=\"s\">b\n== c ==", "x</ref>", "{| a\n|-\n| b", "'''t\n''m", "<code>x <blockquote>y", 'z<ref name="q" />', "<nowiki>[[a {{b</nowiki>"]
    fine = ["Ini [[Indonesia]] dan [[Jakarta|kota]].", "{{a|{{b|{{c}}}}}}", 'a<ref name="r">b</ref><ref name="r" />', "{| x\n| a\n|}", "'''a''' ''b'' '''''c'''''"]
    df = spark.createDataFrame([(t,) for t in [*broken, *fine]], "t string").select("t", R.syntax_issues(F.col("t")).alias("before"), R.repair(F.col("t")).alias("r"))
    rows = df.select("t", "before", "r", R.syntax_issues(F.col("r")).alias("after")).collect()
    for r in rows:
        assert not r.after, (r.t, r.r)
        assert (r.t in fine) == (not r.before) or r.t == broken[-1]
        assert r.t not in fine or r.r == r.t
    empty = spark.createDataFrame([(None,), ("",)], "t string").select(R.typography(F.col("t")).alias("a"), R.general_fixes(F.col("t")).alias("b"), R.repair(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in empty] == [(None,) * 3, ("",) * 3]
    whole = spark.createDataFrame([("Praktek ini memiliki resiko .<ref name=\"s\">K</ref>\nLihat pp. 20-25.<ref name=\"s\">K</ref>",)], "t string").select(R.general_fixes(F.col("t")).alias("o")).first().o
    assert whole == "Praktik ini memiliki risiko.<ref name=\"s\">K</ref>\nLihat hlm. 20–25.<ref name=\"s\" />"
