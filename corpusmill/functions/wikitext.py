"""Column functions on wikitext: plain forms of a text, extraction, predicates, title rules.

Null gives null.  Word lists are arguments with small defaults, so that callers bring their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: word lists of the two languages and of wiki markup
ENGLISH_STOP = ["the", "of", "and", "in", "for", "from", "to", "with", "by", "on", "at"]
ENGLISH_COMMON = ["history", "list", "people", "removal", "products", "applications", "company", "government", "summit", "agent", "war", "year", "film", "university"]
TARGET_MARKERS = ["dan", "dari", "yang", "untuk", "dengan", "pada", "di", "ke", "perusahaan", "pemberhentian", "sejarah", "daftar"]
GENERIC = ["pemberhentian", "sejarah", "produk", "perusahaan", "model", "daftar", "kota", "partai", "tokoh"]
NAMESPACES = [("Template", "Templat"), ("Category", "Kategori"), ("File", "Berkas"), ("Image", "Berkas"), ("User", "Pengguna"), ("Module", "Modul")]
DISAMBIGUATORS = [("film", "film"), ("song", "lagu"), ("album", "album"), ("novel", "novel"), ("band", "grup musik"), ("politician", "politikus"), ("actor", "aktor"), ("footballer", "pemain sepak bola"), ("disambiguation", "disambiguasi")]
MAGIC_WORDS = ["pagename", "fullpagename", "namespace", "currentyear", "currentmonth", "defaultsort", "displaytitle", "notoc", "toc", "sitename", "lc", "uc", "ucfirst", "urlencode", "formatnum"]
GENRES = ["laga", "horor", "drama", "komedi", "romantis", "fiksi ilmiah", "cerita seru", "animasi", "dokumenter", "petualangan"]
COUNTRIES = ["Amerika Serikat", "Indonesia", "Britania Raya", "Jepang", "Korea Selatan", "Prancis", "Jerman", "India", "Australia", "Kanada"]
TOPICS = [
    ("film", "film|bioskop|sutradara|aktor|aktris"), ("computing_science", "komputer|perangkat lunak|internet|pemrograman"), ("medical_biology", "biologi|spesies|hewan|tumbuhan|penyakit"),
    ("geography", "geografi|wilayah|kota|provinsi|sungai"), ("history_social", "sejarah|kerajaan|perang|dinasti|presiden"), ("physics_astronomy", "matematika|fisika|rumus|teorema"),
]
PROMOTIONAL = "gemini|language model|llm|\\bai\\b|\\bbot\\b|grade a\\+*|flash"
MONTH_NUMBERS = [("Januari", "01"), ("Februari", "02"), ("Maret", "03"), ("April", "04"), ("Mei", "05"), ("Juni", "06"), ("Juli", "07"), ("Agustus", "08"), ("September", "09"), ("Oktober", "10"), ("November", "11"), ("Desember", "12")]

_REFS = "(?s)<ref[^>]*/>|<ref[^>/]*>.*?</ref>"
_COMMENTS = "(?s)<!--.*?-->"


def without_templates(text) -> Column:
    """Templates out, from the inside; four levels."""
    return reduce(lambda t, _: F.regexp_replace(t, "\\{\\{[^{}]*\\}\\}", ""), range(4), T.col(text))


def link_labels(text) -> Column:
    """[[target|label]] and [[label]] become their labels; files and categories go."""
    return T.rewrite(text, [("\\[\\[(?:File|Image|Berkas|Category|Kategori):[^\\[\\]]*\\]\\]", ""), ("\\[\\[[^\\[\\]|]*\\|([^\\[\\]]*)\\]\\]", "$1"), ("\\[\\[([^\\[\\]]*)\\]\\]", "$1"), ("\\[https?://[^\\s\\]]+ ?([^\\]]*)\\]", "$1")])


def for_extraction(text) -> Column:
    """Text from which terms are taken: no comments, formulas, references, templates, files, headings or 'as X' of roles; links stay."""
    t = T.rewrite(text, [(_COMMENTS, " "), ("(?s)<math[^>]*>.*?</math>", " "), (_REFS, " "), ("\\[\\[(?:File|Image|Berkas):[^\\[\\]]*\\]\\]", " ")])
    return T.rewrite(without_templates(t), [("(?m)^=+[^=\\n]+=+ *$", ""), ("\\bas \\p{Lu}\\p{L}+(?: \\p{Lu}\\p{L}+)*", ""), ("[ \\t]+", " ")])


def claims(text) -> Column:
    """Text that states something: no references, templates, tables, headings or categories; links as their labels."""
    t = T.rewrite(text, [(_COMMENTS, ""), (_REFS, ""), ("(?s)\\{\\|.*?\\|\\}", "")])
    return F.trim(T.rewrite(link_labels(without_templates(t)), [("(?m)^=+[^=\\n]+=+ *$", ""), ("'{2,}", ""), ("[ \\t]+", " "), ("\\n{2,}", "\n")]))


def prose(text) -> Column:
    """What a reader sees: claims without tags, with references to characters decoded and white space single."""
    t = T.rewrite(claims(text), [("<[^>]+>", " "), ("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")])
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def sentences(text, least_words: int = 3) -> Column:
    """Sentences that neither a decimal point nor an abbreviation ends."""
    guarded = T.rewrite(text, [("([0-9])\\.([0-9])", "$1․$2"), ("\\b(Dr|Mr|Mrs|Ms|Prof|St|vs|etc|No|hlm|hal|dkk|dll|dsb|[A-Z])\\.", "$1․")])
    parts = F.split(F.regexp_replace(guarded, T.SENTENCE_END, "$0␞"), "␞")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(F.translate(s, "\n", " "), "․", "."))), lambda s: T.n_matches(s, T.WORD) >= least_words)


def average_sentence_length(text) -> Column:
    """Words in a sentence on average, sentences of two words or fewer left aside; 0 without any."""
    n = F.transform(sentences(text), lambda s: T.n_matches(s, T.WORD))
    return F.when(F.size(n) > 0, F.aggregate(n, F.lit(0), lambda a, x: a + x) / F.size(n)).otherwise(F.lit(0.0))


#: Families of candidate terms in a cleaned text.
FAMILIES = {
    "link": ("\\[\\[([^\\[\\]|#]+)", 1), "alias": ("\\[\\[[^\\[\\]|]+\\|([^\\[\\]]+)\\]\\]", 1), "quoted": ('"([^"\\n]{3,60})"', 1), "italic": ("''([^'\\n]{3,60})''", 1), "phrase": ("\\p{Lu}\\p{L}+(?: \\p{Lu}\\p{L}+)+", 0),
    "joined": ("\\p{Lu}\\p{L}+(?: (?:of|the|and|de|van|von|bin) (?:the )?\\p{Lu}\\p{L}+)+", 0), "name": ("\\p{Lu}\\p{L}{3,}", 0), "compound": ("\\b\\p{L}+(?:-\\p{L}+)+\\b", 0),
}


def candidates(text) -> Column:
    """Array of (family, term) found in a text."""
    t = for_extraction(text)

    def family(name: str, pattern: str, group: int) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(group))), lambda x: F.struct(F.lit(name).alias("family"), F.trim(x).alias("term")))

    found = [family(k, p, g) for k, (p, g) in FAMILIES.items()]
    return F.filter(F.concat(*found), lambda x: x["term"] != "")


def entities(text) -> Column:
    """Names in a text: links, labels and capitalised runs, without those that are part of a longer one."""
    t = F.regexp_replace(for_extraction(text), "'{2,}", "")
    names = F.array_distinct(F.transform(F.concat(F.regexp_extract_all(t, F.lit("\\[\\[([^\\[\\]|#]+)"), F.lit(1)), T.matches(t, FAMILIES["joined"][0]), T.matches(t, FAMILIES["phrase"][0]), T.matches(F.regexp_replace(t, "(?:^|[.!?\\n] ?)\\p{Lu}\\p{L}+", ""), FAMILIES["name"][0])), lambda x: F.trim(x)))
    return F.array_sort(F.filter(names, lambda n: ~F.exists(names, lambda m: (m != n) & F.contains(F.concat(F.lit(" "), m, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" "))))))


# predicates -------------------------------------------------------------------------------


def _all(text, pattern: str = "\\b[a-z]+\\b") -> Column:
    return T.matches(F.lower(F.trim(T.col(text))), pattern)


def _in(words: Column, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*listed)))


def english_title(title, stop: list[str] = ENGLISH_STOP, common: list[str] = ENGLISH_COMMON) -> Column:
    """A stop word among several words, one common word alone, or two common words."""
    w = _all(title)
    return ((F.size(w) > 1) & (_in(w, stop) > 0)) | ((F.size(w) == 1) & (_in(w, common) == 1)) | (_in(w, common) >= 2)


def target_title(title, markers: list[str] = TARGET_MARKERS) -> Column:
    """A title in the target language: two marker words, or one among four words or fewer of several."""
    w = _all(title)
    return (_in(w, markers) >= 2) | ((_in(w, markers) >= 1) & F.size(w).between(2, 4))


def generic_title(title, foreign, generic: list[str] = GENERIC) -> Column:
    """One general word for a subject that takes three words or more elsewhere."""
    w = T.words(F.lower(title))
    return (F.size(w) == 1) & (_in(w, generic) == 1) & (F.size(T.words(foreign)) >= 3)


def language_code(code) -> Column:
    return F.trim(T.col(code)).rlike("^[a-z]{2,3}(?:-[a-z]{2,8})?$")


def listed_share(text) -> Column:
    """Share of the lines with text that begin like a table or a list; 0 without lines."""
    lines = F.filter(F.transform(F.split(T.col(text), "\n"), lambda x: F.trim(x)), lambda s: s != "")
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda s: s.rlike("^(?:\\{\\||[|!*#;:])"))) / F.size(lines)).otherwise(F.lit(0.0))


def boilerplate(heading, text, headings: list[str]) -> Column:
    """A section under one of `headings` whose lines are all templates, links or reference lists, or have six plain words at most."""
    key = F.lower(F.trim(F.regexp_replace(T.col(heading), "[^A-Za-z0-9 ]", "")))
    lines = F.filter(F.transform(F.split(T.col(text), "\n"), lambda x: F.trim(x)), lambda s: s != "")
    fixed = "(?i)^(?:\\{\\{[^{}]*\\}\\}|<references ?/?>|\\*? ?\\[https?://[^\\s\\]]+ [^\\]]+\\]|\\*? ?\\[\\[[^\\]]+\\]\\])"
    plain = lambda s: F.size(F.filter(F.split(s, " +"), lambda w: ~w.rlike("^(?:\\[\\[|\\{\\{|http)")))
    return key.isin(*headings) & F.forall(lines, lambda s: s.rlike(fixed) | (plain(s) <= 6))


def magic_word(name, words: list[str] = MAGIC_WORDS) -> Column:
    return F.lower(F.regexp_extract(T.col(name), "^\\s*#?([^:|}]+)", 1)).isin(*words) | F.startswith(F.trim(T.col(name)), F.lit("#"))


def topic(text, cascade: list[tuple[str, str]] = TOPICS) -> Column:
    """The first topic with a key word in the text, else general."""
    low, out = F.lower(T.col(text)), F.lit("general")
    for name, words in reversed(cascade):
        out = F.when(low.rlike(f"\\b(?:{words})\\b"), name).otherwise(out)
    return out


def film_category(name) -> Column:
    n = F.lower(F.regexp_replace(T.col(name), "^(?:Kategori|Category):", ""))
    return n.rlike("^film\\s") | n.rlike("\\sfilms?$") | n.rlike("films? (?:by|set in|directed by|menurut|yang disutradarai)\\b") | F.contains(n, F.lit(" film"))


def film_consensus(name, genres: list[str] = GENRES, countries: list[str] = COUNTRIES) -> Column:
    """(ok, reason) of a film category: one level only, and no part of a united kingdom."""
    n = F.regexp_replace(T.col(name), "^(?:Kategori|Category):", "")
    g, low = "|".join(genres), F.lower(n)
    reason = (
        F.when(~low.rlike("^film"), F.lit(None).cast("string")).when(low.rlike("\\bfilm (?:inggris|skotlandia|wales|irlandia utara)\\b"), "subdivided country").when(low.rlike(f"\\bfilm (?:{g}) (?:{g})\\b"), "two genres")
        .when(low.rlike(f"^film (?:{g}) tahun [0-9]{{4}}$"), "genre and year").when(low.rlike(f"^film (?:{g}) (?:{'|'.join(c.lower() for c in countries)})$"), "genre and country")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def edit_summary(summary, fallback: str = "rapikan draf", most: int = 100) -> Column:
    """A short summary as a person writes it: redirects named, machine words out, cut at a word, parentheses closed, never empty."""
    s = F.trim(F.coalesce(T.col(summary), F.lit("")))
    to = F.regexp_extract(s, "(?i)\\b(?:mengalihkan|alih) ke\\s*(\\[\\[[^\\]]+\\]\\])", 1)
    t = T.rewrite(s, [(f"(?i){PROMOTIONAL}", ""), ("\\s+", " "), ("^[\\s:,–—()-]+|[\\s:,–—(-]+$", "")])
    t = F.when(F.length(t) > most, F.regexp_replace(F.substring(t, 1, most), " [^ ]*$", "")).otherwise(t)
    opened, closed = F.regexp_count(t, F.lit("\\(")), F.regexp_count(t, F.lit("\\)"))
    t = F.when(opened > closed, F.concat(t, F.lit(")"))).when(opened < closed, F.regexp_replace(t, "\\)", "")).otherwise(t)
    return F.when(to != "", F.concat(F.lit("mengalihkan ke "), to)).when(F.trim(t) == "", fallback).otherwise(F.trim(t))


def verdict(score, fatal) -> Column:
    """Rework below 70 or with a fatal finding, revise below 90, else the basic check is passed."""
    return F.when((T.col(score) < 70) | (T.col(fatal) > 0), "rework").when(T.col(score) < 90, "revise").otherwise("passed")


# titles, dates, numbers -------------------------------------------------------------------


def title_in(text, namespaces: list[tuple[str, str]] = NAMESPACES) -> Column:
    """A title with the target language's namespace and a capital first letter in each part."""
    t = F.trim(F.regexp_replace(F.translate(T.col(text), "_", " "), " +", " "))
    space, rest = F.regexp_extract(t, "^([^:]+): *", 1), F.regexp_replace(t, "^[^:]+: *", "")
    named = F.lower(space).isin(*(x.lower() for pair in namespaces for x in pair))
    mapped = F.coalesce(*(F.when(F.lower(space) == a.lower(), b) for a, b in namespaces), *(F.when(F.lower(space) == b.lower(), b) for _, b in namespaces))
    return F.when(named, F.concat(mapped, F.lit(":"), T.title(rest))).otherwise(T.title(t))


def localised_title(title, words: list[tuple[str, str]] = DISAMBIGUATORS) -> Column:
    """The disambiguator in the target language, its year before or after it."""
    t = T.col(title)
    inner = F.regexp_extract(t, " \\(([^()]*)\\)$", 1)
    year, kind = F.regexp_extract(inner, "([0-9]{4})", 1), F.trim(F.regexp_replace(inner, "[0-9]{4}", ""))
    mapped = F.coalesce(*(F.when(F.lower(kind) == a, b) for a, b in words), kind)
    label = F.trim(F.concat_ws(" ", mapped, F.when(year != "", year)))
    return F.when(inner == "", t).otherwise(F.concat(F.regexp_replace(t, " \\([^()]*\\)$", ""), F.lit(" ("), label, F.lit(")")))


def interlanguage_links(text) -> Column:
    """Array of (raw, title, lang, target, label) of {{ill|title|lang|target|lt=label}}; a missing target is the title."""
    found = T.matches(text, "\\{\\{(?:[Ii]ll|[Ii]nterlanguage link)\\|[^{}]*\\}\\}")

    def parsed(raw: Column) -> Column:
        parts = F.transform(F.split(F.regexp_replace(raw, "^\\{\\{[^|]*\\||\\}\\}$", ""), "\\|"), lambda x: F.trim(x))
        place = F.filter(parts, lambda p: ~p.rlike("^[A-Za-z0-9]+ *="))
        named = F.filter(parts, lambda p: p.rlike("^(?:lt|display|label) *="))
        label = F.regexp_replace(F.get(named, F.lit(0)), "^[a-z]+ *= *", "")
        return F.struct(raw.alias("raw"), F.get(place, F.lit(0)).alias("title"), F.get(place, F.lit(1)).alias("lang"), F.coalesce(F.get(place, F.lit(2)), F.get(place, F.lit(0))).alias("target"), label.alias("label"))

    return F.transform(found, parsed)


def one_language(text) -> Column:
    """Interlanguage links of several languages cut to English where they have it, else to their first."""
    return T.rewrite(text, [
        ("\\{\\{([Ii]ll)\\|([^{}|]+)\\|(?:[a-z-]{2,8}\\|[^{}|=]+\\|)*en\\|([^{}|=]+)(?:\\|[a-z-]{2,8}\\|[^{}|=]+)*(\\|[a-z]+=[^{}|]*)?\\}\\}", "{{$1|$2|en|$3$4}}"),
        ("\\{\\{([Ii]ll)\\|([^{}|]+)\\|([a-z-]{2,8})\\|([^{}|=]+)(?:\\|[a-z-]{2,8}\\|[^{}|=]+)+(\\|[a-z]+=[^{}|]*)?\\}\\}", "{{$1|$2|$3|$4$5}}"),
    ])


def iso_date(text) -> Column:
    """'5 Januari 2020' as 2020-01-05; what is no such date gives null."""
    t = T.col(text)
    day, month, year = (F.regexp_extract(t, "^ *([0-9]{1,2}) (\\p{L}+) ([0-9]{4}) *$", k) for k in (1, 2, 3))
    number = F.coalesce(*(F.when(month == a, b) for a, b in MONTH_NUMBERS))
    return F.when(number.isNotNull(), F.concat_ws("-", year, number, F.lpad(day, 2, "0")))


def swapped_separators(text) -> Column:
    """1,234.5 as 1.234,5: thousands and decimals change their marks; a lone decimal point becomes a comma."""
    return T.rewrite(text, [("([0-9]),([0-9]{3})", "$1․$2"), ("([0-9]),([0-9]{3})", "$1․$2"), ("([0-9])\\.([0-9])", "$1,$2"), ("․", ".")])


def crores(text) -> Column:
    """Crore and lakh as million, thousand: amounts in rupees in the target language's scale words."""
    def scaled(t: Column, word: str, by: float, unit: str) -> Column:
        parts = F.split(F.regexp_replace(t, f"([0-9]+(?:[.][0-9]+)?) {word}\\b", f"␞$1␟{word}␞"), "␞")
        amount = lambda p: F.regexp_replace(F.regexp_replace(F.round(F.split(p, "␟")[0].cast("double") * by, 2).cast("string"), "\\.0$", ""), "\\.", ",")
        return F.array_join(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("␟")), F.concat(amount(p), F.lit(f" {unit}"))).otherwise(p)), "")

    return scaled(scaled(T.col(text), "crore", 10.0, "juta"), "lakh", 100.0, "ribu")


def category_parts(name, nationalities: list[tuple[str, str]] = (("American", "Amerika Serikat"), ("British", "Britania Raya"), ("Japanese", "Jepang"), ("Indonesian", "Indonesia")), genres: list[tuple[str, str]] = (("drama", "drama"), ("comedy", "komedi"), ("action", "laga"), ("horror", "horor"))) -> Column:
    """Categories that replace one such as '1990s American comedy-drama films': decade or year, country, each genre."""
    n = T.col(name)
    year, country = F.regexp_extract(n, "^([0-9]{4}s?)\\b", 1), F.coalesce(*(F.when(n.rlike(f"\\b{a}\\b"), b) for a, b in nationalities))
    when = F.when(year.rlike("s$"), F.concat(F.lit("Film dasawarsa "), F.regexp_replace(year, "s$", "-an"))).when(year != "", F.concat(F.lit("Film tahun "), year))
    kinds = [F.when(F.lower(n).rlike(f"\\b{a}\\b"), F.lit(f"Film {b}")) for a, b in genres]
    return F.filter(F.array(F.when(country.isNotNull(), F.concat(F.lit("Film "), country)), when, *kinds), lambda x: x.isNotNull())
