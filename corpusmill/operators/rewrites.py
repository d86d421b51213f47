"""Ordered rewrite passes over wikitext: typography, general fixes and syntax repair.

A pass is a name, a scope and either rules (pattern, replacement), applied in order as JVM regular
expressions, or a function of a column.  The order of a suite is part of its meaning and stands in one
constant.  Passes of scope "prose" see only what lies between links, templates, references, code and
the like; those of scope "text" see everything.  All of it is column expressions, so a suite runs in
the scan.  A null text stays null, an empty one empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from . import tree

Rule = tuple[str, str]


class Pass(NamedTuple):
    name: str
    scope: str
    work: list[Rule] | Callable[[Column], Column]
    #: A pattern that is found wherever a rule of the pass matches.
    when: str | None = None


#: Stretches that no prose pass touches.
KEPT = (
    "<!--.*?-->|<nowiki>.*?</nowiki>|<math[^>]*>.*?</math>|<code[^>]*>.*?</code>|<ref[^>]*/>|<ref[^>/]*>.*?</ref>|<[^>]*>"
    "|\\{\\{(?:[^{}]|\\{\\{[^{}]*\\}\\})*\\}\\}|\\[\\[[^\\[\\]]*\\]\\]|\\[?https?://[^\\s\\]]*\\]?"
)
#: The same for the JVM, which looks at one character before it tries the alternatives.
_KEPT = f"(?=[<{{\\[h])(?:{KEPT})"
#: Where a text is cut: a noncharacter of Unicode, which text that is exchanged does not hold.
_CUT = "\ufdd0"


def between(text: Column, kept: str, change: Callable[[Column], Column]) -> Column:
    """`change` applied to what lies between matches of `kept`."""
    parts = F.split(F.regexp_replace(text, f"(?s)({kept})", f"{_CUT}$1{_CUT}"), _CUT)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(change(p))), "")


#: Rules of a long pass that one test is for.
TOGETHER = 12
_TOKEN = re.compile(r"\\p\{\w+\}|\\.|\[(?:\\.|[^\]\\])*\]|\{[0-9,]+\}|.", re.S)


def held(pattern: str) -> str:
    """The longest string that every match of a pattern holds, as far as a look at its tokens tells; else an empty one."""
    tokens = _TOKEN.findall(pattern)

    def parsed(i: int) -> tuple[list[str | None] | None, int]:
        out, choice = [], False
        while i < len(tokens) and (t := tokens[i]) != ")":
            i += 1
            if t == "|":
                choice = True
            elif t == "(":
                plain = tokens[i] != "?" or tokens[i + 1] == ":"
                inner, i = parsed(i + (2 if tokens[i] == "?" else 0))
                i += 1
                fixed = plain and inner is not None and (i >= len(tokens) or tokens[i][0] not in "*+?{")
                out += inner if fixed else [None]
            elif t in "*+?" or t[0] == "{" and len(t) > 1:
                if out and out[-1] is not None:
                    out[-1:] = [None] if t in "*?" or t[1:2] == "0" else [out[-1], None]
            elif t[0] == "\\" and t[1] not in "bB" or t[0] not in "\\^$":
                known = not t[1].isalnum() if t[0] == "\\" else len(t) == 1 and t != "."
                out.append(t[-1] if known else None)
        return None if choice else out, i

    found = None if "(?i)" in pattern else parsed(0)[0]
    return max("".join("\0" if c is None else c for c in found or []).split("\0"), key=len)


def _ruled(text: Column, p: Pass) -> Column:
    """The rules of a pass where their texts can be: a pattern that needs a string is not tried on a text without it."""
    needed = [held(a) for a, _ in p.work]

    def where(t: Column, marks: list[str], change: Callable[[Column], Column]) -> Column:
        if not all(marks):
            return change(t)
        there = lambda x: reduce(lambda y, z: y | z, (F.contains(x, F.lit(m)) for m in dict.fromkeys(marks)))
        return T.bound(t, lambda x: F.when(there(x), change(x)).otherwise(x))

    def every(t: Column) -> Column:
        # some rules together in a long pass, since each test makes the expression deeper
        size = 1 if len(p.work) <= TOGETHER else TOGETHER
        for i in range(0, len(p.work), size):
            t = where(t, needed[i : i + size], lambda x, i=i: T.rewrite(x, p.work[i : i + size]))
        return t

    if p.when is not None:
        return T.bound(text, lambda t: F.when(t.rlike(p.when), every(t)).otherwise(t))
    return where(text, needed, every) if len(p.work) > 1 else every(text)


def _change(p: Pass) -> Callable[[Column], Column]:
    return p.work if callable(p.work) else (lambda t: _ruled(t, p))


def apply(text: Column, suite: list[Pass], only: str | None = None) -> Column:
    """The passes of a suite in order, or the one named.  Prose passes that follow each other share one cut of the text: none of them changes where markup lies."""
    for scope, run in groupby((p for p in suite if only in (None, p.name)), key=lambda p: p.scope):
        changes = [_change(p) for p in run]
        every = lambda t, changes=changes: reduce(lambda x, c: c(x), changes, t)
        text = between(text, _KEPT, every) if scope == "prose" else every(text)
    return text


def any_case(pairs: list[tuple[str, str]]) -> list[Rule]:
    """Rules for whole words in small letters, with a capital and in capitals."""
    out = []
    for a, b in pairs:
        out += [(f"\\b{a}\\b", b), (f"\\b{a.capitalize()}\\b", b.capitalize()), (f"\\b{a.upper()}\\b", b.upper())]
    return out


def any_word(words: list[str]) -> str:
    """A pattern that finds a begin like that of any of the words, small, with a capital or in capitals, by first letters."""
    by: dict[str, list[str]] = {}
    for a in dict.fromkeys(f(a) for a in words for f in (str, str.capitalize, str.upper)):
        by.setdefault(a[0], []).append(a[1:])
    return f"(?=[{''.join(by)}])\\b(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in by.items())})"


# fixed values: names, months and word forms of the target language
MONTHS = [("January", "Januari"), ("February", "Februari"), ("March", "Maret"), ("April", "April"), ("May", "Mei"), ("June", "Juni"), ("July", "Juli"), ("August", "Agustus"), ("September", "September"), ("October", "Oktober"), ("November", "November"), ("December", "Desember")]
METADATA = "[Ss]hort description|[Uu]se (?:dmy|mdy) dates|[Uu]se [A-Z][a-z]+ English|[Gg]ood article|[Ff]eatured article|[Pp]p-[a-z-]+|[Ee]ngvarB"
PREFIXES = "pasca|pro|anti|non|pra|antar|multi|sub|ultra|semi|kontra|ekstra|intra|supra"
COMMON_NOUNS = ["bencana", "perang", "pembubaran", "revolusi", "pemilihan", "kematian", "kemerdekaan", "kudeta"]
SPELLING = [
    ("aktifitas", "aktivitas"), ("analisa", "analisis"), ("merubah", "mengubah"), ("praktek", "praktik"), ("resiko", "risiko"), ("jaman", "zaman"), ("ijin", "izin"), ("obyek", "objek"), ("subyek", "subjek"), ("faham", "paham"),
    ("fikiran", "pikiran"), ("kwantitas", "kuantitas"), ("kwalitas", "kualitas"), ("sistim", "sistem"), ("tehnik", "teknik"), ("diagnosa", "diagnosis"), ("hipotesa", "hipotesis"), ("metoda", "metode"), ("standarisasi", "standardisasi"),
    ("pertanggung jawaban", "pertanggungjawaban"), ("satupun", "satu pun"), ("siapapun", "siapa pun"), ("apapun", "apa pun"), ("didalam", "di dalam"), ("diatas", "di atas"), ("dibawah", "di bawah"), ("diantara", "di antara"),
]
FEATURES = ["laut", "selat", "gunung", "danau", "sungai", "pulau", "teluk", "tanjung"]
OPENERS = "Namun|Sementara itu|Tak lama kemudian|Tak lama berselang|Selain itu|Akan tetapi"
DIRECTIONS = [("left", "kiri"), ("right", "kanan"), ("center", "tengah"), ("top", "atas"), ("bottom", "bawah")]
IMAGE_WORDS = [("thumbnail", "jmpl"), ("thumb", "jmpl"), ("right", "ka"), ("left", "ki"), ("center", "pus"), ("none", "tanpa"), ("upright", "lurus"), ("frameless", "nirbing"), ("frame", "bing")]
APPENDICES = ["Lihat pula", "Catatan", "Referensi", "Rujukan", "Daftar pustaka", "Bacaan lanjutan", "Pranala luar"]
NOTE_GROUPS = ["lower-alpha", "lower-greek", "lower-roman", "upper-alpha", "upper-roman"]
ABBREVIATIONS = {"hlm.", "hal.", "dkk.", "dll.", "dsb.", "no.", "vol.", "ed.", "dr.", "st."}


# typography -------------------------------------------------------------------------------


def _dates() -> list[Rule]:
    param = "(\\|\\s*(?:date|access-date|archive-date|publication-date)\\s*=\\s*)"
    out = []
    for en, to in MONTHS:
        out += [(f"{param}{en} ([0-9]{{1,2}}), ([0-9]{{4}})", f"$1$2 {to} $3"), (f"{param}([0-9]{{1,2}}) {en} ([0-9]{{4}})", f"$1$2 {to} $3"), (f"{param}{en} ([0-9]{{4}})", f"$1{to} $2")]
    return out


def capital(w: Column) -> Column:
    return F.concat(F.upper(w.substr(F.lit(1), F.lit(1))), w.substr(F.lit(2), F.length(w)))


def sentence_headings(text: Column, proper: list[str] | None = None) -> Column:
    """Headings in sentence case: the first word as it is, others small unless they are on the list or hold a capital further in."""
    keep = F.array(*map(F.lit, proper or ["Indonesia"]))

    def one(line: Column) -> Column:
        words = F.split(F.regexp_extract(line, "^=+ *(.*?) *=+ *$", 1), " ")
        small = F.transform(words, lambda w, i: F.when((i == 0) | F.array_contains(keep, w) | w.rlike("^.+\\p{Lu}"), w).otherwise(F.lower(w)))
        mark = F.regexp_extract(line, "^(=+)", 1)
        return F.when(F.startswith(line, F.lit("==")) & line.rlike("^={2,6} *[^=].*[^=] *={2,6} *$"), F.concat(mark, F.lit(" "), F.array_join(small, " "), F.lit(" "), mark)).otherwise(line)

    return T.bound(text, lambda t: F.when(F.contains(t, F.lit("==")), F.array_join(F.transform(F.split(t, "\n"), one), "\n")).otherwise(t))


def capital_after_period(text: Column) -> Column:
    """A small letter after the end of a sentence becomes a capital, also where references stand between; abbreviations end none."""
    note = "(?:\\{\\{sfn[^{}]*\\}\\}|<ref[^>/]*>[^<]*</ref>|<ref[^>]*/>)"
    cut = F.split(text, f" (?:(?<=[.!?] )(?={note}* ?\\p{{Ll}})|(?<=(?:\\}}\\}}|</ref>|/>) )(?=\\p{{Ll}}))")

    def all_of(parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            def after(before: Column) -> Column:
                ended = F.rtrim(F.regexp_replace(before, f"{note}+$", ""))
                ends = ended.rlike("[.!?]$") & ~F.lower(F.regexp_extract(ended, "(\\S+)$", 1)).isin(*sorted(ABBREVIATIONS))
                return F.when(ends | ((i > 1) & (ended == "") & F.rtrim(F.get(parts, i - 2)).rlike("[.!?]$")), capital(p)).otherwise(p)

            return F.when((i > 0) & p.rlike("^\\p{Ll}"), T.bound(F.get(parts, i - 1), after)).otherwise(p)

        return F.array_join(F.transform(parts, one), " ")

    return T.bound(cut, all_of)


def semicolons(text: Column) -> Column:
    """Semicolons become commas or full stops; those of character references and in parentheses stay."""
    rules = [("; (namun|tetapi|sedangkan|sehingga|karena|dan|serta|atau)\\b", ", $1"), ("; (\\p{Ll})", ", dan $1"), ("; (\\p{Lu})", ". $1")]
    return T.bound(text, lambda t: F.when(F.contains(t, F.lit("; ")), between(t, "&[A-Za-z0-9#]+;|\\([^()]*\\)", lambda p: T.rewrite(p, rules))).otherwise(t))


def _before_links() -> list[Rule]:
    both = f"({PREFIXES}|{'|'.join(p.capitalize() for p in PREFIXES.split('|'))})"
    out = [(f"\\b{both}-\\[\\[([^\\[\\]|]+)\\|(\\p{{Ll}}+) ([^\\[\\]|]+)\\]\\]", "$1$3 [[$2|$4]]")]
    return out + [(f"\\b{both}-\\[\\[{n.capitalize()} ([^\\[\\]|]+)\\]\\]", f"$1{n} [[{n.capitalize()} $2|$2]]") for n in COMMON_NOUNS]


_BOTH = f"({PREFIXES}|{'|'.join(p.capitalize() for p in PREFIXES.split('|'))})"
_VERB = "(?:me|ber|di)\\p{Ll}{3,}|lulus|pergi|tiba|tinggal"
_ADVERBS = "tidak|juga|lalu|kemudian|telah|sudah|akan|terus"
#: Stands for a comma that stays: a noncharacter of Unicode.
_HELD = "\ufdd2"
TYPOGRAPHY = [
    Pass("strip_metadata_templates", "text", [(f"\\{{\\{{(?:{METADATA})(?:\\|[^{{}}]*)?\\}}\\}}\\n?", "")]),
    Pass("citation_dates", "text", _dates(), "\\|\\s*(?:date|access-date|archive-date|publication-date)\\s*=[^=]*(?:" + "|".join(en for en, _ in MONTHS) + ")"),
    Pass("headings", "text", sentence_headings),
    Pass("bound_morphemes_before_links", "text", _before_links()),
    Pass("en_dashes", "text", [("\\b(hlm|hal|pp|p)\\. ?([0-9]+)-([0-9]+)", "$1. $2–$3"), ("(\\|\\s*pages?\\s*=\\s*[0-9]+)-([0-9]+)", "$1–$2"), ("(^|[\\s(])([0-9]{4})-([0-9]{4}|[0-9]{2})([\\s.,;:)]|$)", "$1$2–$3$4")]),
    Pass("em_dashes", "prose", [("([\\p{L}0-9.)\"'])\\s?—\\s?(\\p{Ll}|[0-9])", "$1, $2"), ("([\\p{L}0-9)\"'])\\s?—\\s?(\\p{Lu})", "$1. $2")]),
    Pass("quotations", "text", [("[“”„]", '"'), ("[‘’]", "'")]),
    Pass("bound_morphemes", "prose", [(f"\\b{_BOTH}[- ](\\p{{Ll}})", "$1$2"), (f"\\b{_BOTH} (\\p{{Lu}})", "$1-$2")], any_word(PREFIXES.split("|")) + "[- ]"),
    Pass("spelling", "prose", any_case(SPELLING), any_word([a for a, _ in SPELLING])),
    Pass("collocations", "prose", [
        ("\\bkhalayak (pelayat|pengunjung|penonton)\\b", "kerumunan $1"), ("\\bsalah satu (tokoh|orang|pemimpin|penulis|seniman)\\b", "salah seorang $1"), ("\\badalah merupakan\\b", "merupakan"), ("\\bagar supaya\\b", "agar"), ("\\bdemi untuk\\b", "demi"),
        ("\\bPada bulan (\\p{Lu}\\p{Ll}+ [0-9]{4}), misalnya, ", "Sebagai contoh, pada $1 "), ("\\b([Pp])ada bulan (\\p{Lu}\\p{Ll}+)", "$1ada $2"), ("\\b(ke|di) sebuah (pusat|rumah sakit|sekolah|universitas|kantor)\\b", "$1 $2"),
    ]),
    Pass("double_temporal_markers", "prose", [
        ("\\bTak lama (?:berselang|kemudian), pada (\\p{Lu}\\p{Ll}+),", "Pada $1 tahun yang sama,"), ("\\b\\p{L}+ tahun (?:berselang|kemudian), pada (\\p{Lu}\\p{Ll}+ [0-9]{4}),", "Pada $1,"),
        ("\\b[Ll]alu kemudian\\b", "kemudian"), ("\\b[Pp]ada awalnya mulanya\\b", "pada awalnya"),
    ]),
    Pass("year_classifiers", "prose", [("\\b([Pp]ada|[Ss]ejak|[Hh]ingga|[Ss]ampai) ([12][0-9]{3})([\\s.,;)]|$)", "$1 tahun $2$3")]),
    Pass("appositive_commas", "prose", [("\\b(sesama \\p{Ll}+|[Pp]utr[ai]nya|[Ii]strinya|[Ss]uaminya|saat itu), (\\p{Lu}[\\p{L}-]*(?: \\p{Lu}[\\p{L}-]*)*), ", "$1 $2 ")]),
    # a predicate between commas before the conjunction makes a serial list, whose last comma is held apart meanwhile
    Pass("conjunction_commas", "prose", [(f"(, (?:(?:{_ADVERBS}) )?(?:{_VERB})\\b[^,.;:!?\n]*), (dan|serta) ({_VERB})\\b", f"$1{_HELD} $2 $3"), (f", (dan|serta) ({_VERB})\\b", " $1 $2"), (_HELD, ",")]),
    Pass("introductory_commas", "prose", [(f"\\b({OPENERS}), ((?:pada|dalam|di|sesampainya|setelah|ketika|sejak) [^,.;\\n]+), (\\p{{Ll}})", "$1, $2 $3")]),
    Pass("relative_commas", "prose", [(", (yang (?:[^,.;\\n]|[.,][0-9])+), (\\p{Ll})", " $1 $2"), (", ((?:setelah|selain) [^,.;\\n]+), yang ", " ($1) yang ")]),
    Pass("modifier_commas", "prose", [(", ((?:terutama|khususnya|terlebih) [^,.;\\n]+), (\\p{Ll})", " $1 $2")]),
    Pass("comma_clutter", "prose", [(", dan (ia|mereka) juga ", ". Selain itu, $1 "), (",{2,}", ","), (",\\.", "."), (" +,", ",")]),
    Pass("number_separators", "prose", [("([0-9])\\.([0-9]{1,2})(%| (?:persen|ribu|juta|miliar|triliun)\\b)", "$1,$2$3"), ("((?:US\\$|[$€£]|Rp) ?[0-9]+)\\.([0-9]{1,2})([^0-9.]|$)", "$1,$2$3")]),
    Pass("semicolons", "prose", semicolons),
    Pass("parenthetical_quotes", "text", [('\\("([^"()]*)"\\)', "($1)")]),
    Pass("link_italics", "text", [("\\[\\[''([^\\[\\]|']+)''\\]\\]", "''[[$1]]''"), ("\\[\\[([^\\[\\]|]+)\\|''([^\\[\\]|']+)''\\]\\]", "''[[$1|$2]]''")]),
    Pass("sentence_case", "text", capital_after_period),
    Pass("image_syntax", "text", [("\\[\\[(?:File|Image|Gambar) ?: *", "[[Berkas:"), *((f"(\\[\\[Berkas:[^\\[\\]]*)\\| *{a} *(\\||\\]\\])", f"$1|{b}$2") for a, b in IMAGE_WORDS)]),
    # of no suite's order in the reference: quotation order, speech fragments, compounds
    Pass("quotation_order", "text", [('"([^"\\n]*[^".,\\n])([,.])"', '"$1"$2'), ("''([^'\\n]*[^'.,\\n])([.,])''", "''$1''$2")]),
    Pass("speech_fragments", "prose", [('(\\bbahwa [^".\\n]*)"(\\p{Ll}[^"\\n]*)" ', "$1$2 "), ('\\b(sebagai|menjadi) "(\\p{Ll}[^"\\n]*)" ', "$1 $2 ")]),
    Pass("compound_hyphens", "prose", [("\\bpro-(\\p{Lu})", "pendukung $1"), ("\\b(anti|non)-(\\p{Ll})", "$1$2")]),
]
#: Passes that only run where they are asked for by name.
APART = ("quotation_order", "speech_fragments", "compound_hyphens")


def typography(text: Column) -> Column:
    """The typography suite in its order, without the passes that run only by name."""
    return apply(text, [p for p in TYPOGRAPHY if p.name not in APART])


# general fixes ----------------------------------------------------------------------------


def reorder_appendices(text: Column, order: list[str] = APPENDICES) -> Column:
    """Appendix sections last and in their order; other sections keep theirs, and closing categories stay at the end."""

    def moved(t: Column, tail: Column) -> Column:
        parts = F.split(t.substr(F.lit(1), F.length(t) - F.length(tail)), "(?m)(?=^== ?[^=])")
        ranked = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.regexp_extract(p, "^== ?([^=\\n]*?) ?==", 1)), F.lit(0)).alias("rank"), i.alias("at"), F.rtrim(p).alias("part")))
        joined = lambda r: F.concat(F.array_join(F.transform(F.array_sort(r), lambda x: x["part"]), "\n\n"), tail)
        return T.bound(ranked, lambda r: F.when(F.exists(r, lambda x: x["rank"] > 0), joined(r)).otherwise(t))

    tail = lambda t: F.regexp_extract(t, "(?s)((?:\\s*\\[\\[(?:Kategori|Category):[^\\]]*\\]\\])*\\s*)$", 1)
    return T.bound(text, lambda t: F.when(F.contains(t, F.lit("==")), T.bound(tail(t), lambda end: moved(t, end))).otherwise(t))


def first_reference_wins(text: Column) -> Column:
    """Of named references with the same content the first stays, later ones only name it."""

    def named(parts: Column) -> Column:
        again = lambda p, i: p.rlike('^<ref name="[^"]+">') & (F.array_position(parts, p) <= i)
        return F.array_join(F.transform(parts, lambda p, i: F.when(again(p, i), F.regexp_replace(p, '(?s)^<ref name="([^"]+)">.*</ref>$', '<ref name="$1" />')).otherwise(p)), "")

    return T.bound(text, lambda t: F.when(F.contains(t, F.lit("<ref name=")), T.bound(F.split(t, "(?=<ref name=)|(?<=</ref>)"), named)).otherwise(t))


_REFS = "((?:<ref[^>/]*>[^<]*</ref>|<ref[^>]*/>)+)"
GENERAL_FIXES = [
    Pass("reorder_appendices", "text", reorder_appendices),
    Pass("deduplicate_references", "text", first_reference_wins),
    Pass("citation_punctuation", "text", [(" +([.,])(<ref)", "$1$2"), ("([\\p{L}0-9\"')\\]]) +(<ref)", "$1$2"), (f"([^.,\\s]){_REFS}([.,])", "$1$3$2")]),
    Pass("duplicate_punctuation", "prose", [(",{2,}", ","), ("([^.])\\.\\.([^.]|$)", "$1.$2"), (" +([,;:])", "$1"), ("([!?])[!?]+", "$1")]),
    Pass("page_ranges", "text", [("\\b(?:pp|pages)\\.? ([0-9]+)-([0-9]+)", "hlm. $1–$2"), ("\\b(?:p|page)\\.? ([0-9]+)", "hlm. $1"), ("(\\|\\s*pages?\\s*=\\s*[0-9]+)-([0-9]+)", "$1–$2")]),
    Pass("empty_parameters", "text", [("\\|\\s*(?:access-date|archive-url|archive-date|url-status|df|via|quote|ref)\\s*=\\s*([|}])", "$1")] * 4),
    Pass("deprecated_parameters", "text", [("\\|\\s*dead-?url\\s*=\\s*no\\b", "|url-status=live"), ("\\|\\s*dead-?url\\s*=\\s*yes\\b", "|url-status=dead"), ("\\|\\s*language\\s*=\\s*en(?:-[A-Z]+)?\\s*([|}])", "$1"), ("\\|\\s*accessdate\\s*=", "|access-date=")]),
    Pass("glue_references", "text", [("[ \\t]+(<ref)", "$1"), ('(<ref name="[^"]*" />)(?:\\1)+', "$1")]),
    Pass("pleonastic_conjunctions", "prose", [("\\b(Meskipun|Walaupun|Sekalipun) ([^,.\\n]+), (?:namun|tetapi) ", "$1 $2, "), ("\\b(Karena|Sebab) ([^,.\\n]+), maka ", "$1 $2, ")]),
    Pass("geographic_names", "prose", [(f"\\b{f} (\\p{{Lu}})", f"{f.capitalize()} $1") for f in FEATURES]),
    Pass("bound_morphemes", "prose", [(f"\\b{_BOTH}[- ](\\p{{Ll}})", "$1$2")], any_word(PREFIXES.split("|")) + "[- ]"),
    Pass("parallel_modifiers", "prose", [("\\b(\\p{L}+) (\\p{L}+) (dan|serta) (\\p{L}+) \\2\\b", "$1 $3 $4 $2")]),
    Pass("quote_brackets", "text", [('("[^"\\[\\]\\n]*)\\[(\\p{Ll}+)\\]([^"\\[\\]\\n]*")', "$1$2$3")]),
    Pass("narrative_colons", "prose", [("(\\p{Ll}): ia ", "$1. Ia "), ("(\\p{Ll}): mereka ", "$1. Mereka "), ("(\\p{Ll}): hal ini ", "$1. Hal ini ")]),
    Pass("reciprocal_doubling", "prose", [("\\b([Ss])aling (\\p{Ll}+-me\\p{Ll}+)\\b", "$2")]),
    Pass("pleonasms", "prose", [("\\badalah merupakan\\b", "merupakan"), ("\\bsangat (\\p{Ll}+) sekali\\b", "sangat $1"), ("\\bpara (\\p{Ll}+)-\\1\\b", "para $1"), ("\\bnaik ke atas\\b", "naik"), ("\\bturun ke bawah\\b", "turun")]),
    Pass("age_phrases", "prose", [("\\bberumur ([0-9]+) tahun\\b", "berusia $1 tahun"), ("\\bpada umur ([0-9]+) tahun\\b", "pada usia $1 tahun"), ("\\b([0-9]+) tahun usianya\\b", "berusia $1 tahun")]),
    Pass("family_name_notes", "text", [("\\{\\{[Ff]amily name (?:footnote|hatnote|explanation)\\|([^{}|]*)[^{}]*\\}\\}", "{{efn|Nama keluarganya adalah ''$1''.}}")]),
    Pass("image_directions", "text", [(f"\\({a}\\)", f"({b})") for a, b in DIRECTIONS]),
    Pass("fused_words", "prose", [("\\b(tahun|abad|tanggal|bulan)([0-9]+)\\b", "$1 $2"), ("\\bke([0-9]+)\\b", "ke-$1"), ("\\b(semi|panas|gugur|dingin)dan\\b", "$1 dan")]),
    Pass("typos", "prose", any_case(SPELLING), any_word([a for a, _ in SPELLING])),
]


def general_fixes(text: Column) -> Column:
    return apply(text, GENERAL_FIXES)


# syntax repair ----------------------------------------------------------------------------

_VALID_REF = "<ref[^>]*/>|<ref[^>/]*>(?:[^<\\n]|<(?!/?ref|\\n==))*</ref>"
_NOWIKI = "<nowiki>.*?</nowiki>|<!--.*?-->"


def number_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def close_tags(text: Column, tags: tuple[str, ...] = ("nowiki", "code", "blockquote")) -> Column:
    """Closing tags added at the end for those that are missing."""

    def closed(text: Column, tag: str) -> Column:
        missing = F.greatest(F.lit(0), number_of(text, f"<{tag}(?: [^>]*)?>") - number_of(text, f"</{tag}>"))
        return F.when(F.contains(text, F.lit(f"<{tag}")), F.concat(text, F.repeat(F.lit(f"</{tag}>"), missing))).otherwise(text)

    return reduce(lambda x, tag: T.bound(x, lambda t: closed(t, tag)), tags, text)


def close_refs(text: Column) -> Column:
    """References left open end with their line; closing tags without an opening go."""
    return between(text, f"{_VALID_REF}|{_NOWIKI}", lambda p: T.rewrite(p, [("</ref>", ""), ("(<ref(?: [^>/\\n]*)?>[^\\n]*)", "$1</ref>")]))


def orphan_references(text: Column, source: Column | None = None) -> Column:
    """References by name that nothing defines take the definition of the `source` text, or go."""
    made = F.regexp_extract_all(source, F.lit('(?s)<ref name="[^"]+">.*?</ref>'), F.lit(0)) if source is not None else None

    def put(acc: Column, o: Column) -> Column:
        own = F.get(F.filter(made, lambda m: F.startswith(m, F.concat(F.lit('<ref name="'), o, F.lit('">')))), F.lit(0)) if made is not None else F.lit("")
        return F.replace(F.replace(acc, F.concat(F.lit('<ref name="'), o, F.lit('"/>')), F.concat(F.lit('<ref name="'), o, F.lit('" />'))), F.concat(F.lit('<ref name="'), o, F.lit('" />')), F.coalesce(own, F.lit("")))

    return T.bound(text, lambda t: F.when(F.contains(t, F.lit('<ref name="')), F.aggregate(_orphans(t), t, put)).otherwise(t))


def _orphans(text: Column) -> Column:
    """Names of references that are used and not defined."""
    used = F.array_distinct(F.regexp_extract_all(text, F.lit('<ref name="([^"]+)" */>'), F.lit(1)))
    return F.array_except(used, F.regexp_extract_all(text, F.lit('<ref name="([^"]+)">'), F.lit(1)))


def close_quotes(text: Column) -> Column:
    """Bold and italics closed at the end of each line."""

    def one(line: Column) -> Column:
        bold, italic = _quotes(line)
        return F.when(F.contains(line, F.lit("''")), F.concat(line, F.when(italic, "''").otherwise(""), F.when(bold, "'''").otherwise(""))).otherwise(line)

    # no lambda in here names the value of another one around it: Spark takes no Python function out of a plan whose arguments do
    return T.bound(text, lambda t: F.when(F.contains(t, F.lit("''")), F.array_join(F.transform(F.split(t, "\n"), one), "\n")).otherwise(t))


def _quotes(line: Column) -> tuple[Column, Column]:
    """Whether bold is still open at the end of a line, and whether italics are."""
    five, rest = number_of(line, "'{5}"), F.regexp_replace(line, "'{5}", "")
    return (number_of(rest, "'{3}") + five) % 2 == 1, (number_of(F.regexp_replace(rest, "'{3}", ""), "'{2}") + five) % 2 == 1


def close_links(text: Column) -> Column:
    """An open link ends after its name, or with its line where it has a label; closing brackets without an opening go."""
    return tree.repair(text, "link")


def close_templates(text: Column) -> Column:
    """An open template ends with its line and the parameters that follow, or with the span around it; closing braces without an opening go."""
    return tree.repair(text, "template")


def close_tables(text: Column) -> Column:
    """An open table ends with the text; closing marks without an opening go."""
    return tree.repair(text, "table")


SYNTAX_REPAIR = [
    Pass("paired_tags", "text", close_tags),
    Pass("ref_tags", "text", close_refs),
    Pass("orphan_references", "text", orphan_references),
    Pass("quotes", "text", close_quotes),
    Pass("links", "text", close_links),
    Pass("templates", "text", close_templates),
    Pass("tables", "text", close_tables),
    Pass("note_groups", "text", [rule for g in NOTE_GROUPS for rule in ((f"(\\}}\\}}|[^|={{}}])(?i:\\|?(?:group=)?{g})\\}}\\}}", f"$1|group={g}}}}}"),)]),
]


def repair(text: Column) -> Column:
    return apply(text, SYNTAX_REPAIR)


def syntax_issues(text: Column) -> Column:
    """Array of (kind, n): marks without a partner outside nowiki."""

    def own(t: Column) -> Column:
        quotes = F.transform(F.filter(F.split(t, "\n"), lambda s: F.contains(s, F.lit("''"))), lambda s: F.array(*_quotes(s)))
        odd = T.bound(quotes, lambda q: F.array(F.size(F.filter(q, lambda x: x[0])), F.size(F.filter(q, lambda x: x[1]))))
        tags = {tag: F.when(F.contains(t, F.lit(f"{tag}")), F.abs(number_of(t, f"<{tag}(?: [^>]*)?>") - number_of(t, f"</{tag}>"))).otherwise(0) for tag in ("nowiki", "code", "blockquote")}
        counts = lambda o: F.array(*(F.struct(F.lit(k).alias("kind"), n.cast("int").alias("n")) for k, n in {"bold": o[0], "italic": o[1], **tags}.items()))
        return F.struct(F.size(_orphans(t)).alias("orphans"), T.bound(odd, counts).alias("counts"))

    def found(both: Column) -> Column:
        orphans = both["own"]["orphans"]
        marks = F.transform(both["marks"], lambda x: F.struct(x["kind"].alias("kind"), (x["n"] + F.when(x["kind"] == "ref", orphans).otherwise(0)).cast("int").alias("n")))
        return F.filter(F.concat(marks, both["own"]["counts"]), lambda x: x["n"] > 0)

    counted = T.bound(F.regexp_replace(text, f"(?s){_NOWIKI}", ""), own)
    return T.bound(F.struct(tree.unpaired(text).alias("marks"), counted.alias("own")), found)
