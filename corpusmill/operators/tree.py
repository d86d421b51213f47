"""Nested markup as spans: one scan of the tokens of a text with a stack for each kind of mark.

A span has a kind (link, template, table, ref, nowiki, comment), offsets in characters, a state (closed,
open: never closed, stray: a closing mark without an opening one), the place of the span around it in the
list, its depth, and line and column.  The scan is linear in the text at any depth.  What lies in nowiki
and comments is no markup.  All else is built on the spans: findings with place and excerpt, repair, the
prose between spans with its offsets, and a join of points with the spans around them.

A null text has no spans and stays null when repaired.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as DT
from pyspark.sql.functions import pandas_udf

TOKEN = re.compile(r"<!--|-->|<nowiki\s*>|</nowiki\s*>|\[\[|\]\]|\{\{|\}\}|^[:*#]*\{\||^\|\}(?!\})|<ref(?=[\s/>])[^<>]*>|</ref\s*>", re.I | re.M)
#: What each mark opens or closes.
OPENS = {"[[": "link", "{{": "template", "{|": "table", "<r": "ref", "<n": "nowiki", "<!": "comment"}
CLOSES = {"]]": "link", "}}": "template", "|}": "table", "</r": "ref", "</n": "nowiki", "-->": "comment"}
#: What closes an open span with its line.
MISSING = {"template": "}}", "ref": "</ref>"}
#: What a text with a mark of each kind without a partner holds.
MARKS = {"link": ("[[", "]]"), "template": ("{{", "}}"), "table": ("{|", "|}")}
#: Spans that cross each other: how many are looked through for one that is around.
CROSSING = 64
#: A name: words with capitals, the first after a namespace if there is one.
NAME = re.compile(r"(?:\w+:)?[^\W\d_a-z][\w'’.-]*(?: [^\W\d_a-z][\w'’.-]*)*")
PARAMETER = re.compile(r"\n[ \t]*\|(?!\})")
PLAIN = re.compile(r"[^\[\]{}|<>\n]*")

def _struct(text: str = "", whole: str = "") -> DT.StructType:
    return DT.StructType([DT.StructField(n, DT.StringType()) for n in text.split()] + [DT.StructField(n, DT.IntegerType()) for n in whole.split()])


SPAN = _struct("kind state", "begin end inner_end parent depth line col")


def scan(text: str) -> list[dict]:
    """All spans of a text in order of their first mark."""
    out: list[dict] = []
    stacks: dict[str, list[int]] = {k: [] for k in OPENS.values()}
    low = text.lower()
    last = {"comment": low.rfind("-->"), "nowiki": low.rfind("</nowiki")}
    literal = None
    for m in TOKEN.finditer(text):
        token, at = m.group().lower().lstrip(":*#"), m.start()
        closing = CLOSES.get(token) or CLOSES.get(token[:3])
        if literal and closing != literal:
            continue
        if closing:
            if stacks[closing]:
                out[stacks[closing].pop()].update(state="closed", end=m.end(), inner_end=at)
                literal = None
            elif closing != "comment":
                out.append({"kind": closing, "state": "stray", "begin": at, "end": m.end(), "inner_end": at})
            continue
        kind = OPENS[token[:2]]
        if kind == "ref" and token.endswith("/>") or kind == "comment" and at > last["comment"]:
            continue
        if at < last.get(kind, -1):
            literal = kind
        stacks[kind].append(len(out))
        out.append({"kind": kind, "state": "open", "begin": at, "end": m.end(), "inner_end": m.end()})
    lines = [m.start() for m in re.finditer("\n", text)]
    around: list[int] = []
    for i, s in enumerate(out):
        while around and out[around[-1]]["end"] <= s["begin"]:
            around.pop()
        parent = next((j for j in islice(reversed(around), CROSSING) if out[j]["end"] >= s["end"]), -1)
        row = bisect_right(lines, s["begin"] - 1)
        s.update(parent=parent, depth=out[parent]["depth"] + 1 if parent >= 0 else 0, line=row + 1, col=s["begin"] - (lines[row - 1] if row else -1))
        if s["state"] == "closed":
            around.append(i)
    return out


@pandas_udf(DT.ArrayType(SPAN))
def spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else scan(t))


@pandas_udf(DT.ArrayType(_struct("kind", "n")))
def unpaired(text: pd.Series) -> pd.Series:
    """How many marks of each kind have no partner."""

    def one(t: str | None) -> list[dict]:
        found = [s["kind"] for s in scan(t or "") if s["state"] != "closed"]
        return [{"kind": k, "n": found.count(k)} for k in ("link", "template", "ref", "table")]

    return text.map(one)


def _next(places: list[int], at: int, none: int) -> int:
    k = bisect_left(places, at)
    return places[k] if k < len(places) else none


def _link_end(text: str, begin: int, stop: int) -> int:
    """Where an open link is closed: with a label at the end of its line, else after the words with capitals at its start, or before the first mark of punctuation."""
    plain = PLAIN.match(text, begin, stop)
    if plain.end() < stop and text[plain.end()] == "|":
        while text[stop - 1] in " .,;:":
            stop -= 1
        return stop
    name = NAME.match(text, begin, stop)
    return name.end() if name else begin + len(re.split(r"[,.;:!?]", plain.group(), maxsplit=1)[0].rstrip())


def repaired(text: str, kinds: tuple[str, ...]) -> str:
    """`text` with strays of these kinds taken out and open ones closed.

    A link ends after its name, a table with the text.  A template or reference ends with its line, which
    spans that go on and lines of further parameters carry on.  None goes beyond the span around it.
    """
    if not any(mark in text for kind in kinds for mark in MARKS.get(kind, ("",))):
        return text
    found = scan(text)
    if not any(s["kind"] in kinds and s["state"] != "closed" for s in found):
        return text
    lines = [m.start() for m in re.finditer("\n", text)]
    held, hard, k = 0, [], 0
    closed = [s for s in found if s["state"] == "closed"]
    for at in lines:  # line ends outside all closed spans, without a parameter on the next line
        while k < len(closed) and closed[k]["begin"] < at:
            held, k = max(held, closed[k]["end"]), k + 1
        if at >= held and not PARAMETER.match(text, at):
            hard.append(at)
    edits = []
    for i, s in enumerate(found):
        if s["kind"] not in kinds or s["state"] == "closed":
            continue
        if s["state"] == "stray":
            edits.append((s["begin"], s["end"], i, ""))
            continue
        stop = found[s["parent"]]["inner_end"] if s["parent"] >= 0 else len(text)
        if s["kind"] == "link":
            end = _link_end(text, s["end"], min(stop, _next(lines, s["end"], stop)))
            edits.append((end, end, -i, "]]") if end > s["end"] else (s["begin"], s["end"], i, ""))
        elif s["kind"] == "table":
            edits.append((stop, stop, -i, "\n|}"))
        elif s["kind"] in MISSING:
            end = min(stop, _next(hard, s["end"], stop))
            edits.append((end, end, -i, MISSING[s["kind"]]))
    out, at = [], 0
    for begin, end, _, new in sorted(edits):
        out += [text[at:begin], new]
        at = end
    return "".join([*out, text[at:]])


def repair(text: Column, *kinds: str) -> Column:
    @pandas_udf(DT.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repaired(t, kinds))

    return run(text)


def findings(docs: DataFrame, margin: int = 35) -> DataFrame:
    """(doc_id, kind, state, line, col, excerpt) of marks without a partner, with `margin` characters before and after."""
    rows = docs.select("doc_id", "text", F.explode(F.filter(spans("text"), lambda s: s["state"] != "closed")).alias("s"))
    begin = F.greatest(F.lit(0), F.col("s.begin") - margin)
    return rows.select("doc_id", "s.kind", "s.state", "s.line", "s.col", F.col("text").substr(begin + 1, F.col("s.end") + margin - begin).alias("excerpt"))


def prose(text: Column, kinds: tuple[str, ...] = ("template", "table", "ref", "nowiki", "comment")) -> Column:
    """(begin, text) of the stretches outside closed spans of these kinds: a place in a stretch plus its begin is the place in the text."""

    @pandas_udf(DT.ArrayType(_struct("text", "begin")))
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            out, at = [], 0
            for s in scan(t or ""):
                if s["kind"] in kinds and s["state"] == "closed" and s["end"] > at:
                    if s["begin"] > at:
                        out.append({"begin": at, "text": t[at : s["begin"]]})
                    at = s["end"]
            return out + ([{"begin": at, "text": t[at:]}] if t and at < len(t) else [])

        return texts.map(one)

    return run(text)


def found_in_prose(docs: DataFrame, pattern: str, kinds: tuple[str, ...] = ("template", "table", "ref", "nowiki", "comment")) -> DataFrame:
    """(doc_id, begin, end, found): matches of a pattern (of Python) in the prose, with their places in the whole text."""
    compiled = re.compile(pattern)

    @pandas_udf(DT.ArrayType(_struct("found", "begin end")))
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda own: [{"begin": p["begin"] + m.start(), "end": p["begin"] + m.end(), "found": m.group()} for p in own for m in compiled.finditer(p["text"])])

    return docs.select("doc_id", F.inline(run(prose(F.col("text"), kinds))))


#: Bits of a place that the bins of each level leave out.
LEVELS = (7, 10, 13, 16, 19, 22, 25, 28, 31)


def around(points: DataFrame, intervals: DataFrame, by: str = "doc_id") -> DataFrame:
    """Points (by, begin, end, ...) joined with the intervals (by, from, to, ...) that hold them.

    An interval lies in the smallest bin that holds it, a point looks into one bin of each level, so both
    meet by equality and neither is spread over more than nine rows, whatever its length.
    """
    first, last = F.col("from").cast("long"), F.col("to").cast("long") - 1
    level = F.coalesce(*(F.when(F.shiftright(first, n) == F.shiftright(last, n), F.lit(n)) for n in LEVELS))
    held = intervals.withColumn("_level", level).withColumn("_bin", F.expr("shiftright(CAST(`from` AS BIGINT), _level)"))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("_bin", F.expr("shiftright(CAST(begin AS BIGINT), _level)"))
    return asked.join(held, [by, "_level", "_bin"]).filter("`from` <= begin AND end <= `to`").drop("_level", "_bin")
