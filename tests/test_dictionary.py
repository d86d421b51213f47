"""The longest keys of a dictionary, against a scan that tries every key, and true cycles against reachability."""

import random

import pytest
import regex

from corpusmill.operators import dictionary, graph

KEYS = ["a", "a b", "a b c", "b c", "b", "c d e", "d", "e a", "ab"]


def by_hand(text):
    """At each word the longest key whose words stand there with single spaces in between."""
    out, at = [], 0
    while at < len(text):
        best = ""
        if regex.match(r"\w", text[at]) and (at == 0 or not regex.match(r"\w", text[at - 1])):
            for k in KEYS:
                end = at + len(k)
                if text[at:end].lower() == k and (end >= len(text) or not regex.match(r"\w", text[end])) and len(k) > len(best):
                    best = k
        if best:
            out.append((at, at + len(best), best))
        at += len(best) or 1
    return out


@pytest.mark.parametrize("sent", [dictionary.SENT_KEYS, 0])
def test_longest_keys_win(spark, sent):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "c", "d", "e", "A", "B"]) + rng.choice([" ", " ", " ", "  ", "", ", "]) for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += ["", None, texts[0], "a b c" * 3000, " ".join("abcde" * 4000)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    entries = spark.createDataFrame([(k, k.replace(" ", "_")) for k in KEYS] + [("A  b", "z"), (None, "x"), ("c", None), ("!", "x"), ("", "y")], "key string, value string")
    got = {r["doc_id"]: r for r in dictionary.apply_dictionary(rows, entries, sent_keys=sent).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        found = got[i]["found"]
        assert got[i]["key"] == "x"
        if t is None:
            assert found["text"] is None and found["hits"] == []
            continue
        want = by_hand(t)
        assert [tuple(h) for h in found["hits"]] == want
        done, out = 0, []
        for a, b, k in want:
            out += [t[done:a], dictionary.in_case(t[a:b], k.replace(" ", "_"))]
            done = b
        assert found["text"] == "".join([*out, t[done:]])


@pytest.mark.parametrize("sent", [dictionary.SENT_KEYS, 0])
def test_case_is_copied_and_an_empty_dictionary_changes_nothing(spark, sent):
    rows = spark.createDataFrame([("Analisa data ANALISA analisa tehnik baru",)], "text string")
    entries = spark.createDataFrame([("analisa", "analisis"), ("tehnik baru", "teknik baru")], "key string, value string")
    assert dictionary.apply_dictionary(rows, entries, sent_keys=sent).first()["found"]["text"] == "Analisis data ANALISIS analisis teknik baru"
    assert dictionary.apply_dictionary(rows, entries.limit(0), sent_keys=sent).first()["found"]["text"] == "Analisa data ANALISA analisa tehnik baru"
    assert dictionary.apply_dictionary(rows.limit(0), entries, sent_keys=sent).count() == 0


def test_true_cycles(spark):
    rng = random.Random(3)
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("s", "s"), ("x", None), (None, "x"), ("d", "p1"), ("p1", "p2"), ("p2", "p3"), ("p3", "p1"), ("p3", "q"), ("p1", "p2")]
    edges += [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)]
    got = {r["node"]: r["cycle"] for r in graph.cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    reach = {}
    for s in {x for e in edges for x in e if x}:
        seen, todo = set(), [s]
        while todo:
            n = todo.pop()
            for a, b in edges:
                if a == n and b and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    want = {s: min(m for m in r if s in reach[m]) for s, r in reach.items() if s in r}
    assert got == want and got["p2"] == "p1" and got["s"] == "s" and not {"a", "b", "c", "d", "q"} & set(got)
    assert graph.cycles(spark.createDataFrame([], "src string, dst string")).count() == 0
