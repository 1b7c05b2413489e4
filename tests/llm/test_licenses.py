"""Template automata against regular expressions made of the same markup, and their places in long texts."""

import random
import re
import time

import pytest

from colloquy.llm import licenses as L

PHRASES = [(p.encode().split(), x) for p, x in L.BASE]


def as_regex(markup):
    """The template as a regular expression over words that each end with one space."""
    parts = []
    for m in re.finditer(r"(\[)|(\])|\{(?:(\d+)-)?(\d+)\}|([^\s\[\]{}]+)", markup):
        begin, end, low, high, word = m.groups()
        parts.append("(?:" if begin else ")?" if end else f"(?:\\S+ ){{{low or 1},{high}}}" if high else re.escape(word) + " ")
    return re.compile("".join(parts))


def longest(rx, text):
    """Length in words of the longest match at the start, by trying every end."""
    ends = [m.end() for m in re.finditer(" ", text)]
    return max((k + 1 for k, e in enumerate(ends) if rx.fullmatch(text[:e])), default=0)


@pytest.mark.parametrize("markup", ["a [b [c] d] e", "[a] {0-2} b [c]", "{1-3} a b {2} c", "a [a] [a b] a", "x {0-1} [y {1-2} z] w", "[a b] c {0-3}"])
def test_automaton_equals_regex(markup):
    rng, rx, auto = random.Random(1), as_regex(markup), L.Automaton(markup, "x")
    words_of = sorted({w for w in re.findall(r"[a-z]", markup)}) + ["q"]
    for _ in range(400):
        words = [rng.choice(words_of) for _ in range(rng.randint(0, 9))]
        for at in range(len(words)):
            assert auto.match([w.encode() for w in words], at) == longest(rx, "".join(w + " " for w in words[at:]))
        padded = b" " + " ".join(words).encode() + b" "
        want, i = [], 0
        while i < len(words):
            n = longest(rx, "".join(w + " " for w in words[i:]))
            if n:
                want.append((i, n))
            i += n or 1
        assert auto.find([w.encode() for w in words], padded) == want


def filled(markup, optional):
    markup = re.sub(r"\{(?:\d+-)?(\d+)\}", "someone", markup)
    while "[" in markup:
        markup = re.sub(r"\[([^\[\]]*)\]", r"\1" if optional else "", markup)
    return markup


@pytest.mark.parametrize("k", range(len(L.TEMPLATES)))
@pytest.mark.parametrize("optional", [True, False])
def test_whole_templates(k, optional):
    """Alone, at a text's start, in its middle and at its end; not with one mandatory word changed."""
    markup, label = L.TEMPLATES[k]
    text, auto = filled(markup, optional), L.compiled([L.TEMPLATES[k]])
    for t in (text, text + " and more", "some words " + text, "before, " + text.title().replace(" ", "  ") + "\nafter"):
        assert L.scan(t, auto, [])[5] == [label]
    must = re.sub(r"\{[^}]*\}", " ", filled(re.sub(r"\[[^\[\]]*\]", " ", re.sub(r"\[[^\[\]]*\[[^\[\]]*\][^\[\]]*\]", " ", markup)), False)).split()
    words = text.split()
    at = words.index(max(must, key=len))
    broken = " ".join("changed" if w == words[at] else w for w in words)
    assert L.scan(broken, auto, [])[5] == []


def test_templates_need_a_mandatory_word():
    for markup in ("[a b]", "{3}", ""):
        with pytest.raises(ValueError, match="no mandatory word"):
            L.Automaton(markup, "x")


def test_places_in_long_texts_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        text = "cc by nc " * n
        began = time.perf_counter()
        out = L.scan(text, L.compiled(L.TEMPLATES), PHRASES)
        took.append(time.perf_counter() - began)
        assert out[:4] == (3 * n, n, 0, 3 * n - 3) and out[7] == 3 * n
    assert took[1] < 10 * took[0]


def test_awkward_rows(spark):
    rows = [(1, None), (1, None), (None, "under the mit license"), (2, ""), (3, "cc by nc by nc")]
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.labels) for r in out] == [(1, 0, 0, None, []), (1, 0, 0, None, []), (None, 4, 1, 0, ["mit"]), (2, 0, 0, None, []), (3, 5, 1, 0, ["cc-by-nc"])]
