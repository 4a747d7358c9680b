"""Every template against a plain matcher, and against changes of single words."""

import random
import re

import pytest

from turnlake.llm import license_scan as L

SCANNER = L.Scanner()


def instance(template, rng, fill):
    """Words of one text that the template accepts; mandatory marks the words that no markup covers."""
    out, depth, skip = [], 0, []
    for token in re.findall(r"[\[\]]|\{\d+\}|[^\s\[\]{}]+", template):
        if token == "[":
            depth += 1
            skip.append((skip[-1] if skip else False) or not fill(rng))
        elif token == "]":
            depth -= 1
            skip.pop()
        elif skip and skip[-1]:
            continue
        elif token[0] == "{":
            out += [(f"any{rng.randrange(9)}", False) for _ in range(rng.randrange(int(token[1:-1]) + 1))]
        else:
            out.append((rng.choice(token.split("|")), depth == 0))
    return out


def labels_at(words):
    return {(SCANNER.names[t], a, b) for t, a, b in SCANNER.find([w.encode() for w in words])}


@pytest.mark.parametrize("number", range(len(L.TEMPLATES)))
def test_template(number):
    label, _, template = L.TEMPLATES[number]
    rng = random.Random(number)
    for fill in (lambda r: True, lambda r: False, lambda r: r.random() < 0.5):
        made = instance(template, rng, fill)
        words = ["before", *(w for w, _ in made), "after"]
        assert any(x[0] == label and x[1] == 1 and x[2] >= len(words) - 1 - 12 for x in labels_at(words))
        mandatory = [k for k, (_, m) in enumerate(made) if m]
        for k in rng.sample(mandatory, min(12, len(mandatory))):
            changed = [*words]
            changed[k + 1] = "zebra"
            assert all(x[0] != label or x[1] > k + 1 or x[2] <= k + 1 for x in labels_at(changed)), (label, made[k])


def pattern(template):
    """The template as a regular expression over words that each end in a space."""
    out = ""
    for token in re.findall(r"[\[\]]|\{\d+\}|[^\s\[\]{}]+", template):
        out += "(?:" if token == "[" else ")?" if token == "]" else rf"(?:\S+ ){{0,{token[1:-1]}}}" if token[0] == "{" else f"(?:{'|'.join(token.split('|'))}) "
    return re.compile(out)


def test_automata_equal_regular_expressions():
    templates = [("p", 1.0, "a [b] c|d {2} a"), ("q", 1.0, "b {1} [c [a]] b"), ("r", 1.0, "a a"), ("s", 1.0, "{1} c d")]
    scanner = L.Scanner({"a b": "base"}, templates)
    patterns = [pattern(t) for t in ("a b", *(t[2] for t in templates))]
    rng = random.Random(3)
    for _ in range(1500):
        words = [rng.choice("abcdx") for _ in range(rng.randrange(9))]
        got = {(t, a) for t, a, _ in scanner.find([w.encode() for w in words])}
        want = set()
        for a in range(len(words)):
            line = "".join(w + " " for w in words[a:])
            # A match opens with a word that the template names; places are counted where its first word stands.
            want |= {(t, a) for t, p in enumerate(patterns) if p.match(line) and words[a].encode() in scanner.automaton.openers}
        assert got == want


def test_templates_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "You may copy Example Works freely."), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in L.scan(df, templates=[("own", 0.9, "you may copy {2} freely")]).collect()}
    assert rows[1].labels == "own" and rows[1].score == 0.9 and rows[1].base_labels == "" and rows[2].n_words == 0
