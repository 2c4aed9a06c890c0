"""Signature matching against a search for each rule."""

import random

import numpy as np
import pytest

from flowloom.operators.signatures import BlockMatcher, Matcher
from flowloom.sources import text


def naive(rules, data):
    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    out = []
    for r in rules:
        hay, needle = (low(data), low(r["content"])) if r["nocase"] else (data, r["content"])
        out += [(r["rule_id"], k + len(needle)) for k in range(len(hay) - len(needle) + 1) if hay[k : k + len(needle)] == needle]
    return sorted(out, key=lambda m: (m[1], m[0]))


def random_rules(rng, least):
    return [{"rule_id": k, "content": bytes(rng.choice(b"abAB\xc3") for _ in range(rng.randrange(least, 6))), "nocase": rng.random() < 0.5} for k in range(rng.randrange(1, 6))]


def test_automaton_and_blocks_find_what_single_searches_find(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(BlockMatcher, "BLOCK", 7)
    for _ in range(200):
        rules = random_rules(rng, 2)
        payloads = [bytes(rng.choice(b"abAB\xc3\xe3") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 6))]
        want = [(k, *m) for k, p in enumerate(payloads) for m in naive(rules, p)]
        offsets = np.cumsum([3, *map(len, payloads)])
        assert BlockMatcher(rules).scan(b"abA" + b"".join(payloads), offsets) == want
        m = Matcher(rules)
        assert [(k, *x) for k, p in enumerate(payloads) for x in sorted(m.scan(p), key=lambda x: (x[1], x[0]))] == want


def test_streams_cut_at_every_place():
    rng = random.Random(5)
    for _ in range(60):
        rules = random_rules(rng, 1)
        data = bytes(rng.choice(b"abAB") for _ in range(20))
        m, want = Matcher(rules), naive(rules, data)
        for cut in range(len(data) + 1):
            tail, got = b"", []
            for at, part in ((0, data[:cut]), (cut, data[cut:])):
                got += [(r, at + e) for r, e in m.scan(part, tail)]
                tail = m.tail(part, tail)
            assert sorted(got, key=lambda x: (x[1], x[0])) == want


@pytest.mark.parametrize("line,error", [
    ("high x", "line 1: "), ('huge x "abc"', "is no severity"), ('high "abc"', "a rule is"), ('high x "abc', "quote is not closed"), ('high x "a|4"', "| is not closed"), ('high x "a|4g|"', "no hexadecimal digit"),
    ('high x "a|4|"', "come in pairs"), ('high x ""', "content is empty"), ('high x "abc" any', "is no option"), ('high x "a\\q"', "is no escape"), ('high x "' + "a" * 129 + '"', "128 bytes"),
])
def test_errors_tell_the_line(line, error):
    if error == "line 1: ":
        assert text.parse_rules(line)[0]["content"] == line.encode()
        return
    with pytest.raises(text.RuleError, match="^line 2: .*"):
        text.parse_rules("# comment\n" + line)
    with pytest.raises(text.RuleError) as e:
        text.parse_rules(line)
    assert error in str(e.value)


def test_rule_lines():
    a, b, c = text.parse_rules('low one "A|42 43|\\"\\||20|d"\n\n medium two "x:y" nocase : told: so \nplain pattern')
    assert (a["content"], a["nocase"], a["message"]) == (b'ABC"| d', False, "Matched one")
    assert (b["severity"], b["nocase"], b["message"]) == ("medium", True, "told: so")
    assert (c["name"], c["severity"], c["message"]) == ("plain pattern", "medium", 'Payload contains "plain pattern"')
    assert len(text.load_rules(text.__file__.replace("sources/text.py", "data/rules.txt"))) == 39
