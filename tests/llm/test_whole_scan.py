"""The keyword gates of the license rules lose no detection."""

import re._constants as c
import re._parser as parser
from itertools import product

import pytest

from loomstone.llm import license_scan


def examples(tree):
    """One text per combination of a pattern's alternatives, optional parts left out and put in."""
    parts = []
    for op, value in tree:
        if op is c.LITERAL:
            parts.append([chr(value)])
        elif op is c.IN:
            kind, first = value[0]
            parts.append([chr(first) if kind is c.LITERAL else chr(first[0]) if kind is c.RANGE else "1"])
        elif op is c.MAX_REPEAT:
            least, _, inner = value
            parts.append([x * least for x in examples(inner)[:1]] + ([] if least else examples(inner)))
        elif op is c.SUBPATTERN:
            parts.append(examples(value[3]))
        elif op is c.BRANCH:
            parts.append([x for branch in value[1] for x in examples(branch)])
        elif op is not c.ASSERT_NOT:
            raise ValueError(op)
    return ["".join(x) for x in product(*parts)]


def ungated(lowered):
    rules, patterns = license_scan._compiled()[1], license_scan._compiled()[3]
    found = [(m.start(), m.end(), k) for k, p in enumerate(patterns) for m in p.finditer(lowered)]
    return license_scan.suppress(found, [r.priority for r in rules])


def test_gates_are_implied_by_every_alternative():
    rules, patterns = license_scan._compiled()[1], license_scan._compiled()[3]
    for rule, pattern in zip(rules, patterns, strict=True):
        for text in {x.encode("latin-1") for x in examples(parser.parse(rule.pattern))}:
            assert pattern.fullmatch(text), (rule.label, rule.form, text)
            assert all(any(k.encode() in text for k in group) for group in rule.keywords), (rule.label, rule.form, text)


@pytest.mark.parametrize("form", ["version", "notice", "name", "spdx", "address", "text"])
def test_gated_and_ungated_scans_agree(form):
    for rule in (r for r in license_scan.signature_rules() if r.form == form):
        for text in {x.encode("latin-1") for x in examples(parser.parse(rule.pattern))}:
            assert license_scan.detect(text) == ungated(text) != [], (rule.label, text)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("GNU GPL v2 or later", "gpl"), ("see the Creative Commons Attribution-ShareAlike 4.0 text", "cc-by-sa"), ("Creative Commons Zero", "cc0"),
        ("Attribution-NonCommercial-NoDerivatives", "cc-by-nc-nd"), ("Attribution-NonCommercial", "cc-by-nc"), ("Attribution-NoDerivs", "cc-by-nd"),
    ],
)
def test_names_without_the_usual_keyword(text, label):
    rules = license_scan.signature_rules()
    assert label in {rules[k].label for _, _, k in license_scan.detect(text.lower().encode())}
