"""Every text that a rule's regex can match holds the rule's keyword, and passes the prefilter."""

import re
import re._parser as parser

from linkloom.llm.licenses import prefilter
from linkloom.llm.license_rules import RULES


def samples(tree):
    """Texts that a parsed regex matches: each branch, options with and without."""
    out = [""]
    for op, value in tree:
        kind = str(op)
        if kind == "LITERAL":
            own = [chr(value)]
        elif kind == "IN":
            own = [chr(x if str(k) == "LITERAL" else x[0]) for k, x in value]
        elif kind == "ANY":
            own = ["q"]
        elif kind == "MAX_REPEAT":
            low, _, sub = value
            own = [""] * (low == 0) + [x * max(1, low) for x in samples(sub)]
        elif kind == "SUBPATTERN":
            own = samples(value[3])
        else:
            own = [x for branch in value[1] for x in samples(branch)]
        out = [a + b for a in out for b in own][:500]
    return out


def test_keywords_cover_their_rules():
    gate = re.compile(prefilter(RULES))
    for rule in RULES:
        for text in samples(parser.parse(rule.regex)):
            assert f" {rule.keyword}" in f" {' '.join(text.split())} ", (rule, text)
            assert gate.search(text)
