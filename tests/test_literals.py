import re

import pytest

from cloakwork.sources.literals import fold, may_match, required
from cloakwork.sources.rules import load_pack


@pytest.mark.parametrize(("pattern", "want"), [(r"\bAKIA[0-9]{4}", [["akia"]]), (r"a?bc|de+", [["bc", "d"]]), (r"(?:x|y)\d", [["x", "y"]]), (r"\d+", []), (r"[ab]\w", [["a", "b"]]), (r"a*", []), (r"(?<=zz)q", [["zz"], ["q"]]), (r"(?:ab)+c?", [["ab"]]), (r"(?i:Name)\s*:", [["name"], [":"]]), (r"a|\d", []), (r"(?!no)yes", [["yes"]])])
def test_required(pattern, want):
    assert required(re.compile(pattern)) == want


def test_guard_never_hides_a_match():
    texts = ["password: 'Hunter22' senha: x9", "PAſſWORD=abcd1234 KEY", "user: ann.lee\nName: John Smith\n", "İD 4111-1111-1111-1111", "root@web-01:/# aws s3 ls s3://bucket-name/x", "DC=CORP,DC=local CN=ann.lee,OU=IT", "a" * 500, "Workgroup : CORP-NET", "mail ann@example.com 10.0.0.1/24 fe80::1%eth0"]
    for r in load_pack("bundled:rules_extended.yaml"):
        p = r.python()
        needs = required(p)
        for t in texts:
            if p.search(t):
                assert may_match(fold(t), needs), (r.pattern, t)
