import pytest

from cloakwork.sources import rules as R
from cloakwork.sources.synthetic import check_cases


def test_packs_load_in_order():
    default, extended = R.load_pack(), R.load_pack("bundled:rules_extended.yaml")
    assert len(default) == 17 and len(extended) == 189
    assert [r.pattern for r in extended[172:]] == [r.pattern for r in default]


def test_extends_depth_cycles_and_paths(tmp_path):
    (tmp_path / "a.yaml").write_text("extends: ./b.yaml\npatterns:\n  - {type: A, pattern: a}\n")
    (tmp_path / "b.yaml").write_text("extends: [rules_default.yaml]\npatterns:\n  - {type: B, pattern: b}\n")
    assert [r.entity_type for r in R.load_pack(str(tmp_path / "a.yaml"))][:3] == ["A", "B", "AWS_ACCESS_KEY"]
    (tmp_path / "b.yaml").write_text("extends: ./a.yaml\npatterns: []\n")
    with pytest.raises(R.RuleError, match="extend each other"):
        R.load_pack(str(tmp_path / "a.yaml"))
    for i in range(12):
        (tmp_path / f"d{i}.yaml").write_text(f"extends: ./d{i + 1}.yaml\npatterns: []\n")
    (tmp_path / "d12.yaml").write_text("patterns: []\n")
    with pytest.raises(R.RuleError, match="deep"):
        R.load_pack(str(tmp_path / "d0.yaml"))


@pytest.mark.parametrize("text", ["- a", "patterns: {}", "patterns: [1]", "patterns: [{type: A}]", "patterns: [{type: A, pattern: ''}]", "patterns: [{type: A, pattern: '('}]", "patterns: [{type: A, pattern: a, flags: [NOPE]}]", "extends: 3\npatterns: []", "a: [", "extends: [missing.yaml]\npatterns: []"])
def test_malformed_packs_are_refused(tmp_path, text):
    (tmp_path / "x.yaml").write_text(text)
    with pytest.raises(R.RuleError):
        R.load_pack(str(tmp_path / "x.yaml"))


def test_registry_and_selection():
    assert R.parse_registry("a=x.yaml, b = y.yaml,") == {"a": "x.yaml", "b": "y.yaml"}
    for bad in ("a", "=x", "a=", "default=x", "a=x,a=y"):
        with pytest.raises(R.RuleError):
            R.parse_registry(bad)
    warned: list = []
    assert R.select("b", "d", {"b": 1}, warned) == 1 and R.select(None, "d", {}, warned) == "d" and not warned
    assert R.select("zz", "d", {"b": 1}, warned) == "d" and warned
    with pytest.raises(R.RuleError):
        R.resolve("bundled:a/b")


def test_denylists():
    warned: list = []
    got = R.parse_denylist([{"type": "A", "value": "x"}, {"type": "A", "value": "x"}, {"type": "B", "value": "x", "case_sensitive": False}], warnings=warned)
    assert len(got) == 2 and len(warned) == 1 and got[0].word_boundary and R.load_denylist(None) == []
    for bad in ([3], [{"type": "A"}], [{"type": "A", "value": ""}], [{"type": "A", "value": "x", "case_sensitive": "yes"}]):
        with pytest.raises(R.RuleError):
            R.parse_denylist(bad)


def test_java_form():
    assert R.Rule("A", r"(?P<entity>\d)", ("I", "M")).java() == r"(?dUim)(?<entity>\d)"
    assert R.Rule("A", "a", ("ASCII",)).java() == "(?d)a"


def test_prompts(tmp_path):
    (tmp_path / "p.md").write_text(" hello ")
    assert R.read_prompt(str(tmp_path / "p.md")) == "hello"
    (tmp_path / "p.md").write_text(" \n")
    with pytest.raises(R.RuleError):
        R.read_prompt(str(tmp_path / "p.md"))


@pytest.mark.parametrize("case", [{"id": "a"}, {"id": "a", "text": "x"}, {"id": "a", "text": "x", "must_keep": ["y"]}, {"id": "a", "text": "x", "expect": [{"text": "z", "type": "A"}]}])
def test_malformed_corpora_are_refused(case):
    with pytest.raises(R.RuleError):
        list(check_cases([case], "c"))
