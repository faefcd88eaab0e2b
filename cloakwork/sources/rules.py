"""Rule packs, denylists, prompts and registries: read on the driver, checked, and refused with an error if malformed.

Rules of a pack are plain rows (`Rule`), which `detect` compiles into expressions, and `rules_frame` shows as a DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from importlib import resources
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

DEEPEST = 8
DEFAULT_PACK = "rules_default.yaml"
DEFAULT_PROMPT = "bundled:prompt_default.txt"
EXTENDED_PACK = "rules_extended.yaml"

#: Names of flags, and the Java inline flag of each. ASCII has none: it leaves the Unicode flag out.
FLAGS = {"IGNORECASE": "i", "I": "i", "MULTILINE": "m", "M": "m", "DOTALL": "s", "S": "s", "VERBOSE": "x", "X": "x", "ASCII": "", "A": ""}
PYTHON_FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL, "x": re.VERBOSE}


@dataclass(frozen=True)
class Rule:
    entity_type: str
    pattern: str
    flags: tuple[str, ...] = ()
    needs: str | None = None
    pack: str = ""

    @property
    def letters(self) -> str:
        return "".join(dict.fromkeys(FLAGS[f] for f in self.flags))

    @property
    def ascii(self) -> bool:
        return bool({"ASCII", "A"} & set(self.flags))

    def python(self) -> re.Pattern[str]:
        found = re.ASCII if self.ascii else re.RegexFlag(0)
        for x in self.letters:
            found |= PYTHON_FLAGS[x]
        return re.compile(self.pattern, found)

    def java(self) -> str:
        """In Java's dialect: Unicode classes, only newlines end lines, named groups without P, other global flags in front."""
        body = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", self.pattern)
        return f"(?d{'' if self.ascii else 'U'}{self.letters}){body}"


class RuleError(ValueError):
    """A malformed rule file, denylist, registry or corpus."""


def read_resource(name: str) -> str:
    try:
        return resources.files("cloakwork.resources").joinpath(name).read_text(encoding="utf-8")
    except (FileNotFoundError, IsADirectoryError) as x:
        raise RuleError(f"no bundled resource {name!r}") from x


def resolve(spec: str) -> tuple[str, str, Path | None]:
    """Text, label and folder of ``bundled:NAME`` (no separators) or of a path."""
    if spec.startswith("bundled:"):
        name = spec.removeprefix("bundled:").strip()
        if not name or "/" in name or "\\" in name:
            raise RuleError(f"{spec!r}: a bundled name has no separators")
        return read_resource(name), spec, None
    try:
        path = Path(spec)
        return path.read_text(encoding="utf-8"), str(path), path.parent
    except OSError as x:
        raise RuleError(f"{spec!r} can't be read: {x}") from x


def _mapping(text: str, label: str, key: str) -> dict:
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as x:
        raise RuleError(f"{label}: not YAML: {x}") from x
    if not isinstance(found, dict) or not isinstance(found.get(key, []), list):
        raise RuleError(f"{label}: a mapping with a list `{key}` is needed")
    return found


def read_flags(raw: object, at: str) -> tuple[str, ...]:
    names = [raw] if isinstance(raw, str) else raw or []
    if not isinstance(names, list) or not all(isinstance(x, str) for x in names):
        raise RuleError(f"{at}: flags are a name or a list of names")
    if unknown := [x for x in names if x.upper() not in FLAGS]:
        raise RuleError(f"{at}: unknown flags {unknown}")
    return tuple(x.upper() for x in names)


def load_pack(spec: str = f"bundled:{DEFAULT_PACK}") -> list[Rule]:
    """The rules of a pack, its own before those of the packs it extends."""
    return list(_load(*resolve(spec), seen=()))


def _load(text: str, label: str, folder: Path | None, seen: tuple[str, ...]) -> Iterable[Rule]:
    if label in seen:
        raise RuleError(f"packs extend each other: {' > '.join((*seen, label))}")
    if len(seen) >= DEEPEST:
        raise RuleError(f"packs extend each other more than {DEEPEST} deep: {' > '.join((*seen, label))}")
    data = _mapping(text, label, "patterns")
    for i, entry in enumerate(data.get("patterns") or []):
        at = f"{label}, entry {i}"
        if not isinstance(entry, dict):
            raise RuleError(f"{at}: not a mapping")
        for key in ("type", "pattern"):
            if not isinstance(entry.get(key), str) or not entry[key]:
                raise RuleError(f"{at}: {key} is a text that isn't empty")
        rule = Rule(entry["type"], entry["pattern"], read_flags(entry.get("flags"), at), next(iter(entry.get("needs") or []), None), label)
        try:
            rule.python()
        except re.error as x:
            raise RuleError(f"{at}: {rule.pattern!r}: {x}") from x
        yield rule
    parents = data.get("extends") or []
    parents = [parents] if isinstance(parents, str) else parents
    if not isinstance(parents, list) or not all(isinstance(x, str) for x in parents):
        raise RuleError(f"{label}: extends is a text or a list of texts")
    for name in filter(None, map(str.strip, parents)):
        if "/" not in name and "\\" not in name:
            yield from _load(*resolve(f"bundled:{name}"), seen=(*seen, label))
        else:
            path = Path(name)
            yield from _load(*resolve(str(path if path.is_absolute() or folder is None else folder / path)), seen=(*seen, label))


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.entity_type, r.pattern, ",".join(r.flags), r.pack) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_idx int, entity_type string, pattern string, flags string, pack string")


def parse_registry(text: str) -> dict[str, str]:
    """name=path,name=path; ``default`` is reserved, names are unique."""
    found: dict[str, str] = {}
    for part in filter(None, map(str.strip, text.split(","))):
        name, eq, path = (x.strip() for x in part.partition("="))
        if not eq or not name or not path:
            raise RuleError(f"registry entry {part!r} isn't name=path")
        if name == "default" or name in found:
            raise RuleError(f"registry name {name!r} is " + ("reserved" if name == "default" else "there twice"))
        found[name] = path
    return found


def select(name: str | None, default: object, registry: dict[str, object], warnings: list[str] | None = None) -> object:
    """What a name stands for; without a name, or with an unknown one, the default."""
    if not name or name == "default":
        return default
    if name not in registry:
        (warnings if warnings is not None else []).append(f"unknown name {name!r}; the default is used")
        return default
    return registry[name]


@dataclass(frozen=True)
class Literal:
    """A denylist entry."""

    entity_type: str
    value: str
    case_sensitive: bool = True
    word_boundary: bool = True


def load_denylist(spec: str | None, warnings: list[str] | None = None) -> list[Literal]:
    """Entries in order, without repetitions of (value, type, case); no spec gives none."""
    if not spec:
        return []
    text, label, _ = resolve(spec)
    return parse_denylist(_mapping(text, label, "entries").get("entries") or [], label, warnings)


def parse_denylist(entries: list, label: str = "denylist", warnings: list[str] | None = None) -> list[Literal]:
    found: dict[tuple, Literal] = {}
    for i, e in enumerate(entries):
        at = f"{label}, entry {i}"
        if not isinstance(e, dict):
            raise RuleError(f"{at}: not a mapping")
        for key in ("type", "value"):
            if not isinstance(e.get(key), str) or not e[key]:
                raise RuleError(f"{at}: {key} is a text that isn't empty")
        for key in ("case_sensitive", "word_boundary"):
            if not isinstance(e.get(key, True), bool):
                raise RuleError(f"{at}: {key} is true or false")
        one = Literal(e["type"], e["value"], e.get("case_sensitive", True), e.get("word_boundary", True))
        key = (one.value, one.entity_type, one.case_sensitive)
        if key in found:
            (warnings if warnings is not None else []).append(f"{at}: {one.value!r} is there twice")
        else:
            found[key] = one
    return list(found.values())


def read_prompt(spec: str) -> str:
    """A prompt is never empty."""
    text = resolve(spec)[0].strip()
    if not text:
        raise RuleError(f"{spec}: the prompt is empty")
    return text
