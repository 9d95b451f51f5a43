"""Front matter: the YAML block at the top of a note, read as JSON values."""

from __future__ import annotations

import json
import re

import yaml

_FENCED = re.compile(r"\A---\r?\n(.*?)^---\r?(?:\n|\Z)", re.S | re.M)
_LENIENT = re.compile(r"\A---[^\S\n]*\r*\n(.*?)^[^\S\n]*---[^\S\n]*(?:\n|\Z)", re.S | re.M)


class FrontmatterError(ValueError):
    """The block is not YAML, or not a mapping."""


class _Loader(yaml.SafeLoader):
    """YAML 1.2 core scalars: only true/false, null and numbers are not text."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789"),
):
    _Loader.add_implicit_resolver(_tag, re.compile(_pattern), list(_first))
_Loader.add_constructor("tag:yaml.org,2002:int", lambda self, node: int(node.value, 0) if node.value[:2] in ("0x", "0o") else int(node.value))
_Loader.add_constructor("tag:yaml.org,2002:float", lambda self, node: float(node.value.lower().replace(".inf", "inf").replace(".nan", "nan")))


class _Dumper(yaml.SafeDumper):
    def increase_indent(self, flow=False, indentless=False):
        return super().increase_indent(flow, False)


def load_yaml(text: str):
    """A YAML document as JSON values; keys become text."""
    return _plain(yaml.load(text, Loader=_Loader))


def dump_yaml(value) -> str:
    return yaml.dump(value, Dumper=_Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1 << 20)


def _plain(value):
    if isinstance(value, dict):
        return {k if isinstance(k, str) else canonical(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def split(content: str) -> tuple[str | None, int]:
    """The raw block and where the body starts; (None, 0) without a block that starts at the first byte."""
    m = _FENCED.match(content)
    return (m[1], m.end()) if m else (None, 0)


def body(content: str) -> str:
    return content[split(content)[1] :]


def parse(content: str) -> dict | None:
    """The block's mapping; {} for an empty block, None without one."""
    raw, _ = split(content)
    if raw is None:
        return None
    try:
        value = load_yaml(raw)
    except yaml.YAMLError as e:
        raise FrontmatterError(str(e)) from e
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise FrontmatterError("front matter is not a mapping")
    return value


def canonical(value) -> str:
    """JSON with sorted keys, so that equal values are equal texts (2 and 2.0 stay different)."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def string_list(fm: dict | None, key: str) -> list[str]:
    """A list property as texts: arrays item by item without nulls, texts cut at commas."""
    value = (fm or {}).get(key)
    if isinstance(value, list):
        return [v if isinstance(v, str) else canonical(v) for v in value if v is not None]
    return [p for p in map(str.strip, value.split(",")) if p] if isinstance(value, str) else []


def search_text(value) -> str:
    """Keys and scalar values of a JSON value, space-joined, nulls left out."""
    if isinstance(value, dict):
        return " ".join(x for k, v in value.items() for x in (k, search_text(v)) if x)
    if isinstance(value, list):
        return " ".join(x for x in map(search_text, value) if x)
    return "" if value is None else value if isinstance(value, str) else canonical(value)


def _rebuilt(fm: dict, rest: str) -> str:
    return f"---\n{dump_yaml(fm) if fm else ''}---\n{rest}"


def set_field(content: str, key: str, value) -> str:
    return _rebuilt({**(parse(content) or {}), key: value}, body(content))


def remove_field(content: str, key: str) -> str:
    fm = parse(content)
    if not fm or key not in fm:
        return content
    rest = {k: v for k, v in fm.items() if k != key}
    return _rebuilt(rest, body(content)) if rest else body(content)


def with_frontmatter(content: str, fm: dict) -> str:
    return _rebuilt(fm, content)


def prepend(content: str, text: str) -> str:
    """text put right after the front matter, on lines of its own."""
    _, at = split(content)
    head = content[:at]
    return head + ("" if not head or head.endswith("\n") else "\n") + text + ("" if text.endswith("\n") or not text else "\n") + content[at:]


def append(content: str, text: str) -> str:
    return content + ("" if not content or content.endswith("\n") else "\n") + text


def patch_field(content: str, operation: str, key: str, text: str) -> str:
    """replace, append to or prepend to one property; lists take an item, other values are joined as text."""
    m = _LENIENT.match(content)
    if not m:
        raise KeyError(f"no front matter to patch {key!r} in")
    try:
        fm = load_yaml(m[1]) or {}
    except yaml.YAMLError as e:
        raise FrontmatterError(str(e)) from e
    try:
        item = load_yaml(text)
    except yaml.YAMLError:
        item = text
    old = fm.pop(key, None) if operation != "replace" else None
    first = operation == "prepend"
    if operation == "replace":
        fm[key] = item
    elif isinstance(old, list):
        fm[key] = [item, *old] if first else [*old, item]
    else:
        was = "" if old is None else old if isinstance(old, str) else canonical(old) if isinstance(old, (bool, int, float)) else dump_yaml(old).strip()
        fm[key] = text + was if first else was + text
    return _rebuilt(fm, content[m.end() :])
