"""Run configurations and schemas: read on the driver, as data."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from docgauge.operators.scoring import FieldSpec, declared

try:
    import yaml
except ImportError:  # JSON configurations work without it
    yaml = None

# Fixed value: ${NAME} or ${NAME:-default}; a variable that is set but empty counts as unset.
REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")
DEFAULT_PROMPT = "Read the document and answer with JSON only.\n\nFields:\n{fields}\n\nSchema:\n{schema}\n"


def digest(value: Any, length: int = 12) -> str:
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:length]


def expand(value: Any, environment: dict[str, str] | None = None) -> Any:
    """References to the environment filled in, at any depth; one without value and default is an empty text."""
    known = os.environ if environment is None else environment
    match value:
        case str():
            return REFERENCE.sub(lambda m: known.get(m[1]) or m[2] or "", value)
        case dict():
            return {k: expand(v, environment) for k, v in value.items()}
        case list():
            return [expand(v, environment) for v in value]
    return value


@dataclass
class Config:
    name: str
    runner: str = "ollama"
    model: str = ""
    params: dict[str, Any] = field(default_factory=dict)
    prompt: str = ""
    host: str | list[str] = ""
    preprocess: str = "none"
    weights: dict[str, float] = field(default_factory=dict)
    critical_fields: list[str] = field(default_factory=list)

    # What changes a model's answers, and so is hashed; names, hosts, weights and critical fields don't.
    ANSWERING = ("runner", "model", "params", "prompt", "preprocess")

    @property
    def prompt_hash(self) -> str:
        return digest(self.prompt)

    @property
    def hash(self) -> str:
        return digest({k: getattr(self, k) for k in self.ANSWERING})

    @property
    def hosts(self) -> list[str]:
        named = self.host.split(",") if isinstance(self.host, str) else self.host
        return list(filter(None, map(str.strip, named)))


def _parsed(place: Path) -> Any:
    text = place.read_text(encoding="utf-8")
    if place.suffix == ".json":
        return json.loads(text)
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package; JSON works without it")
    return yaml.safe_load(text)


def load_config(path: str) -> Config:
    """A YAML or JSON file. `prompt` or `prompt_file` names a file, beside the configuration or in the working folder; `prompt_text` is the prompt itself. Other keys are passed over."""
    place = Path(path)
    raw = _parsed(place) or {}
    if not isinstance(raw, dict):
        raise ValueError(f"{path}: a configuration is a mapping")
    raw = expand(raw)
    given = {k: raw[k] for k in Config.__dataclass_fields__ if raw.get(k)}
    given["prompt"] = str(raw.get("prompt_text") or "")
    if named := raw.get("prompt") or raw.get("prompt_file"):
        found = next((p for p in (place.parent / named, Path(named)) if p.exists()), None)
        if found is None:
            raise FileNotFoundError(f"{path}: there is no prompt file {named}")
        given["prompt"] = found.read_text(encoding="utf-8")
    given["weights"] = {str(k): float(v) for k, v in given.get("weights", {}).items()}
    return Config(**{"name": place.stem} | given)


def split_list(value: str | None) -> list[str] | None:
    """Comma-separated names; nothing is None."""
    return [x for x in (p.strip() for p in (value or "").split(",")) if x] or None


@dataclass
class Schema:
    """What is extracted: specs in declaration order, and the JSON type of each field."""

    specs: list[FieldSpec]
    types: dict[str, str] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        declared(self.specs)

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.specs]

    def json_schema(self) -> dict[str, Any]:
        """For constrained decoding: no word about how answers are compared, so that a policy doesn't change the hash."""
        own = lambda t: {"type": "array", "items": {"type": "string"}} if t == "array" else {"type": [t, "null"]}
        return {"type": "object", "properties": {s.name: own(self.types.get(s.name, "string")) | ({"description": d} if (d := self.descriptions.get(s.name)) else {}) for s in self.specs}, "required": self.names}

    @property
    def hash(self) -> str:
        return digest(self.json_schema())

    def described(self) -> str:
        return "\n".join(f"- {s.name}: {self.descriptions.get(s.name) or self.types.get(s.name, 'string')}" for s in self.specs)


def load_schema(path: str) -> Schema:
    """A schema file (JSON or YAML) with a list `fields`; each has name, and may have type, description and the FieldSpec settings."""
    place = Path(path)
    raw = _parsed(place)
    listed = raw.get("fields") if isinstance(raw, dict) else None
    if not listed:
        raise ValueError(f"{path}: a schema has a list of fields")
    specs, types, words = [], {}, {}
    for one in map(dict, listed):
        types[one["name"]], words[one["name"]] = one.pop("type", "string"), one.pop("description", "")
        if "normalize" in one:
            one["normalize"] = tuple(one["normalize"])
        specs.append(FieldSpec(**one))
    return Schema(specs, types, words)


def render_prompt(config: Config, schema: Schema) -> str:
    """The template with {fields} and {schema} filled in; an empty template means the default one."""
    out = config.prompt or DEFAULT_PROMPT
    return out.replace("{fields}", schema.described()).replace("{schema}", json.dumps(schema.json_schema(), ensure_ascii=False, indent=2))


def scoring_policy(schema: Schema, config: Config) -> tuple[dict[str, float], list[str]]:
    """Weights of the schema under those of the configuration, and the critical fields of both, sorted."""
    weights = {s.name: s.weight for s in schema.specs} | config.weights
    return weights, sorted({s.name for s in schema.specs if s.critical} | set(config.critical_fields))
