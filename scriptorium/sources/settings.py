"""Settings and prompts, on the driver: environment before YAML before defaults."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, fields, replace
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    chunk_size_tokens: int = 800
    chunk_overlap_tokens: int = 120
    min_paragraph_chars: int = 40
    keep_tables_as_blocks: bool = True
    include_image_captions: bool = False
    llm_model_name: str | None = None


@dataclass(frozen=True)
class Store:
    """Where the vector collection lies, and whether answers are shown with their scores."""

    path: str = "collections"
    collection: str = "rules"
    dim: int = 64
    debug: bool = False

    @property
    def location(self) -> str:
        return f"{self.path.rstrip('/')}/{self.collection}"


def store(environment: dict | None = None) -> Store:
    """``VECTOR_STORE_PATH``, ``VECTOR_STORE_COLLECTION``, ``VECTOR_STORE_DIM`` and ``DEBUG_LOG`` of the environment; empty ones count as missing."""
    environment = os.environ if environment is None else environment
    given = {name: environment.get(f"VECTOR_STORE_{name.upper()}", "") for name in ("path", "collection", "dim")}
    values = {name: int(x) if name == "dim" else x for name, x in given.items() if x}
    return Store(**values, debug=truthy(environment.get("DEBUG_LOG", "")))


def truthy(value: object) -> bool:
    return str(value).strip().lower() not in ("", "0", "false", "no")


def _upward(path: str | Path) -> Path | None:
    path = Path(path)
    if path.is_absolute():
        return path if path.exists() else None
    return next((p / path for p in (Path.cwd(), *Path.cwd().parents) if (p / path).exists()), None)


def _yaml(path: Path) -> dict:
    import yaml

    data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    return data if isinstance(data, dict) else {}


def load(path: str | Path | None = None, environment: dict | None = None) -> Settings:
    """Settings of a YAML file's ``ingest`` block, or of the whole file; ``INGEST_<NAME>`` variables come first."""
    environment = os.environ if environment is None else environment
    values: dict = {}
    if path is not None:
        if (found := _upward(path)) is None:
            warnings.warn(f"{path} is missing: defaults are used", stacklevel=2)
        else:
            data = _yaml(found)
            values = dict(data["ingest"]) if isinstance(data.get("ingest"), dict) else dict(data)
            model = data.get("llm", {}).get("model_name") if isinstance(data.get("llm"), dict) else None
            values.setdefault("llm_model_name", model)
    known = {f.name: f.type for f in fields(Settings)}
    for name in known:
        if (given := environment.get(f"INGEST_{name.upper()}")) is not None:
            values[name] = given
    typed = {}
    for name, value in values.items():
        if name in known and value is not None:
            kind = known[name].split(" ")[0]
            typed[name] = int(value) if kind == "int" else truthy(value) if kind == "bool" else str(value)
    return replace(Settings(), **typed)


@lru_cache(maxsize=8)
def _prompts(path: str) -> dict:
    return _yaml(Path(path)) if Path(path).exists() else {}


def system_prompt(path: str | None, fallback: str) -> str:
    data = _prompts(str(path)) if path else {}
    inner = data.get("prompts")
    return str(data["system_prompt"]) if "system_prompt" in data else str(inner["system"]) if isinstance(inner, dict) and "system" in inner else fallback


# Fixed value: what a judge is asked where no file says otherwise; doubled braces are single ones.
EVAL_PROMPT = (
    "Оцени качество ответа по шкале 0-1.\nВопрос: {question}\nЭталонный ответ: {expected_answer}\nОтвет: {predicted_answer}\n"
    'Ответь JSON: {{"score": <float>, "reasoning": "..."}}'
)


def eval_prompt(path: str | None, fallback: str = EVAL_PROMPT) -> str:
    data = _prompts(str(path)) if path else {}
    return str(data.get("eval_prompt", fallback))


def filled(template: str, **values: str) -> str:
    """A template with its ``{name}`` places filled; other braces stay."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template
