"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

DEFAULT_DIM = 1024
DEFAULT_MODEL = "bge-m3"


@dataclass(frozen=True)
class Config:
    source: str = ""
    index: str = ""
    lexical_index: bool = True
    embed_url: str = "http://localhost:11434"
    embed_model: str = DEFAULT_MODEL
    embed_dim: int = DEFAULT_DIM
    embed_cache: str = ""


def load(env: Mapping[str, str] | None = None, prefix: str = "MEMORY_") -> Config:
    """Variables <prefix>SOURCE, INDEX, LEXICAL, EMBED_URL, EMBED_MODEL, EMBED_DIM and EMBED_CACHE; empty ones count as unset.

    The dimension must be a positive whole number.
    """
    env = os.environ if env is None else env
    get = lambda name, default: env.get(prefix + name) or default
    dim = get("EMBED_DIM", str(DEFAULT_DIM))
    if not dim.lstrip("-").isdigit() or int(dim) <= 0:
        raise ValueError(f"{prefix}EMBED_DIM must be a positive whole number, not {dim!r}")
    return Config(
        source=get("SOURCE", ""), index=get("INDEX", ""), lexical_index=get("LEXICAL", "1").lower() not in ("0", "false", "no"),
        embed_url=get("EMBED_URL", Config.embed_url), embed_model=get("EMBED_MODEL", DEFAULT_MODEL), embed_dim=int(dim), embed_cache=get("EMBED_CACHE", ""),
    )
