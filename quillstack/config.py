"""Settings and the fixed weights of ranking."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

# Ranking weights by section and by journal quartile.
SECTION_WEIGHTS = {"results": 1.0, "conclusion": 1.0, "table": 0.9, "methods": 0.85, "unknown": 0.85, "abstract": 0.75, "background": 0.7, "discussion": 0.65, "introduction": 0.5, "preamble": 0.3, "appendix": 0.3, "references": 0.1}
QUARTILE_WEIGHTS = {"Q1": 1.0, "Q2": 0.85, "Q3": 0.65, "Q4": 0.45}
NO_QUARTILE = 0.7
OTHER_SECTION = 0.7
CHUNK_TYPES = ("text", "table", "figure")
CONFIDENCE_TOC, CONFIDENCE_SCHEME, CONFIDENCE_FALLBACK = 1.0, 0.7, 0.5
CHARS_PER_TOKEN = 4
SECRETS = {"embedding_api_key": "QUILLSTACK_EMBEDDING_KEY", "vision_api_key": "QUILLSTACK_VISION_KEY", "contact_email": "QUILLSTACK_CONTACT"}


@dataclass(frozen=True)
class Settings:
    """What a file may set; unknown names are ignored, absent ones take these defaults."""

    library_path: str = ""
    index_path: str = ""
    embedding_provider: str = "hashed"
    embedding_model: str = "hashed-words"
    embedding_dimensions: int = 96
    embedding_api_key: str | None = None
    chunk_size: int = 400
    chunk_overlap: int = 100
    rerank_enabled: bool = True
    rerank_alpha: float = 0.7
    section_weights: dict = field(default_factory=dict)
    journal_weights: dict = field(default_factory=dict)
    oversample_multiplier: int = 3
    topic_oversample_factor: int = 5
    stats_sample_limit: int = 10_000
    vision_enabled: bool = True
    vision_model: str = "offline"
    vision_api_key: str | None = None
    contact_email: str | None = None

    def problems(self) -> list[str]:
        """Everything wrong with the settings, in words."""
        found = []
        if self.chunk_size < 1:
            found.append("chunk_size must be at least 1")
        if not 0 <= self.chunk_overlap < max(self.chunk_size, 1):
            found.append("chunk_overlap must be at least 0 and less than chunk_size")
        if not 0 <= self.rerank_alpha <= 1:
            found.append("rerank_alpha must be from 0 to 1")
        if self.embedding_dimensions < 1:
            found.append("embedding_dimensions must be at least 1")
        if self.oversample_multiplier < 1 or self.topic_oversample_factor < 1:
            found.append("oversampling factors must be at least 1")
        return found

    def fingerprint(self) -> str:
        """Changes when a setting changes that shapes the index."""
        parts = (self.chunk_size, self.chunk_overlap, self.embedding_provider, self.embedding_model, self.embedding_dimensions, self.vision_enabled)
        return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16]


def load(path: str | None = None) -> Settings:
    """Settings from a JSON file over the defaults; secrets that are absent come from the environment."""
    given = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    names = {f.name for f in fields(Settings)}
    chosen = {k: v for k, v in given.items() if k in names}
    for name, variable in SECRETS.items():
        if not chosen.get(name) and os.environ.get(variable):
            chosen[name] = os.environ[variable]
    settings = Settings(**chosen)
    if settings.problems():
        raise ValueError("; ".join(settings.problems()))
    return settings


def check_search(chunk_types: list[str] | None = None, section_weights: dict | None = None, journal_weights: dict | None = None) -> None:
    """Reject unknown chunk types and weight names and weights that are no numbers, naming each."""
    wrong = [f"unknown chunk type {t!r}" for t in chunk_types or [] if t not in CHUNK_TYPES]
    for given, known, what in ((section_weights, {*SECTION_WEIGHTS, "figure"}, "section"), (journal_weights, {*QUARTILE_WEIGHTS, "unknown"}, "quartile")):
        for name, weight in (given or {}).items():
            if name not in known:
                wrong.append(f"unknown {what} {name!r}")
            if isinstance(weight, bool) or not isinstance(weight, (int, float)):
                wrong.append(f"the weight of {what} {name!r} is no number")
    if wrong:
        raise ValueError("; ".join(wrong))
