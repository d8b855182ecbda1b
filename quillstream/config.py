"""Thresholds and weights of the document pipeline (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Layout:
    line_min: float = 25.0
    line_flat: float = 1.0
    rect_flat: float = 1.2
    table_area: float = 15_000.0
    table_horizontal: int = 6
    table_vertical: int = 4
    table_gaps: tuple = (12.0, 24.0)
    figure_area: float = 8_000.0
    figure_gap: float = 10.0
    row_gap: float = 2.5
    word_gap: float = 22.0
    bold_share: float = 0.6
    bold_next: float = 6.0
    bold_shift: float = 24.0
    hinge_reach: float = 55.0
    page_bottom: float = 120.0
    page_top: float = 250.0


@dataclass(frozen=True)
class Text:
    frequent_share: float = 0.60
    most_drop: int = 5


@dataclass(frozen=True)
class Scores:
    chapter: float = 3.0
    hinge: float = 5.0
    text: float = 1.0
    least: float = 2.0
    share: float = 0.80
    short: int = 4


LAYOUT, TEXT, SCORES = Layout(), Text(), Scores()
UNCLASSIFIED = ("Sin clasificar", "SIN_CLASIFICAR")
#: Artifact names that may be fetched.
ARTIFACTS = ("preguntas.json", "preguntas.txt", "chapters_hinges.json", "preguntas_clasificadas.json", "preguntas_clasificadas_detalle.json", "outputs_png.zip", "texto_total.txt")

#: Content types of uploads.
UPLOAD_TYPES = ("application/pdf", "application/x-pdf", "application/acrobat", "applications/vnd.pdf", "text/pdf", "text/x-pdf")


@dataclass(frozen=True)
class Settings:
    """Service settings; from_env() reads them from QUILLSTREAM_<NAME>."""

    data_dir: str = "data/jobs"
    api_keys: str = "change-this-key"
    max_pdf_mb: int = 50
    job_ttl_days: int = 7
    log_level: str = "INFO"
    cors_origins: str = ""
    cors_allow_all: bool = False

    @classmethod
    def from_env(cls, env: dict | None = None) -> Settings:
        import os

        env = os.environ if env is None else env
        given = {f.name: env[f"QUILLSTREAM_{f.name.upper()}"] for f in fields(cls) if f"QUILLSTREAM_{f.name.upper()}" in env}
        kinds = {"int": int, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on"), "str": str}
        return cls(**{k: kinds[cls.__dataclass_fields__[k].type](v) for k, v in given.items()})

    @property
    def max_pdf_bytes(self) -> int:
        return self.max_pdf_mb << 20

    @property
    def api_key_set(self) -> set[str]:
        return listed(self.api_keys)

    @property
    def cors_origin_list(self) -> list[str]:
        return sorted(listed(self.cors_origins))


def listed(text: str) -> set[str]:
    """The trimmed, non-empty items of a comma-separated list."""
    return {x.strip() for x in text.split(",")} - {""}
