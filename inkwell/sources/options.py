"""A job's options from form values, with the defaults of missing and unknown ones."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from inkwell.functions import tables


@dataclass(frozen=True)
class JobOptions:
    translator: str
    source: str
    target: str
    style: str
    font: str
    ocr: str
    context_memory: bool
    black_bubbles: bool
    split_long: bool
    server: str
    model: str
    api_key: str

    @classmethod
    def of(cls, form: Mapping[str, str]) -> JobOptions:
        get = form.get
        chosen, font = get("selected_translator", ""), get("selected_font", "")
        low = font.lower()
        return cls(
            translator=tables.TRANSLATORS.get(chosen, chosen.lower()),
            source=tables.SOURCES.get(get("selected_source_lang", "").lower(), "ja"),
            target=tables.TARGETS.get(get("selected_language", "").lower(), tables.DEFAULT_TARGET),
            style=get("custom_prompt", "").strip() or tables.STYLES.get(get("selected_style", "Default").lower(), ""),
            font={"auto (match original)": "auto", "animeace": "animeace_"}.get(low, font if font.startswith("Yuki-") else low),
            ocr=get("selected_ocr", tables.DEFAULT_OCR).lower(),
            context_memory=get("context_memory") == "on",
            black_bubbles=get("detect_black_bubbles") == "on",
            split_long=get("split_long_images") == "on",
            server=get("copilot_server", tables.DEFAULT_SERVER),
            model=get("copilot_model_input", tables.DEFAULT_MODEL),
            api_key=get("gemini_api_key", "").strip(),
        )


@dataclass(frozen=True)
class Settings:
    """What the environment sets for all jobs."""

    secret_key: str
    verbose: bool
    api_key: str

    @classmethod
    def of(cls, environment: Mapping[str, str]) -> Settings:
        get = environment.get
        return cls(secret_key=get("SECRET_KEY", ""), verbose=get("VERBOSE_LOG", "").lower() in ("1", "true", "on", "yes"), api_key=get("GEMINI_API_KEY", ""))

    def key_for(self, options: JobOptions) -> str:
        """The key of a job, else that of the environment."""
        return options.api_key or self.api_key
