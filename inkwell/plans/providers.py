"""Recognisers, detectors and translators by name. The shipped ones are deterministic stubs that need no network.

A provider is made once in each Python worker and kept there (`cached`).
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd

from inkwell.functions import tables


class Translator(Protocol):
    def translate_single(self, text: str) -> str: ...

    def translate_batch(self, texts: list[str]) -> list[str]: ...


class PageTranslator(Translator, Protocol):
    """A translator that takes pages in a row, with the context of those before."""

    def translate_pages_batch(self, pages: dict[str, list[str]], context: str) -> dict[str, list[str]]: ...


class Detector(Protocol):
    """Boxes (x1, y1, x2, y2, confidence, class) in a picture with three bytes a pixel."""

    def __call__(self, height: int, width: int, data: bytes) -> list[tuple[float, float, float, float, float, int]]: ...


class FontMatcher(Protocol):
    """The loose answer of a model that is shown a picture and the names of fonts."""

    def match(self, height: int, width: int, data: bytes, prompt: str) -> str: ...


class BlockReader(Protocol):
    """Text blocks (text, x1, y1, x2, y2) of a picture."""

    def blocks(self, height: int, width: int, data: bytes) -> list[tuple[str, float, float, float, float]]: ...


class FontSource(Protocol):
    """A font of a size; `path` may be missing, then `default` is taken."""

    def load(self, path: str, size: int) -> Any: ...

    def default(self, size: int) -> Any: ...


class Service(Protocol):
    """A server of models: their names, and whether it answers."""

    def models(self) -> list[str]: ...

    def probe(self) -> bool: ...


Recogniser = Callable[[int, int, bytes], str]

_kept: dict = {}


def cached(key: object, make: Callable[[], Any]) -> Any:
    """What `make` gave for this key in this worker."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def clear_cache() -> None:
    _kept.clear()


def font(source: FontSource, path: str, size: int) -> Any:
    """A font by path and size, kept; the default one if it cannot be loaded."""

    def load():
        try:
            return source.load(path, size)
        except Exception:  # a missing or broken file
            return source.default(size)

    return cached(("font", type(source), path, size), load)


def model_names(service: Service, known: Iterable[str]) -> list[str]:
    """The models that a server offers, or the known ones if it does not answer."""
    try:
        return service.models() or list(known)
    except Exception:  # no server
        return list(known)


def answers(service: Service) -> bool:
    try:
        return bool(service.probe())
    except Exception:  # no server
        return False


def read_text(engine: Recogniser, crop: tuple[int, int, bytes], tries: int = 5, sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] = random.random) -> tuple[str, str | None]:
    """(text, error) of one picture: server errors are tried again after doubling waits with as much jitter, others not.

    The first call waits a little, at random, so that many do not start at once.
    """
    error = None
    for attempt in range(tries):
        if attempt == 0:
            sleep(0.1 + 0.4 * chance())
        try:
            return engine(*crop), None
        except Exception as failed:  # an engine may fail in any way
            error = str(failed) or type(failed).__name__
            if not any(code in error for code in ("502", "503", "504", "429")):
                break
            if attempt + 1 < tries:
                sleep(2 ** (attempt + 1) * (1 + chance()))
    return "", error


def read_texts(engine: Recogniser, crops: list[tuple[int, int, bytes]], at_once: int = 10, **how) -> list[tuple[str, str | None]]:
    """(text, error) of pictures in order: by the engine's own `process_batch` if it has one, else at most `at_once` calls at a time."""
    if not crops:
        return []
    batch = getattr(engine, "process_batch", None)
    if batch:
        try:
            got = list(batch(crops))
            if len(got) == len(crops):
                return [(t or "", None) for t in got]
        except Exception:  # one by one then
            pass
    with ThreadPoolExecutor(min(at_once, len(crops))) as pool:
        return list(pool.map(lambda crop: read_text(engine, crop, **how), crops))


class StubTranslator:
    """Puts texts in brackets with the target language; texts that hold a word of `fails` raise its error."""

    def __init__(self, target: str = "en", fails: dict[str, str] | None = None):
        self.target, self.fails = target, fails or {}

    def translate_single(self, text: str) -> str:
        for word, error in self.fails.items():
            if word in text:
                raise RuntimeError(error)
        return f"[{self.target}] {text}"

    def translate_batch(self, texts: list[str]) -> list[str]:
        return [self.translate_single(t) for t in texts]

    def translate_pages_batch(self, pages: dict[str, list[str]], context: str) -> dict[str, list[str]]:
        return {name: self.translate_batch(texts) for name, texts in pages.items()}


METHODS = ("google", "hf", "baidu", "bing", "nllb", "gemini", "copilot")
_registry: dict[str, Callable[[str], Translator]] = {m: StubTranslator for m in METHODS}


def register(method: str, make: Callable[[str], Translator]) -> None:
    _registry[method] = make


def translator(method: str, target: str = "en") -> Translator:
    if method not in _registry:
        raise ValueError("Invalid translation method.")
    return _registry[method](target)


def language(code: str, default: str) -> str:
    return tables.LANGUAGE_NAMES.get(code, default)


def _request(task: str, source: str, target: str, style: str, context: str, answer: str, body: str) -> str:
    style = tables.STYLE_PRESETS.get(style, style)
    lines = [context + f"{task} from {language(source, 'Japanese')} to {language(target, 'English')}.", answer]
    return "\n".join(lines) + (f"\nStyle instructions: {style}" if style else "") + "\n" + body


def prompt(texts: Iterable[str], source: str, target: str, style: str = "", context: str = "") -> str:
    """The request for one batch, in our wording."""
    return _request("Translate the texts below", source, target, style, context, "Answer with a JSON array of the same length and order.", json.dumps(list(texts), ensure_ascii=False))


def single_prompt(text: str, source: str, target: str, style: str = "") -> str:
    return _request("Translate the text below", source, target, style, "", "Answer with the translation alone.", text)


def pages_prompt(pages: Mapping[str, list[str]], source: str, target: str, style: str = "", context: str = "") -> str:
    """The request for pages in a row: a JSON object of arrays by page, indented by two."""
    answer = "The pages follow each other in one story: keep names and voices alike. Answer with a JSON object of the same pages, each with an array of the same length and order."
    return _request("Translate the texts of the pages below", source, target, style, context, answer, json.dumps(dict(pages), ensure_ascii=False, indent=2))


def extraction_prompt() -> str:
    """The request for the terms of a batch, in the form that `terms.extracted` reads."""
    return "After the translation, list new names and terms, one a line, between these marks:\n[TERMS]\noriginal → translation\n[/TERMS]\nLeave the list empty if there are none."


def font_prompt(fonts: Iterable[str] = tables.FONTS) -> str:
    """The request for the font that is most like the lettering of a picture."""
    return "Which of these fonts is most like the lettering in the picture? Answer with its name alone.\n" + "\n".join(f"- {f}" for f in fonts)


def with_ladder(service: Translator, texts: list[str], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> list[tuple[str, str]]:
    """(translation, status) of each text: a whole batch, `tries` times with doubling waits, then one by one, then the text itself.

    An answer of another length counts as a failure; a spent quota returns the texts at once. Blank texts stay as they are.
    """
    out: list[tuple[str, str]] = [(t, "blank") for t in texts]
    asked = [i for i, t in enumerate(texts) if t and t.strip()]
    if not asked:
        return out
    for attempt in range(tries):
        try:
            got = service.translate_batch([texts[i] for i in asked])
            if len(got) == len(asked):
                for i, t in zip(asked, got):
                    out[i] = (t, "batch")
                return out
        except Exception as error:  # a provider may fail in any way; the ladder is what handles it
            if "429" in str(error) or "quota" in str(error).lower():
                for i in asked:
                    out[i] = (texts[i], "quota")
                return out
        if attempt + 1 < tries:
            sleep(0.5 * 2**attempt)
    for i in asked:
        try:
            out[i] = (service.translate_single(texts[i]), "single")
        except Exception:
            out[i] = (texts[i], "source")
    return out


def translate_groups(method: str, target: str, tries: int = 3, wait: bool = True):
    """A function for applyInPandas: one batch of bubbles (batch, page, bubble, text) to its translations with status."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["page", "bubble"])
        sleep = time.sleep if wait else (lambda _: None)
        got = with_ladder(translator(method, target), [t if isinstance(t, str) else "" for t in frame["text"]], tries, sleep)
        return frame.assign(translated=[g[0] for g in got], status=[g[1] for g in got])[["batch", "page", "bubble", "text", "translated", "status"]]

    return run


def with_page_ladder(service: Translator, pages: dict[str, list[str]], context: str = "", tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict[str, list[tuple[str, str]]]:
    """(translation, status) of each text of pages in a row: all pages in one call, else each page, which has its own ladder.

    A page that the answer leaves out keeps its own texts; one of another length is filled from its tail or cut.
    """
    whole = getattr(service, "translate_pages_batch", None)
    if whole and any(t and t.strip() for texts in pages.values() for t in texts):
        try:
            got = whole(pages, context)
            if not isinstance(got, dict):
                raise TypeError("no object of pages")
            out = {}
            for name, texts in pages.items():
                answer = got.get(name)
                if answer is None:
                    out[name] = [(t, "fallback") for t in texts]
                else:
                    out[name] = [(answer[i], "pages") if i < len(answer) else (t, "padded") for i, t in enumerate(texts)]
            return out
        except Exception:  # page by page then
            pass
    return {name: with_ladder(service, texts, tries, sleep) for name, texts in pages.items()}


def translate_page_groups(method: str, target: str, tries: int = 3, wait: bool = True):
    """A function for applyInPandas: one batch of pages (batch, page, bubble, text, prompt) to its translations with status."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["page", "bubble"])
        texts = [t if isinstance(t, str) else "" for t in frame["text"]]
        pages: dict[str, list[str]] = {}
        for page, text in zip(frame["page"], texts):
            pages.setdefault(str(page), []).append(text)
        context = frame["prompt"].iloc[0]
        service = cached((method, target), lambda: translator(method, target))
        got = with_page_ladder(service, pages, context if isinstance(context, str) else "", tries, time.sleep if wait else (lambda _: None))
        flat = [pair for name in pages for pair in got[name]]
        return frame.assign(translated=[g[0] for g in flat], status=[g[1] for g in flat])[["batch", "page", "bubble", "text", "translated", "status"]]

    return run
