"""Column expressions that the operators share. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import tables

# What counts as white space and as a letter of a word (Unicode, spelt out for Java and RE2).
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"
FENCE = "`" * 3


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white-space texts."""
    return F.coalesce(strip(text), F.lit("")) == ""


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def named_before(text: Column, endings: list[str]) -> Column:
    """Words in front of one of the endings."""
    return F.regexp_extract_all(text, F.lit(rf"({WORD}+)[-{SPACE}]?({'|'.join(endings)})"), F.lit(1))


def capitalised(text: Column) -> Column:
    """Words of an ASCII capital and two or more small letters."""
    return F.filter(F.split(text, rf"[^\p{{L}}\p{{N}}_]+"), lambda w: w.rlike("^[A-Z][a-z]{2,}$"))


def unfenced(raw: Column) -> Column:
    """A model's answer without code fences: the json fence, then a bare one, then the closing one."""
    text = strip(raw)
    for pattern in (rf"\A{FENCE}json", rf"\A{FENCE}", rf"{FENCE}\z"):
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or less."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs with x1, y1, x2, y2)."""
    width = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return ratio(width * height, area(a) + area(b) - width * height)


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """The table's value of a key, or the default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def stem(name: Column) -> Column:
    """A file name without its last extension; leading dots belong to the stem."""
    return F.regexp_replace(name, r"(?<=[^./])(\.[^./]*)\z", "")


def font_choice(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low == "auto (match original)", "auto").when(low == "animeace", "animeace_").when(raw.startswith("Yuki-"), raw).otherwise(low)


def font_path(name: Column) -> Column:
    return F.concat(F.lit("fonts/"), name, F.when(name.isin("animeace_", "arial", "mangat"), "i").otherwise(""), F.lit(".ttf"))


def preprocessed(text: Column) -> Column:
    return F.replace(text, F.lit("．"), F.lit("."))


def short_name(name: Column, most: int) -> Column:
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, most - 3), F.lit("...")))


def preview(text: Column, most: int = 50) -> Column:
    """The start of a text on one line."""
    return F.concat(F.replace(F.substring(text, 1, most), F.lit("\n"), F.lit(" ")), F.when(F.length(text) > most, "...").otherwise(""))


def style_line(style: Column, label: str = "Style instructions") -> Column:
    return F.when(F.coalesce(style, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"\n{label}: "), style))


def style_text(style: Column) -> Column:
    """A preset's instruction; any other text is an instruction of its own."""
    return lookup(style, tables.STYLE_PRESETS, style)


def percent(current: Column, total: Column) -> Column:
    return (current / F.greatest(total, F.lit(1)) * 100).cast("int")


def is_retryable(error: Column) -> Column:
    return error.rlike("50[234]|429")


def is_quota(error: Column) -> Column:
    return error.contains("429") | F.lower(error).contains("quota")


def ocr_delay(attempt: Column, jitter: Column) -> Column:
    """Seconds before the next attempt; jitter from 0 to 1."""
    return F.pow(F.lit(2.0), attempt + 1) * (1 + jitter)


def llm_delay(attempt: Column) -> Column:
    return 0.5 * F.pow(F.lit(2.0), attempt)


def picked_font(answer: Column) -> Column:
    """The font that a model's loose answer means.

    An exact name wins; else the first font, in order, that equals, holds or is held by the answer
    without regard to case; else the default. Known prefixes are taken off one after another.
    """
    fonts = F.array(*[F.lit(f) for f in tables.FONTS])
    pairs = F.array(*[F.struct(F.lit(f).alias("name"), F.lower(F.lit(f)).alias("low")) for f in tables.FONTS])
    cut = lambda text, prefix: F.when(F.lower(text).startswith(F.lower(prefix)), strip(F.substr(text, F.length(prefix) + 1))).otherwise(text)

    def meant(text: Column) -> Column:
        low = F.lower(text)
        loose = F.filter(pairs, lambda f: f["low"].contains(low) | low.contains(f["low"]))
        return F.when(F.array_contains(fonts, text), text).otherwise(F.coalesce(F.get(loose, F.lit(0))["name"], F.lit(tables.DEFAULT_FONT)))

    # a fold keeps the text; written out, each prefix names the text three times, which made 81 copies of it, worked out anew for each font
    return F.aggregate(F.array(*[F.lit(p) for p in tables.ANSWER_PREFIXES]), strip(F.translate(strip(answer), "\"'", "")), cut, meant)


def json_line(value: Column) -> Column:
    """A struct, map or array as JSON on one line, letters as they are."""
    return F.to_json(value)


def json_value(text: Column, kind: str) -> Column:
    """JSON read as a type; null where it is none."""
    return F.from_json(text, kind)


def progress(phase: Column, current: Column, total: Column, message: Column) -> Column:
    """A progress event as JSON."""
    return F.to_json(F.struct(phase.alias("phase"), current.alias("current"), total.alias("total"), message.alias("message"), percent(current, total).alias("percent")))
