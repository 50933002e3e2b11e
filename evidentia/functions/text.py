"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript's \s knows it (fixed value).
SPACE = "[\\s\\x0B\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Single-character repairs of recognised text (fixed values): quotes, dashes, brackets, bars, bullets, ordinals.
NOISE_FROM = "“”‘’`´–—[]{}|¦•·º°"
NOISE_TO = "\"\"''''--1111II..oo"


def _accents() -> tuple[str, str]:
    """Letters that decompose into one character and marks, and that character; marks themselves go."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        d = [x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F]
        if len(d) == 1 and d[0] != c:
            pairs.append((c, d[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(text(x), SPACE, " "))


def strip_accents(x: Column) -> Column:
    a, b = _accents()
    return F.translate(text(x), a, b)


def normalize_noise(x: Column) -> Column:
    return normalize_whitespace(F.translate(text(x), NOISE_FROM, NOISE_TO))


def searchable(x: Column) -> Column:
    """Noise and accents repaired, lower case, and one space for all between letters and digits: one pass of translate, one of a pattern."""
    a, b = _accents()
    repaired = F.lower(F.translate(text(x), NOISE_FROM + a, NOISE_TO + b))
    return F.trim(F.regexp_replace(repaired, "[^a-z0-9]+", " "))


def upper_searchable(x: Column) -> Column:
    return F.upper(searchable(x))


def normalized_lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(text(x), "\r?\n", -1), normalize_noise), lambda s: s != "")


def search_tokens(x: Column) -> Column:
    return F.array_remove(F.split(searchable(x), " ", -1), "")


def digits_only(x: Column) -> Column:
    return F.regexp_replace(text(x), "[^0-9]+", "")


def truncate_text(x: Column, n: int = 240) -> Column:
    t = normalize_noise(x)
    return F.when(F.length(t) > n, F.concat(F.trim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def business_key(x: Column) -> Column:
    """Digits, or the trimmed original without any."""
    return F.coalesce(F.nullif(digits_only(x), F.lit("")), F.trim(text(x)))


def unit_confidence(x: Column, fallback: float = 0.0) -> Column:
    """Confidence as 0..1: over 1 it is per cent; not a number or null gives the fallback."""
    v = x.cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v)))).otherwise(F.lit(fallback))


def file_stem(x: Column, default: str = "image") -> Column:
    s = F.regexp_replace(F.regexp_replace(text(x), r"[\\/]+", "__"), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def segment(x: Column, fallback: str) -> Column:
    s = F.regexp_replace(F.regexp_replace(text(x), "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def phone_digits(x: Column) -> Column:
    return F.nullif(F.regexp_extract(text(x), r"^(\d+)(?:@|$)", 1), F.lit(""))


def command(x: Column, prefix: str) -> Column:
    """(name, args) of a text that starts with the prefix, whatever its case; name 'help' without any; else null."""
    t = F.trim(text(x))
    rest = F.array_remove(F.split(F.trim(F.substring(t, len(prefix) + 1, 1 << 30)), "\\s+"), "")
    found = F.struct(F.coalesce(F.lower(F.get(rest, F.lit(0))), F.lit("help")).alias("name"), F.slice(rest, 2, 1 << 30).alias("args"))
    return F.when(F.startswith(F.lower(t), F.lit(prefix.lower())), found)


def expected_key(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text(x)), r"^(\d{7})(?:\.[a-z0-9]+)?$", 1), F.lit(""))


def statistics(x: Column) -> Column:
    """Lines, words and characters that aren't white space, and a preview of 320 characters."""
    t = text(x)
    words = F.array_remove(F.split(F.trim(F.regexp_replace(t, "\\s+", " ")), " "), "")
    lines = F.filter(F.split(t, "\r?\n", -1), lambda s: F.trim(s) != "")
    return F.struct(F.size(lines).alias("lines"), F.size(words).alias("words"), F.length(F.regexp_replace(t, "\\s", "")).alias("chars"), F.substring(t, 1, 320).alias("preview"))


# Extensions of media types, and types of extensions.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/bmp": ".bmp", "image/tiff": ".tiff"}
MEDIA_EXTENSIONS = {"image/png": ".png", "image/webp": ".webp", "image/heic": ".heic", "image/heif": ".heif"}
MEDIA_TYPES = {".png": "image/png", ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heif"}
PROVIDER_TYPES = {".png": "image/png", ".webp": "image/webp", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff"}


def _of(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def some(x: Column) -> Column:
    """The trimmed text, null if there is none."""
    return F.nullif(F.trim(text(x)), F.lit(""))


def base_name(x: Column) -> Column:
    return F.regexp_extract(text(x), r"([^/]*)/*$", 1)


def extension(x: Column) -> Column:
    """Of a path's last part, from its last dot, in lower case; '' for none, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(x), r"[^.].*?(\.[^.]*)$", 1))


def guess_extension(source: Column, original: Column, media_type: Column) -> Column:
    """The first of the original name's, the source's and the type's; '.jpg' without any."""
    return F.coalesce(some(extension(original)), some(extension(source)), _of(EXTENSIONS, F.lower(text(media_type))), F.lit(".jpg"))


def guess_media_type(path: Column, types: dict[str, str] = MEDIA_TYPES) -> Column:
    return F.coalesce(_of(types, extension(path)), F.lit("image/jpeg"))


def media_file_name(media_type: Column, original: Column, message_id: Column, now: Column) -> Column:
    """The original name, else the message's (or the time's) with the type's extension."""
    stem = F.coalesce(F.nullif(F.regexp_replace(F.trim(text(message_id)), "[^a-zA-Z0-9_-]+", "_"), F.lit("")), now.cast("string"))
    end = F.coalesce(_of(MEDIA_EXTENSIONS, F.lower(F.trim(text(media_type)))), F.lit(".jpg"))
    return F.coalesce(some(base_name(original)), F.concat(stem, end))


def is_group(chat: Column) -> Column:
    return F.endswith(F.trim(text(chat)), F.lit("@g.us"))


def is_image_type(media_type: Column) -> Column:
    return F.startswith(F.lower(F.trim(text(media_type))), F.lit("image/"))


def strip_fences(x: Column) -> Column:
    """A reply without the fences around its JSON."""
    out = F.regexp_replace(text(x), r"^(?i)```json\s*", "")
    out = F.regexp_replace(out, r"^```\s*", "")
    return F.trim(F.regexp_replace(out, r"\s*```$", ""))


def output_text(direct: Column, fragments: Column) -> Column:
    """The direct text, else the non-empty fragments (arrays of texts by output), one a line."""
    each = F.filter(F.transform(F.flatten(fragments), lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(some(direct), F.trim(F.array_join(each, "\n")), F.lit(""))


def url_path(x: Column) -> Column:
    """Segments percent-encoded; what form encoding does differently is set right."""
    def coded(segment: Column) -> Column:
        out = F.url_encode(segment)
        for form, code in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            out = F.replace(out, F.lit(form), F.lit(code))
        return out

    return F.array_join(F.transform(F.split(text(x), "/", -1), coded), "/")


def source_label(name: Column, source: Column, group: Column) -> Column:
    """source[:group]; 'whatsapp' without any."""
    first = F.trim(F.coalesce(F.nullif(text(name), F.lit("")), F.nullif(text(source), F.lit("")), F.lit("whatsapp")))
    return F.concat(first, F.coalesce(F.concat(F.lit(":"), some(group)), F.lit("")))


def class_name(x: Column) -> Column:
    return F.coalesce(some(F.lower(text(x))), F.lit("invalid"))


def correlation_id(request: Column, fallback: Column, job: Column) -> Column:
    return F.coalesce(some(request), F.nullif(fallback, F.lit("")), job)


def sender(contact: Column, push: Column, number: Column, chat: Column) -> Column:
    """The contact's name, the name pushed, the number, or the id."""
    return F.coalesce(some(contact), some(push), some(number), some(chat))


def message_text(body: Column, caption: Column, raw: Column) -> Column:
    return F.coalesce(some(body), some(caption), some(raw), F.lit(""))


def state_key(job: Column, prefix: str = "receipt-state") -> Column:
    return F.concat(F.lit(prefix + ":"), job)


def job_path(folder: str, status: Column, job: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), status, F.lit("/"), job, F.lit(".json"))


def public_url(base: Column, key: Column) -> Column:
    """null without a base."""
    return F.concat(F.regexp_replace(some(base), "/+$", ""), F.lit("/"), key)


def asset_key(company: Column, kind: Column, stored: Column, source: Column, asset: Column, ending: Column) -> Column:
    """company/type/yyyy/MM/dd/source-asset.ext"""
    return F.concat_ws("/", company, kind, F.date_format(stored, "yyyy/MM/dd"), F.concat(source, F.lit("-"), asset, ending))


def expected_digits(lengths: tuple[int, ...]) -> str:
    """Pattern of the digit groups of some lengths."""
    return "(?:" + "|".join(f"[0-9]{{{n}}}" for n in lengths) + ")"


def digit_groups(texts: list[Column], lengths: tuple[int, ...] = (7,)) -> Column:
    """Distinct digit groups of expected lengths in some texts, in order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text(x), F.lit("([0-9]+)"), F.lit(1)) for x in texts]))
    return F.array_distinct(F.filter(found, lambda d: F.length(d).isin(*lengths)))
