"""Column expressions over text: stripping, tags, scores, number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwright.functions.arrays import bind

# The separator between reasoning steps, and the characters a
# Unicode-aware strip removes.
STEP_SEPARATOR = "\n\n\n\n\n"
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
# The same characters as a pattern; one property test is several times faster than their list.
WHITESPACE_RUN = r"[\x1c-\x1f\p{IsWhite_Space}]+"
# Fixed value: the score marker a critique ends with.
SCORE_PATTERN = r"(?i)\*\*SCORE:\*\*[\x1c-\x1f\p{IsWhite_Space}]*([-+]?\d*\.?\d+)"
# Named character references that replies use, by what they stand for.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&", "nbsp": " ", "copy": "©", "reg": "®",
    "trade": "™", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·",
    "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "le": "≤", "ge": "≥",
    "ne": "≠", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§",
    "rarr": "→", "larr": "←", "eacute": "é", "egrave": "è", "agrave": "à", "uuml": "ü",
    "ouml": "ö", "auml": "ä", "szlig": "ß", "ccedil": "ç", "ntilde": "ñ",
}


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (plain `trim` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Whitespace tokens; an empty or blank text has none."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, WHITESPACE_RUN)
    )


def tag_text(raw: Column, tag: str) -> Column:
    """Text of the first `<tag>`; '' when missing, to the end when unclosed."""
    # all that follows the opening tag, cut at the closing one: a lazy run up to it would try both at each character
    rest = F.regexp_extract(raw, rf"(?is)<{tag}(?:\s[^>]*)?>(.*)", 1)
    inner = F.get(F.split(rest, rf"(?i)</{tag}\s*>", 2), F.lit(0))
    # most texts hold no other tag, which a search of bytes tells
    bare = bind(inner, lambda t: F.when(F.contains(t, F.lit("<")), F.regexp_replace(t, r"</?[A-Za-z][^>]*>", "")).otherwise(t))
    return F.coalesce(bind(bare, lambda t: strip(unescape(t))), F.lit(""))


def unescape(text: Column) -> Column:
    """Character references as the characters they stand for: decimal, hexadecimal, and those of ENTITIES.

    The text is cut at every `&`, so what a reference gives is not read again.
    Others stay as they are; a number that is no character gives U+FFFD.
    """
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def numbered(code: Column) -> Column:
        known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    def character(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(
            F.substring(name, 2, 9)).try_cast("bigint")
        return F.when(name.startswith("#"), bind(code, numbered)).otherwise(F.try_element_at(names, name))

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z]+);", 1)
        return F.coalesce(
            bind(name, lambda n: F.concat(character(n), F.substr(piece, F.length(n) + 2))), F.concat(F.lit("&"), piece))

    parts = F.split(text, "&", -1)
    whole = bind(parts, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(
        F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), decoded), "")))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def parse_score(reply: Column) -> Column:
    """First `**SCORE:** number` of a critique, 0.0 when there is none."""
    return F.coalesce(
        F.regexp_extract(reply, SCORE_PATTERN, 1).try_cast("double"), F.lit(0.0)
    )


def format_score(score: Column, is_text: bool = False) -> Column:
    """A score as JSON tools print it: `1` for an integer, `0.0005`, `1e-05`.

    Spark prints doubles below 1e-3 and from 1e7 on in `1.0E-5` style; this
    gives plain digits between 1e-4 and 1e16 and a lower-case, two-digit
    exponent outside. `is_text` marks a score kept as raw JSON text, whose
    integers stay integers.
    """
    number = score.try_cast("double") if is_text else score
    plain = number.cast("string")
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    exponent = F.substring_index(plain, "E", -1)
    digits = F.replace(exponent, F.lit("-"), F.lit(""))
    scientific = F.concat(
        mantissa, F.lit("e"),
        F.when(exponent.startswith("-"), "-").otherwise("+"),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )
    positional = F.regexp_replace(plain.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    positional = F.when(positional.endswith("."), F.concat(positional, F.lit("0"))).otherwise(positional)
    size = F.abs(number)
    text = (
        F.when(~plain.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )
    if is_text:
        text = F.when(score.rlike(r"^-?[0-9]+$"), score).otherwise(text)
    return F.coalesce(text, F.lit(""))


def capitalize(word: Column) -> Column:
    """First character upper-case, the rest lower-case."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def collapse_tokens(text: Column, pad: str, image: str) -> Column:
    """Drop leading runs of the pad token and fold repeated image tokens into one."""
    def quoted(token: str) -> str:
        return "".join("\\" + c if not c.isalnum() else c for c in token)

    unpadded = F.regexp_replace(text, f"^({quoted(pad)})+", "")
    return F.regexp_replace(unpadded, f"({quoted(image)})+", image.replace("\\", "\\\\").replace("$", "\\$"))
