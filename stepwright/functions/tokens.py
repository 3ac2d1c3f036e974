"""Column expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwright.functions.arrays import bind
from stepwright.functions.text import WHITESPACE_RUN, strip


def tail(tokens: Column, n: int, protected: list[str] | None = None) -> Column:
    """The last `n` tokens; protected tokens stay and the tail fills the rest."""
    if not protected:
        kept = F.least(F.size(tokens), F.lit(n))
        return F.slice(tokens, F.size(tokens) - kept + 1, kept)

    def is_protected(token: Column) -> Column:
        return token.isin(protected)

    free = F.filter(F.transform(tokens, lambda t, i: F.when(~is_protected(t), i)),
                    lambda i: i.isNotNull())

    def first_kept(positions: Column) -> Column:
        room = F.lit(n) - (F.size(tokens) - F.size(positions))
        at = F.size(positions) - F.greatest(room, F.lit(0))
        return F.coalesce(F.get(positions, F.greatest(at, F.lit(0))), F.size(tokens))

    return bind(bind(free, first_kept), lambda cut: F.filter(
        tokens, lambda t, i: is_protected(t) | (i >= cut)))


def eos_length(tokens: Column, eos: Column) -> Column:
    """Tokens up to and with the first end token; all of them when there is none."""
    at = F.array_position(tokens, eos)
    return F.when(at > 0, at.cast("int")).otherwise(F.size(tokens))


def eos_mask(tokens: Column, eos: Column) -> Column:
    """1 up to and with the first end token, 0 after it."""
    kept = eos_length(tokens, eos)
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.size(tokens) - kept))


def mask_truncated(mask: Column, tokens: Column, eos: Column) -> Column:
    """The mask, all zero for a sequence that never reached its end token."""
    return F.when(F.array_contains(tokens, eos), mask).otherwise(
        F.array_repeat(F.lit(0), F.size(tokens)))


# Searches run on framed text: a space before, between and behind the tokens,
# which themselves hold none. One substring search then finds a token sequence.

def framed(tokens: Column) -> Column:
    """A token array as framed text; token ids work as well."""
    return F.concat(F.lit(" "), F.array_join(tokens.cast("array<string>"), " "), F.lit(" "))


def framed_text(text: Column) -> Column:
    """The whitespace tokens of a text as framed text."""
    return F.concat(F.lit(" "), F.regexp_replace(strip(text), WHITESPACE_RUN, " "), F.lit(" "))


def framed_size(frame: Column) -> Column:
    """Number of tokens in framed text."""
    gaps = F.length(frame) - F.length(F.replace(frame, F.lit(" "), F.lit("")))
    return F.when(F.length(frame) == 2, 0).otherwise(gaps - 1)


def find_framed(frame: Column, needle: Column) -> Column:
    """First 0-based position of one framed token sequence in another; 0 if empty, -1 if absent."""
    def position(at: Column) -> Column:
        before = F.substring(frame, F.lit(1), at)
        return F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1

    found = bind(F.instr(frame, needle), lambda at: F.when(at == 0, -1).otherwise(position(at)))
    return F.when(F.length(needle) == 2, 0).otherwise(found)


def find_tokens(haystack: Column, needle: Column) -> Column:
    """The same for token arrays."""
    return find_framed(framed(haystack), framed(needle))
