"""Fixed-length integer rows from text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
PAD_ID = 0
# Tokens that one match of the pattern for the start of a text takes; the start of more is taken in steps.
STEP = 256


def join_tokens(column: Column, is_list: bool) -> Column:
    """Token list as one string with single spaces; plain strings pass through."""
    return F.array_join(column, " ") if is_list else column


def first_tokens(text: Column, most: int) -> Column:
    """The first ``most`` tokens of a text; what follows them is not looked at.

    An anchored match takes the start that holds them, in steps, as a single long repetition would be deep.
    """

    def start(rest: Column, number: int) -> Column:
        return F.regexp_extract(rest, rf"^(?:\s*+(?:[A-Za-z0-9_]++|[^A-Za-z0-9_\s])){{0,{number}}}+", 0)

    if most <= STEP:
        head = start(text, most)
    else:
        steps = F.sequence(F.lit(1), F.lit(-(-most // STEP)))
        longer = lambda done, _: F.concat(done, start(F.substring(text, F.char_length(done) + 1, F.lit((1 << 31) - 1)), STEP))
        head = F.aggregate(steps, F.lit(""), longer)
    return F.slice(F.regexp_extract_all(head, F.lit(TOKEN_PATTERN), F.lit(0)), 1, most)


def token_ids(text: Column, max_length: int, vocab: int = 1000) -> Column:
    """Stable ids (1..vocab) of the first ``max_length`` tokens.

    Ids come from the MD5 of the token, so they agree across engines and runs.
    """
    tokens = first_tokens(text, max_length)
    return F.transform(
        tokens,
        lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % vocab + 1,
    )


def pad_ids(ids: Column, max_length: int) -> Column:
    """Ids filled up with the pad id to exactly ``max_length``."""
    fill = F.array_repeat(F.lit(PAD_ID).cast("bigint"), F.lit(max_length) - F.size(ids))
    return F.concat(ids, fill)


def attention_mask(ids: Column, max_length: int) -> Column:
    """Ones for real tokens, zeros for padding."""
    return F.concat(
        F.array_repeat(F.lit(1), F.size(ids)),
        F.array_repeat(F.lit(0), F.lit(max_length) - F.size(ids)),
    )
