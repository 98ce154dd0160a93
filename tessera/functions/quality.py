"""Whether a text says enough to keep, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import tokens

# Words that fill, patterns of noise, of housekeeping, of captions and of lists of contents.
FILLER = ("okay", "ok", "um", "uh", "yeah", "yes", "no", "right", "so", "well", "thanks", "thank", "next", "slide")
NOISE = (
    r"^\s*(okay|ok|thanks|thank you|you|yes|no|right|next|slide)\s*[.!?]?\s*$",
    r"\b(next slide|any questions|that's it for today|that is it for today|hi everyone|welcome)\b",
    r"\b(black image|video conference screen|non[- ]diagnostic conference|conference low[- ]content slide)\b",
    r"\b(raw transcript:\s*(you|okay|ok|um|uh)?\s*$)\b",
)
HOUSEKEEPING = (
    r"\b(thank you|thanks|okay|ok|all right|alright|next slide|moving on|any questions|question|questions|can you hear|audio|microphone)\b",
    r"\b(break|pause|housekeeping|welcome|introduction|agenda|objectives|disclosures?)\b",
    r"\b(references?|bibliography|acknowledg(e)?ments?|copyright|permission)\b",
)
CAPTION = r"\b(fig|figure|table|references?|caption)\b"
CONTENTS = r"listed on this slide|provisional entit|in italicized text|established categories|learning objectives|today'?s (agenda|outline)|outline of (today|this)|we will cover the following|topics (we|i) will (cover|discuss)"
LISTING = r"we'll of course talk about|we will of course talk about|starting off with|first[,.].{0,40}second[,.].{0,40}third|including:\s|as follows:"


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def filler_share(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*FILLER))) / F.greatest(F.size(words), F.lit(1))


def hard_reason(text: Column, signal: Column, captioned: Column) -> Column:
    """Why a text without a ``signal`` says too little, or null; ``captioned`` texts may be figure captions."""
    said = F.coalesce(text, F.lit(""))
    words = tokens(said)
    n = F.size(words)
    return F.when(
        ~signal,
        F.when(said.rlike(any_of(NOISE)), "noise")
        .when(n < 3, "too short")
        .when((n < 40) & (filler_share(words) >= 0.45), "filler")
        .when(said.rlike(any_of(HOUSEKEEPING)) & (n < 45), "housekeeping")
        .when(captioned & (n < 25) & said.rlike("(?i)" + CAPTION), "caption"),
    )


def verdict(text: Column, signal: Column, context: Column, captioned: Column) -> Column:
    """The class of a text: a hard reason, a soft one, or why it is kept.

    Without a signal of its own a text may be kept for its ``context`` if at
    least five of its words don't fill and none of it is noise.
    """
    said = F.coalesce(text, F.lit(""))
    words = tokens(said)
    n, share = F.size(words), filler_share(words)
    rescued = context & (n - F.size(F.filter(words, lambda w: w.isin(*FILLER))) >= 5) & ~said.rlike(any_of(NOISE))
    kept = signal | rescued
    soft = (
        F.when(kept, F.when(n < 45, F.when(signal, "short, kept for its words").otherwise("short, kept for its context")).otherwise("kept"))
        .when(n < 8, "too short without signal")
        .when(n < 18, "very short without signal")
        .when((n < 40) & (share >= 0.45), "filler")
        .when(said.rlike(any_of(HOUSEKEEPING)) & (n < 45), "housekeeping")
        .when(captioned & (n < 25) & said.rlike("(?i)" + CAPTION), "caption")
        .otherwise("kept")
    )
    return F.coalesce(hard_reason(text, signal, captioned), soft)


def lists_contents(text: Column, names: Column) -> Column:
    """Whether a text lists what is to come: by its words, by a listing of three different ``names`` or more, or by eight within 1,200 letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.size(F.array_distinct(names))
    return low.rlike(CONTENTS) | (low.rlike(LISTING) & (n >= 3)) | ((n >= 8) & (F.length(low) < 1200))
