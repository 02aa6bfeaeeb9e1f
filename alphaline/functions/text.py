"""String expressions: identifiers, stems, suffixes and numbered names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitise(text: Column) -> Column:
    """Characters outside ``[A-Za-z0-9._-]`` become ``_``; runs of ``_`` collapse."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), "_+", "_")


def sanitise_stem(text: Column) -> Column:
    """Runs of characters outside ``[A-Za-z0-9_.-]`` become one ``_``."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_")


def stem(path: Column) -> Column:
    """The file name without folders and without the text after its last dot."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def class_token(text: Column, separator: str = "_") -> Column:
    """The token after the second purely numeric one; null if there is none."""
    tokens = F.split(text, separator)
    numeric = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.element_at(tokens, i).rlike("^[0-9]+$"))
    return F.when(F.size(numeric) >= 2, F.try_element_at(tokens, F.element_at(numeric, 2) + 1))


# The class names that the manifest contract calls thin.
THIN_CLASSES = (
    "racket", "cable", "wire", "fence", "gate", "antenna", "jewelry", "chandelier",
    "bicycle", "tricycle", "wheel", "ladder", "windmill", "drum", "drumkit", "scaffold",
    "net", "skeleton", "umbrella", "polevault", "handrail", "floorlamp", "musicstand",
    "stand", "spider", "shrimp", "streetlamp", "shoppingcart", "seadragon", "hangglider",
    "basketballhoop", "earphone",
)


def thin_or_complex(token: Column) -> Column:
    """The category of a class token; whatever is unknown or missing is complex."""
    return F.when(F.lower(token).isin(*THIN_CLASSES), "thin").otherwise("complex")


def source_id(copy_id: Column) -> Column:
    """An id without the suffix of an original or variant copy (``_o00``, ``_v03``)."""
    return F.regexp_replace(copy_id, r"_[vo]\d{2}$", "")


def is_derived(copy_id: Column) -> Column:
    """Whether an id names an edge, mixed or bokeh derivative."""
    return copy_id.rlike(r"_[emk]\d{2}$")


def shard_name(index: Column) -> Column:
    return F.format_string("TRAIN_shard_%02d.tar", index)


def epoch_of(name: Column) -> Column:
    """The number in ``epoch_<n>.pth``; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^epoch_(\d+)\.pth$", 1), F.lit("")).cast("int")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def parse_counts(text: Column, known: tuple[str, ...]) -> Column:
    """``k=v,k=v`` as a map of ints over ``known`` keys, zero where not given.

    Reading one with an unknown key, or a value that is no whole number, raises.
    """
    pairs = F.when(F.trim(text) == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(","), F.lit("=")))
    bad = F.exists(F.map_entries(pairs), lambda e: ~F.trim(e["key"]).isin(*known) | ~F.coalesce(e["value"].rlike(r"^\s*\d+\s*$"), F.lit(False)))
    trimmed = F.transform_keys(pairs, lambda k, _: F.trim(k))
    counts = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*[F.coalesce(F.try_element_at(trimmed, F.lit(k)).cast("int"), F.lit(0)) for k in known]))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad counts: "), text))).otherwise(counts)


def patched(text: Column, *patches: tuple[str, str]) -> Column:
    """Text with the first match of each pattern replaced; a pattern without a match raises.

    A second run changes nothing, as long as each pattern also matches its own replacement.
    """
    for pattern, replacement in patches:
        once = F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", f"$1{replacement}")
        text = F.when(text.rlike(pattern), once).otherwise(F.raise_error(F.lit(f"nothing to patch: {pattern}")))
    return text


def random_word(key: Column, length: Column) -> Column:
    """A word of lower-case letters that depends on its key only (at most 32 letters)."""
    digits = F.sha2(key.cast("string"), 256)
    letter = lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int") % 26
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.char(letter(i) + 97)), "")


def signed_percent(value: Column) -> Column:
    """A percentage with sign and one digit."""
    return F.format_string("%+.1f%%", value)


def error_kind(message: Column) -> Column:
    """Whether an error is one of access (``gated``, ``401``) or another; null without one."""
    return F.when(message.contains("gated") | message.contains("401"), "access").when(message.isNotNull(), "other")


def strip_key_prefix(mapping: Column, prefix: str = "_orig_mod.") -> Column:
    """Map keys without a leading prefix."""
    return F.transform_keys(mapping, lambda k, _: F.when(k.startswith(prefix), F.substr(k, F.lit(len(prefix) + 1))).otherwise(k))


def variant_of(name: Column) -> Column:
    """The part after ``+`` in ``model+variant``; empty without one."""
    return F.split_part(name, F.lit("+"), F.lit(2))
