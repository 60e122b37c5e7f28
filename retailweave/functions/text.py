"""Text keys: normalisation, tokens, signatures, hints."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and replacement rules of the matching domain.
STOPWORDS = ("the", "and", "for", "with", "new", "series", "pack", "bundle", "set")
SINGLE_LETTERS = ("m", "v", "s", "x", "l")
LEFT_HANDED = r"\b(left\s+handed|left\s+hand|gaucher|gauche|lh)\b"
RIGHT_HANDED = r"\b(right\s+handed|right\s+hand|droitier|droite|rh)\b"
VARIANTS_COMMON = (("mkii", "mk2"), ("mkiii", "mk3"), ("mkiv", "mk4"), ("ii", "2"), ("iii", "3"), ("iv", "4"))
VARIANTS = {  # applied one after the other, anywhere in a token
    "tokens": (*VARIANTS_COMMON, ("v", "5"), ("vi", "6"), ("vii", "7"), ("viii", "8")),
    "signature": (*VARIANTS_COMMON, ("vi", "6"), ("vii", "7"), ("viii", "8")),
    "catalog": (*VARIANTS_COMMON, ("vii", "7"), ("viii", "8")),
}
GUITAR_MARKERS = (
    "guitar", "guitare", "les paul", "sg", "strat", "stratocaster", "tele", "telecaster", "super strat", "flying v",
    "explorer", "firebird", "junior", "custom", "standard", "studio", "special",
)
GUITAR_BRANDS = ("gibson", "fender", "prs", "epiphone", "ibanez", "yamaha", "schecter", "musicman")
STRICT_YEAR_BRAND = "gibson"
YEAR_PENALTY, STRICT_YEAR_PENALTY = -25, -40
INSTRUMENTS = (
    ("guitar", ("guitar", "guitare", "les paul", "strat", "tele", "sg", "flying v")),
    ("bass", ("bass",)),
    ("amp", ("amp", "amplifier")),
    ("pedal", ("pedal",)),
    ("keyboard", ("keyboard", "piano")),
)
COLOR_ALIASES = {
    "bk": "black", "blk": "black", "bl": "blue", "wh": "white", "wht": "white", "rd": "red", "gr": "green",
    "gn": "green", "gy": "grey", "gry": "grey", "grey": "grey", "sl": "silver", "sv": "silver", "nat": "natural",
    "n": "natural", "sb": "sunburst", "tb": "transparent blue", "tr": "transparent", "tn": "transparent",
    "ch": "cherry", "cr": "cream", "ca": "candy apple", "iv": "ivory", "ol": "olive", "pk": "pink", "or": "orange",
    "pu": "purple", "br": "brown", "wt": "white",
}
COLOR_WORDS = (
    "black", "white", "red", "blue", "green", "yellow", "orange", "pink", "purple", "brown", "grey", "gray", "silver",
    "gold", "natural", "sunburst", "cherry", "ivory", "transparent", "cream", "burgundy", "wine", "candy",
)
PLAIN_COLORS = (
    "black", "white", "red", "blue", "green", "yellow", "orange", "pink", "purple", "brown", "grey", "gray", "silver",
    "gold", "natural", "cream", "ivory",
)
EAN_LENGTHS = (8, 12, 13, 14)
NAME_TOKENS = 8


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collated(df: DataFrame, columns: Sequence[str], collation: str = "UNICODE_CI_AI") -> DataFrame:
    """Case- and accent-insensitive text columns: equality, grouping, joins and sorting follow the collation."""
    return df.withColumns({c: F.collate(F.col(c), collation) for c in columns})


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """(characters, their one-letter forms, characters with longer forms), by the compatibility decomposition."""
    single, target, longer = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        form = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(form) == 1:
            single.append(char)
            target.append(form)
        elif form:
            longer[char] = form
    return "".join(single), "".join(target), longer


def _character_class(characters: Iterable[str]) -> str:
    """A class of runs: a match looks at each of them, so runs are faster than single characters."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"{chr(low)}-{chr(high)}" for low, high in runs) + "]"


def fold_accents(col: Column | str) -> Column:
    """ASCII form of a text, character by character; characters without one are dropped.

    Texts of ASCII alone, which most are, are left as they are, and so are the ASCII parts of the others. Characters
    with longer forms are looked up one by one, only in texts that have any.
    """
    single, target, longer = _folding()
    rare = _character_class(longer)
    # one literal, which Spark turns into a constant map once: plans stay small however often text is folded
    listed = "\x01".join(f"{char}\x02{form}" for char, form in longer.items())
    forms = F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))

    def beyond_ascii(text: Column) -> Column:
        return F.octet_length(text) > F.length(text)

    def fold(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(rare), F.lit(0)), lambda c: forms[c])
        around = F.zip_with(F.split(text, rare, -1), found, lambda t, f: F.concat(t, F.coalesce(f, F.lit(""))))
        return F.when(beyond_ascii(text) & text.rlike(rare), F.array_join(around, "")).otherwise(text)

    # a one-element transform: each step's text is worked out once, however often it is looked at
    def once(text: Column, step) -> Column:
        return F.get(F.transform(F.array(text), step), F.lit(0))

    # only the runs beyond ASCII are folded, all of a text's at once; no run holds the mark between them
    beyond, mark = r"[^\x00-\x7F]+", "\x01"
    runs = F.array_join(F.regexp_extract_all(_c(col), F.lit(beyond), F.lit(0)), mark)
    plain = F.regexp_replace(once(F.translate(runs, single, target), fold), beyond, "")
    folded = F.zip_with(
        F.split(_c(col), beyond, -1), F.split(plain, mark, -1), lambda t, f: F.concat(t, F.coalesce(f, F.lit("")))
    )
    return F.when(beyond_ascii(_c(col)), F.array_join(folded, "")).otherwise(_c(col))


def normalize_text(col: Column | str) -> Column:
    """Lower-case ASCII words and digits separated by single blanks; '' for null."""
    plain = F.lower(fold_accents(F.coalesce(_c(col), F.lit(""))))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def normalize_exact(col: Column | str) -> Column:
    """The same over the whole Unicode range, by Arrow batches."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.fillna("").map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))

    return F.trim(F.regexp_replace(F.lower(fold(_c(col))), "[^a-z0-9]+", " "))


def normalize_columns(df: DataFrame, columns: Sequence[str], exact: bool = False, suffix: str = "_norm") -> DataFrame:
    fold = normalize_exact if exact else normalize_text
    return df.withColumns({f"{c}{suffix}": fold(c) for c in columns})


def words(norm: Column | str) -> Column:
    """Words of normalised text; an empty array for ''."""
    return F.filter(F.split(_c(norm), " "), lambda w: w != "")


def compact(norm: Column | str) -> Column:
    return F.replace(_c(norm), F.lit(" "), F.lit(""))


def long_words(norm: Column | str) -> Column:
    return F.filter(words(norm), lambda w: F.length(w) > 2)


def simplify_name(norm: Column | str) -> Column:
    """First eight words longer than two letters, of normalised text."""
    return F.array_join(F.slice(long_words(norm), 1, NAME_TOKENS), " ")


def core_name(name: Column | str) -> Column:
    """Part after the first dash, the whole name when there is none."""
    text = F.coalesce(_c(name), F.lit(""))
    rest = F.trim(F.regexp_extract(text, r"(?s)^.*?[-–—](.*)$", 1))
    return F.when(rest != "", rest).otherwise(F.trim(text))


def _normalize_variant(token: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = token
    for source, target in rules:
        out = F.replace(out, F.lit(source), F.lit(target))
    return out


def significant(tokens: Column, brand_words: Column | None = None, drop_single: bool = True) -> Column:
    """Words that are neither stop words, brand words nor (but for a few) single letters."""

    def keep(w: Column) -> Column:
        ok = ~w.isin(*STOPWORDS)
        if drop_single:
            ok = ok & ((F.length(w) > 1) | w.isin(*SINGLE_LETTERS))
        if brand_words is not None:
            ok = ok & ~F.array_contains(brand_words, w)
        return ok

    return F.filter(tokens, keep)


def meaningful_tokens(norm: Column | str, variant: str = "tokens") -> Column:
    """Comparable tokens of normalised text: handedness as `lh`, variants as digits, letter / digit runs split.

    A token's own expansion is sorted, so the result does not depend on hashing order.
    """
    text = F.regexp_replace(F.regexp_replace(_c(norm), LEFT_HANDED, "lh"), RIGHT_HANDED, " ")
    rules = VARIANTS[variant]

    def expand(w: Column) -> Column:
        whole = _normalize_variant(w, rules)
        parts = F.transform(
            F.split(F.regexp_replace(whole, r"(?<=\D)(?=\d)|(?<=\d)(?=\D)", " "), " "),
            lambda p: _normalize_variant(p, rules),
        )
        return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(whole), parts), lambda p: p != "")))

    return F.flatten(F.transform(significant(words(text)), expand))


def model_signature(norm: Column | str, brand_norm: Column | str | None = None, variant: str = "signature") -> Column:
    """Significant words without the brand, run together. The catalogue form also drops stray single letters."""
    brand_words = None if brand_norm is None else words(brand_norm)
    kept = significant(words(norm), brand_words, drop_single=variant == "catalog")
    return F.array_join(F.transform(kept, lambda w: _normalize_variant(w, VARIANTS[variant])), "")


def _contains_any(text: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for marker in markers:
        out = out | text.contains(marker)
    return out


contains_any = _contains_any


def looks_like_guitar(norm: Column | str) -> Column:
    text = _c(norm)
    return _contains_any(text, GUITAR_MARKERS) | text.rlike(r"\b(" + "|".join(GUITAR_BRANDS) + r")\b")


def year_hint(norm: Column | str) -> Column:
    """19xx / 20xx, else a lone 50..99 in the name of a guitar."""
    text = _c(norm)
    full = F.regexp_extract(text, r"\b(19\d{2}|20\d{2})\b", 1)
    short = F.regexp_extract(compact(text), r"(?<!\d)([5-9]\d)(?!\d)", 1)
    return F.when(full != "", full.cast("int")).when(
        (short != "") & looks_like_guitar(text), short.cast("int") + 1900
    )


def year_penalty(
    name: Column, title: Column, brand: Column, manufacturer: Column, years: tuple[Column, Column] | None = None
) -> Column:
    """Different years on guitars, on normalised columns; `years` are the hints of name and title if they are known."""
    mine, theirs = (year_hint(name), year_hint(title)) if years is None else years
    guitar = looks_like_guitar(F.concat_ws(" ", name, title))
    strict = brand.contains(STRICT_YEAR_BRAND) | manufacturer.contains(STRICT_YEAR_BRAND)
    clash = mine.isNotNull() & theirs.isNotNull() & (mine != theirs) & guitar
    return F.when(clash, F.when(strict, STRICT_YEAR_PENALTY).otherwise(YEAR_PENALTY)).otherwise(0)


def instrument_type(norm: Column | str) -> Column:
    out = F.lit("")
    for kind, markers in reversed(INSTRUMENTS):
        out = F.when(_contains_any(_c(norm), markers), kind).otherwise(out)
    return out


def color_hint(norm: Column | str) -> Column:
    """Last colour abbreviation, else the last two colour words."""
    tokens = words(norm)
    aliases = F.create_map(*[F.lit(v) for pair in COLOR_ALIASES.items() for v in pair])
    short = F.filter(F.reverse(tokens), lambda w: w.isin(*COLOR_ALIASES))
    long = F.filter(tokens, lambda w: w.isin(*COLOR_WORDS))
    last_two = F.array_join(F.slice(long, F.greatest(F.size(long) - 1, F.lit(1)), F.lit(2)), " ")
    return F.when(F.size(short) > 0, F.element_at(aliases, F.get(short, F.lit(0)))).otherwise(last_two)


def color_family(color: Column | str) -> Column:
    text = _c(color)
    return (
        F.when(text == "", "")
        .when(text.contains("burst"), "sunburst")
        .when(text.contains("transparent"), "transparent")
        .when(text.isin(*PLAIN_COLORS), text)
        .otherwise(F.split_part(text, F.lit(" "), F.lit(1)))
    )


def valid_ean(col: Column | str) -> Column:
    """Digits of a plausible EAN, '' otherwise."""
    digits = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\D", "")
    ok = F.length(digits).isin(*EAN_LENGTHS) & ~digits.rlike("^0+$")
    return F.when(ok, digits).otherwise("")


def holds_phrase(text_norm: Column, phrase_norm: Column) -> Column:
    """Whole-word containment on normalised text."""
    blank = F.lit(" ")
    return (phrase_norm != "") & F.contains(F.concat(blank, text_norm, blank), F.concat(blank, phrase_norm, blank))


def same_reference(a_norm: Column, b_norm: Column) -> Column:
    return (a_norm != "") & (b_norm != "") & (compact(a_norm) == compact(b_norm))
