"""Label, dimension and name normalisers as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Context names and their short forms.
CONTEXTS = {
    "CF": ("Context-free_CF", "CF", "Context_Free_CF"),
    "CA-U": ("Context-aware_Unrelated_CA-U", "Context-aware_Unrelated_CA-Unrel", "CA-U", "CA_Unrel"),
    "CA-R": ("Context-aware_Related_CA-R", "CA-R", "CA_Rel"),
}
#: Patterns of the dimension families.
PEOPLE = "people|person|gender|age|race|ethnic|body|hair|face|skin"
OBJECTS = "object|item|tool|accessor|accessories|clothing|prop"
CAMERA = "camera|angle|view|shot|framing|composition"
SCENE = "scene|location|background|setting|environment|scene_appearance"
#: Word lists of the label normalisers.
UNKNOWN = ("unknown", "unk", "n/a", "na")
POSITIVE = ("present", "yes", "y", "true", "with", "wearing", "visible", "on")
NEGATIVE = ("absent", "no", "n", "false", "without", "none", "not", "missing")
PLANES = ("foreground", "midground", "background")
SIDES = ("left", "center", "right")
PALETTE = ("black", "white", "brown", "blue", "red", "green", "orange", "yellow", "purple", "pink", "cyan", "magenta", "grey", "gray", "beige", "silver", "gold", "ghostwhite")
VALUES = {"head_wear": "headwear", "lamp_post": "lamppost", "neck_tie": "necktie", "tree_line": "treeline", "t_shirt": "t-shirt", "tshirt": "t-shirt", "tee_shirt": "t-shirt"}
OBJECT_TYPES = {"cleaning accessory": "cleaning tool", "cleaning accessories": "cleaning tool", "cleaning equipment": "cleaning tool", "cleaning tools": "cleaning tool", "cleaning tool": "cleaning tool", "backplash": "backsplash", "backplash typo token retained": "backsplash"}
OBJECT_SUFFIX = " (group|cluster|set|objects|object|total|items|item)$"
GARMENTS = {"neck accessory": "necklace", "neck_accessory": "necklace", "neck chain": "necklace", "vest or suspenders": "vest", "t shirt": "t-shirt", "t_shirt": "t-shirt", "tshirt": "t-shirt", "tee shirt": "t-shirt"}


def lookup(values: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """The value of a fixed table, or the default (the key itself)."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key if default is None else default)


def ladder(x: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """The name of the first pattern that is found in x, or null."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(steps):
        out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def contains_any(x: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def label_key(x: Column) -> Column:
    """Trimmed, lower case, spaces and hyphens as one underscore, none at the edges; null as ''."""
    s = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")), r"[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")


def short_context(x: Column) -> Column:
    out = x
    for short, names in CONTEXTS.items():
        out = F.when(x.isin(*names), F.lit(short)).otherwise(out)
    return out


def title_case(x: Column) -> Column:
    """A capital after anything but a letter, as in Hair_Color."""
    parts = F.split(F.lower(x), r"(?<=[^\pL])|(?=[^\pL])")
    return F.array_join(F.transform(parts, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))), "")


def family(x: Column) -> Column:
    """Scene, Camera, Objects or People, by the first pattern found; otherwise the name in title case."""
    return F.coalesce(ladder(F.lower(x), ((SCENE, "Scene"), (CAMERA, "Camera"), (OBJECTS, "Objects"), (PEOPLE, "People"))), title_case(x))


def family_of_cohort(x: Column) -> Column:
    """People, Objects, Camera or Scene, by the first pattern found; otherwise null."""
    return ladder(F.lower(x), ((PEOPLE, "People"), (OBJECTS, "Objects"), (CAMERA, "Camera"), (SCENE, "Scene")))


def activity_family(x: Column) -> Column:
    low = F.lower(x)
    named = ladder(low, (("loc|location|place|background|setting", "Location substitution"), ("activity|semantic|rephrase|paraphrase|original", "Semantic rephrasing"), ("^all_types$", "All activity types")))
    return F.coalesce(named, x)


def simple(x: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, only word characters and ``|=,``, single spaces."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "[_-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\pL\pN_|=, ]", ""), r"\s+", " "))


def simple_key(x: Column) -> Column:
    return F.replace(simple(x), F.lit(" "), F.lit("_"))


def is_structured(x: Column) -> Column:
    return x.rlike("[|=,]")


def structured(x: Column) -> Column:
    """``key=v2,v1|key2=v`` with normal keys and sorted distinct values."""

    def part(s: Column) -> Column:
        names = F.split(s, "=", 2)
        values = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.element_at(names, -1), ","), simple_key), lambda v: v != "")))
        joined = F.array_join(values, ",")
        return F.when(s.contains("="), F.concat(simple_key(names[0]), F.lit("="), joined)).otherwise(joined)

    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), part)
    return F.array_join(F.filter(parts, lambda s: s != ""), "|")


def quality(token: Column, count: Column) -> Column:
    """Sort key of tokens for one meaning, least is best: words, digits, underscores, count down, length, text."""
    return F.struct(
        F.size(F.split(token, " ")).alias("words"), F.length(F.regexp_replace(token, "[^0-9]", "")).alias("digits"),
        F.length(F.regexp_replace(token, "[^_]", "")).alias("underscores"), (-count).alias("down"), F.length(token).alias("length"), token.alias("text"),
    )


def is_token(x: Column) -> Column:
    """Whether a value counts: not null, blank, ``unknown`` or ``none``."""
    return F.coalesce(~F.lower(F.trim(x)).isin("", "unknown", "none"), F.lit(False))


def spaces(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", "")


def slug(x: Column, sep: str = "-", empty: str = "value") -> Column:
    """Letters and digits in lower case, joined by ``sep``."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\pL\pN]+", sep), f"^{sep}|{sep}$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(empty)).otherwise(s)


def limited_slug(x: Column, most: int) -> Column:
    """A slug of at most ``most`` characters; a longer one ends in 8 digits of its md5."""
    s = slug(x)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 9), F.lit("-"), F.substring(F.md5(s), 1, 8)))


def file_name(x: Column) -> Column:
    """Safe characters only."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("role")).otherwise(s)


#: Normal names of dimension paths. Points and other signs of a path are underscores by then.
_KEYS = {
    "demographics_gender_presentation": "gender_presentation", "demographics_age_range": "age_range", "demographics_role_hint": "role_hint", "demographics_skin_tone": "skin_tone",
    "appearance_eyewear_frame_color": "eyewear_frame_color", "appearance_eyewear_present": "eyewear_present", "appearance_eyewear_type": "eyewear_type",
    "appearance_facial_hair_color": "facial_hair_color", "appearance_facial_hair_present": "facial_hair_present", "appearance_facial_hair_style": "facial_hair_style",
    "appearance_hair_color": "hair_color", "appearance_hair_present": "hair_present", "appearance_hair_style": "hair_style",
    "appearance_head_covering_present": "head_covering_present", "appearance_head_covering_color": "head_covering_color", "appearance_head_covering_type": "head_covering_type",
    "appearance_facial_hair_presence": "facial_hair_present", "clothing_by_garment_type": "clothing_garment", "clothing_garment_type": "clothing_garment",
    "clothing_type_item": "clothing_item", "clothingtypeitem": "clothing_item", "emotion_feeling": "emotional_state", "emotionfeeling": "emotional_state",
}
GARMENT_PREFIX = "^clothing[._](by_garment_type[._]|garment_type_)"


def dimension_key(x: Column) -> Column:
    """The normal name of a dimension path; ``unknown`` for null and blank."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    named = F.when(F.lower(F.trim(x)).rlike(GARMENT_PREFIX) | flat.rlike(GARMENT_PREFIX), F.lit("clothing_garment")).otherwise(lookup(_KEYS, flat))
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit("unknown")).otherwise(named)


def dimension_name(cohort: Column, key: Column) -> Column:
    return F.concat_ws(".", slug(cohort, empty="unknown"), dimension_key(key))


def words_of(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))


def presence(x: Column) -> Column:
    tokens = words_of(x)
    has = lambda words: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    return (
        F.when(contains_any(x, UNKNOWN), "unknown").when(has(POSITIVE), "yes").when(has(NEGATIVE), "no")
        .when(contains_any(x, ("without", "absent")), "no").when(contains_any(x, ("with", "present")), "yes").otherwise("unknown")
    )


def gender(x: Column) -> Column:
    return F.when(x.contains("female"), "female").when(x.contains("male"), "male").otherwise("unknown")


def first_held(x: Column, groups: Sequence[tuple[tuple[str, ...], str]]) -> Column:
    """The name of the first group of which a word stands in x, otherwise x."""
    out = x
    for words, name in reversed(groups):
        out = F.when(contains_any(x, words), F.lit(name)).otherwise(out)
    return out


def temperature(x: Column) -> Column:
    return first_held(x, ((("cool",), "cool"), (("warm",), "warm"), (("neutral",), "neutral"), (("unknown",), "unknown")))


def contrast(x: Column) -> Column:
    return first_held(x, ((("high",), "high"), (("low",), "low"), (("medium", "moderate"), "medium"), (("unknown",), "unknown")))


def palette(tokens: Column) -> Column:
    """The first colour of the palette (grey as gray), otherwise the first token."""
    colours = F.filter(tokens, lambda t: t.isin(*PALETTE))
    return F.when(F.size(colours) > 0, F.when(colours[0] == "grey", F.lit("gray")).otherwise(colours[0])).otherwise(F.coalesce(F.get(tokens, F.lit(0)), F.lit("unknown")))


def object_type(x: Column) -> Column:
    return spaces(F.regexp_replace(lookup(OBJECT_TYPES, x), OBJECT_SUFFIX, ""))


def garment(x: Column) -> Column:
    s = F.split(F.replace(x, F.lit("_"), F.lit(" ")), " or ")[0]
    mapped = F.replace(lookup(GARMENTS, s), F.lit("short-sleeved"), F.lit("short sleeved"))
    shirt = mapped.rlike(r"^(.*)(work\s+shirt|short\s*sleeve(d)?\s*(work\s*)?shirt|polo\s*shirt)$") | mapped.endswith(" shirt")
    return F.when(s.contains("overalls") | s.endswith(" overall") | (s == "overall"), "overalls").when(shirt, "shirt").otherwise(mapped)


def generic_tokens(dimension: Column, x: Column) -> Column:
    """Words of a label but for the words of its dimension, repeats kept; ``[unknown]`` if none is left."""
    own = F.split(dimension, "_")
    kept = F.filter(words_of(F.lower(x)), lambda t: ~F.array_contains(own, t))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("unknown")))


def activities(x: Column) -> Column:
    return spaces(F.regexp_replace(x, r"(?i)\bactivit(y|ies)\b", ""))


def label(cohort: Column, dimension: Column, raw: Column) -> Column:
    """The normal label for a cohort and dimension (slugs)."""
    low = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    s = F.when(F.coalesce(low, F.lit("")) == "", F.lit("unknown")).when(contains_any(low, UNKNOWN), F.lit("unknown")).otherwise(low)
    tokens = words_of(s)
    plane = F.filter(tokens, lambda t: t.isin(*PLANES))
    side = F.filter(tokens, lambda t: t.isin(*SIDES))
    generic = F.transform(generic_tokens(dimension, s), lambda t: lookup(VALUES, t))
    acts = activities(s)
    return (
        F.when(dimension == "object_counts_by_position", F.when((F.size(plane) > 0) & (F.size(side) > 0), F.concat_ws(" ", F.get(plane, F.lit(0)), F.get(side, F.lit(0)))).otherwise(s))
        .when((cohort == "objects") & dimension.isin("type", "subtype"), object_type(s))
        .when((cohort == "people") & (dimension == "clothing_garment"), garment(s))
        .when(dimension.endswith("activities"), F.when(acts == "", F.lit("unknown")).otherwise(acts))
        .when(dimension.endswith("present") | dimension.endswith("presence"), presence(s))
        .when(dimension == "gender_presentation", gender(s))
        .when(dimension.contains("color_temperature"), temperature(s))
        .when(dimension.contains("contrast_level"), contrast(s))
        .when(dimension.contains("palette"), palette(generic))
        .otherwise(F.array_join(generic, " "))
    )


def plain_ascii(x: Column) -> Column:
    """Lower case letters, digits and spaces; underscores as spaces, anything else dropped."""
    return F.regexp_replace(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("_"), F.lit(" ")), r"[^a-z0-9\s]", "")


def plane_side(x: Column) -> tuple[Column, Column]:
    """Plane and side of ``plane.side``; null unless both are known and nothing else is there."""
    parts = F.split(x, r"\.")
    plane, side = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ok = (F.size(parts) == 2) & plane.isin(*PLANES) & side.isin(*SIDES)
    return F.when(ok, plane), F.when(ok, side)


def digits(x: Column, n: int) -> Column:
    """A number with n digits after the point: its exact binary value rounded, halves to even, as ``%.nf`` does in C. Null stays null."""
    scale = float(10**n)
    y = x * scale  # the nearest double; its error is exact, from the upper and lower half of x's bits
    big = x * 134217729.0
    high = big - (big - x)
    error = (high * scale - y) + (x - high) * scale
    tie = y - F.floor(y) == 0.5
    whole = F.when(tie & (error > 0), F.floor(y) + 1).when(tie & (error < 0), F.floor(y)).otherwise(F.rint(y))
    return F.when(x.isNotNull(), F.format_string(f"%.{n}f", whole.cast("double") / scale))


def percent_p(p: Column) -> Column:
    """p with two digits and without the leading 0; ``.00`` below 0.005, '' for null."""
    return F.when(p.isNull(), "").when(p < 0.005, ".00").otherwise(F.regexp_replace(digits(p, 2), "^0", ""))


def robustness_cell(share: Column, mean_p: Column) -> Column:
    """Share invariant and mean p as in ``93.3/.72``; ``nan`` for null."""
    return F.concat(F.coalesce(digits(share, 1), F.lit("nan")), F.lit("/"), F.coalesce(F.regexp_replace(digits(mean_p, 2), "^0", ""), F.lit("nan")))


def prevalence_cell(share: Column) -> Column:
    """A share with one digit; '' for null."""
    return F.when(share.isNull(), "").otherwise(digits(share, 1))


def _plain_letters() -> tuple[str, str]:
    """Characters of the basic plane that decompose into one character and accents, and that character; at the end those that
    are accents only, which go."""
    pairs, gone = [], ""
    for code in range(0xA0, 0x10000):
        if not 0xD800 <= code < 0xE000:
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
            if len(plain) == 1 and plain != chr(code):
                pairs.append((chr(code), plain))
            elif not plain:
                gone += chr(code)
    return "".join(a for a, _ in pairs) + gone, "".join(b for _, b in pairs)


_ACCENTED, _UNACCENTED = _plain_letters()
#: Words that carry no meaning of their own.
STOPWORDS = "a an and the of for to in on at from with this that is are was were be been as it its their his her your our"


def strip_accents(x: Column) -> Column:
    """Letters without their accents. Characters that decompose into several, such as ligatures, stay."""
    return F.regexp_replace(F.translate(x, _ACCENTED, _UNACCENTED), r"\pM+", "")


def basic_clean(x: Column) -> Column:
    """Lower case without accents; anything but letters, digits and white space as one space."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(x, F.lit("")))), r"[^\pL\pN]+", " "))


def snake(x: Column) -> Column:
    return F.replace(basic_clean(x), F.lit(" "), F.lit("_"))


def lemmas(x: Column) -> Column:
    """Words without a plural s, without stop words; stands in for a lemmatiser, which may be given in its place."""
    words = F.filter(F.split(basic_clean(x), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS.split()))
    return F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, 1, F.length(w) - 1)).otherwise(w))


def norm_text(x: Column) -> Column:
    return F.array_join(lemmas(x), " ")
