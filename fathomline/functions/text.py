"""String functions: normalising, similarities, labels, parsing of identifiers and numbers."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.params import TextParams

# Word forms in names, and words that say nothing about identity.
CONTRACTIONS = (("road", "rd"), ("street", "st"), ("avenue", "ave"), ("highway", "hwy"), ("junction", "jct"))
EXPANSIONS = (("RD", "ROAD"), ("ST", "STREET"), ("AVE", "AVENUE"), ("HWY", "HIGHWAY"))
GENERIC_TOKENS = ("ROAD", "STREET", "AVENUE", "HIGHWAY", "FLYOVER", "BRIDGE", "TUNNEL", "BYPASS", "DRIVE", "LANE", "PATH", "WAY", "NEAR", "EASTBOUND", "WESTBOUND", "NORTHBOUND", "SOUTHBOUND")


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, case-folded: no built-in does this."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).casefold())


@F.pandas_udf(T.StringType())
def fold_marks(text: pd.Series) -> pd.Series:
    """Decomposed and case-folded, marks dropped."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold())


def fold(text: Column) -> Column:
    """Decomposed and case-folded text; ASCII, which needs neither, stays out of Python's results."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(_folded(text))


def normalize(text: Column) -> Column:
    """Decomposed and case-folded, & to and, long forms contracted as whole words, all but a-z and 0-9 to single spaces."""
    return _contracted(fold(F.coalesce(text, F.lit(""))))


def _contracted(folded: Column) -> Column:
    out = F.regexp_replace(folded, "&", " and ")
    for long, short in CONTRACTIONS:
        out = F.regexp_replace(out, rf"(?U)\b{long}\b", short)
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def road_key(code: Column, *names: Column) -> Column:
    """Identity of a road: its code, else its first non-blank name, normalised."""
    named = F.coalesce(*[F.when(n != "", n) for n in names], F.lit(""))
    return F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("street_code:"), code)).otherwise(F.concat(F.lit("street_name:"), normalize(named)))


def region_of_label(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.contains("hong kong island"), "hong_kong_island").when(low.contains("kowloon"), "kowloon").when(low.contains("new") & low.contains("territor"), "new_territories")


def network_of_label(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.contains("sub-total") | low.contains("subtotal"), "subtotal").when(F.trim(low) == "total", "territory_total").when(low.contains("major"), "major").when(low.contains("minor"), "minor")


def tokens(text: Column, drop: tuple[str, ...] = ()) -> Column:
    return _tokens(normalize(text), drop)


def _tokens(normal: Column, drop: tuple[str, ...] = ()) -> Column:
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*drop)) if drop else words
    return F.array_distinct(kept)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller side."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; argument order matters. Pairs are compared once per batch."""
    known: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = difflib.SequenceMatcher(None, pair[0] or "", pair[1] or "").ratio()
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def text_similarity(a: Column, b: Column, params: TextParams = TextParams()) -> Column:
    """0 if a side is blank, 1 if equal, otherwise the weighted sequence ratio and token Jaccard."""
    x, y = normalize(a), normalize(b)
    mixed = params.sequence_weight * sequence_ratio(x, y) + params.jaccard_weight * jaccard(tokens(a), tokens(b))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(mixed)


def _upper_words(text: Column, keep_and: bool = True) -> Column:
    """Words of the upper-cased text; & is the word AND, or a separator like all other signs."""
    loud = F.upper(F.coalesce(text.cast("string"), F.lit("")))
    loud = F.replace(loud, F.lit("&"), F.lit(" AND ")) if keep_and else loud
    return F.filter(F.split(F.regexp_replace(loud, "[^A-Z0-9]+", " "), " "), lambda w: w != "")


def _respelled(words: Column, forms: tuple[tuple[str, str], ...]) -> Column:
    def one(w: Column) -> Column:
        out = w
        for short, long in forms:
            out = F.when(w == short, long).otherwise(out)
        return out

    return F.transform(words, one)


def _largest(x: Column, y: Column) -> Column:
    """The largest of token Jaccard, half the sequence ratio, and 1 where one name is a substring of the other; x, y: words."""
    a, b = F.array_join(x, " "), F.array_join(y, " ")
    inside = (a.contains(b) | b.contains(a)).cast("double")
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.greatest(jaccard(F.array_distinct(x), F.array_distinct(y)), 0.5 * sequence_ratio(a, b), inside))


def name_similarity(a: Column, b: Column, drop: tuple[str, ...] = GENERIC_TOKENS) -> Column:
    """Similarity of names without generic words; which words those are is part of a design."""
    x, y = (F.filter(_upper_words(c), lambda w: ~w.isin(*drop)) for c in (a, b))
    return _largest(x, y)


def core_name_similarity(a: Column, b: Column, replacements: dict[str, str], drop: tuple[str, ...] = GENERIC_TOKENS) -> Column:
    """As name_similarity, after words were replaced by their long forms."""
    x, y = (F.filter(_respelled(_upper_words(c), tuple(replacements.items())), lambda w: ~w.isin(*drop)) for c in (a, b))
    return _largest(x, y)


def substring_or_ratio(a: Column, b: Column) -> Column:
    """1 where one name contains the other, otherwise the sequence ratio; short forms are expanded, generic words kept."""
    x, y = (F.array_join(_respelled(_upper_words(c, False), EXPANSIONS), " ") for c in (a, b))
    return F.when((x == "") | (y == ""), 0.0).when(x.contains(y) | y.contains(x), 1.0).otherwise(sequence_ratio(x, y))


def best_of_variants(variants: Column, names: Column, missing: tuple[str, ...] = ("-99", "")) -> Column:
    """Largest token Jaccard over all variant and name pairs, sentinels ignored."""
    # Python functions cannot stand in lambdas, so each array is folded as one text.
    folded = lambda texts: F.split(fold(F.array_join(F.transform(texts, lambda t: F.when(t.isin(*missing), "").otherwise(F.coalesce(t, F.lit("")))), "\x01")), "\x01")
    words = lambda texts: F.transform(folded(texts), lambda t: _tokens(_contracted(t)))
    both = F.array(F.struct(words(variants).alias("v"), words(names).alias("n")))
    pairs = F.get(F.transform(both, lambda x: F.transform(x["v"], lambda v: F.array_max(F.transform(x["n"], lambda n: jaccard(v, n))))), 0)
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def confidence(name_score: Column, endpoint_score: Column, params: TextParams = TextParams()) -> Column:
    medium = [(name_score >= n) & (endpoint_score >= e) for n, e in params.medium]
    return F.when((name_score >= params.high[0]) & (endpoint_score >= params.high[1]), "high").when(medium[0] | medium[1] | medium[2], "medium").otherwise("low")


def orientation(direct: Column, reverse: Column, params: TextParams = TextParams()) -> Column:
    better = reverse > direct + params.reversed_margin
    return F.when((reverse >= params.reversed_at) & better, "reversed").when(direct >= params.reversed_at, "direct").when(better, "possible_reversal").otherwise("ambiguous")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Texts whose condition holds, in order, without repeats, joined by ';'."""
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in pairs])
    return F.array_join(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), ";")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def class_slug(text: Column) -> Column:
    """slug of a vehicle class name, where s.d. and d.d. (single and double deck) are one word each."""
    return slug(F.replace(F.replace(F.lower(text), F.lit("s.d."), F.lit("sd")), F.lit("d.d."), F.lit("dd")))


def clean_id(text: Column, inner_space: bool = False) -> Column:
    """'123.0' to '123'; nan, none and <null> to ''."""
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    t = F.regexp_replace(t, r"\s+", "") if inner_space else t
    return F.when(F.lower(t).isin("nan", "none", "<null>", "null"), "").otherwise(F.regexp_replace(t, r"^(\d+)\.0$", "$1"))


def boolean(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))) == "true", F.lit(False))


def number(text: Column) -> Column:
    """Commas and stars removed; null where no number is left."""
    return F.expr("try_cast(NULL AS double)") if text is None else F.regexp_replace(text, "[,* ]", "").try_cast("double")


def first_value(values: Column) -> Column:
    """The first of a list as text; empty for a null or empty list."""
    return F.coalesce(F.get(values, 0).cast("string"), F.lit(""))


def flag(text: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*values), F.lit(False)).cast("int")


def speed_kmh(text: Column) -> Column:
    value = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.lower(text).contains("mph"), value * 1.609344).otherwise(value)


def road_group(text: Column, track: str = "local") -> Column:
    """_link stripped, then one of eight groups; ``track`` names the group of tracks, which designs differ on."""
    base = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "_link$", "")
    return (
        F.when(base.isin("motorway", "trunk", "primary", "secondary", "tertiary"), base)
        .when(base.isin("residential", "unclassified", "living_street", "road"), "local")
        .when(base == "track", track)
        .when(base == "service", "service")
        .when(base == "", "unmatched")
        .otherwise("other")
    )


def split_list(text: Column, sign: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sign), lambda x: F.trim(x)), lambda x: x != "")


def html_fields(html: Column) -> Column:
    """<td>key</td><td>value</td> pairs as a map; tags stripped, the last of equal keys kept."""
    pairs = F.transform(
        F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?s)(<td[^>]*>.*?</td>\s*<td[^>]*>.*?</td>)"), F.lit(1)),
        lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(unescape(F.regexp_replace(c, "<[^>]*>", "")))),
    )
    keys = F.transform(pairs, lambda p: F.get(p, 0))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(keys, i + 2, F.size(keys)), lambda k: k == F.get(p, 0))) == 0)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.get(p, 0).alias("key"), F.get(p, 1).alias("value"))))


def unescape(text: Column) -> Column:
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), (" ", "&nbsp;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text
