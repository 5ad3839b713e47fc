"""Text columns: normal forms of names, tokens, acronyms, years, codes."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@cache
def _plain_letters() -> tuple[str, str]:
    """Characters whose compatibility decomposition has one ASCII character, and that character."""
    pairs = []
    for cp in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF00, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            pairs.append((chr(cp), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Common characters that decompose into several ASCII characters.
_SEVERAL = "½¼¾ﬁﬂﬀ…™№"


def normalize(x: Column | str) -> Column:
    """Compatibility decomposition without non-ASCII, lower case, single spaces, trimmed; null is "".

    JVM-side: exact for Latin scripts, full-width forms and the characters of _SEVERAL; for others
    that decompose into several ASCII characters use normalize_exact.
    """
    out = F.coalesce(_c(x), F.lit(""))
    for ch in _SEVERAL:
        out = F.replace(out, F.lit(ch), F.lit(unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()))
    out = F.lower(F.regexp_replace(F.translate(out, *_plain_letters()), r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(out, r"[\s\x1c-\x1f]+", " "))


@F.pandas_udf(T.StringType())
def normalize_exact(x: pd.Series) -> pd.Series:
    """normalize() for any script, in Arrow batches."""
    return x.map(lambda s: " ".join(unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode().lower().split()))


def slugify(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(normalize(x), "[^a-z0-9]+", "-"), F.lit("-"))


def mint_id(name: Column | str) -> Column:
    """dgb_<slug>; a name too long for 64 characters keeps 52 of its slug and six digits of its SHA-1."""
    slug, full = slugify(name), F.concat(F.lit("dgb_"), slugify(name))
    short = F.concat(F.lit("dgb_"), F.rtrim(F.substring(slug, 1, 52), F.lit("-")), F.lit("_"), F.substring(F.sha1(F.encode(_c(name), "UTF-8")), 1, 6))
    return F.when(F.length(full) <= 64, full).otherwise(short)


def name_tokens(x: Column | str) -> Column:
    """Distinct space-separated tokens of the normal form; punctuation stays."""
    return F.array_distinct(F.filter(F.split(normalize(x), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(x: Column | str) -> Column:
    """Distinct trigrams of each word, padded by two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(normalize(x), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    each = F.transform(
        words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def best_score(a: Column | str, b: Column | str) -> Column:
    return F.greatest(trigram_similarity(a, b), jaccard(name_tokens(a), name_tokens(b)))


def strip_parens(x: Column | str) -> Column:
    """The normal form without innermost parenthetical groups."""
    return normalize(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\([^()]*\)", " "))


def letters_of(x: Column | str) -> Column:
    return F.regexp_replace(normalize(x), "[^a-z]", "")


def paren_contents(x: Column | str) -> Column:
    """Letters of each parenthetical group that has any."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"\(([^()]*)\)"), F.lit(1)), letters_of), lambda t: t != "")


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the letters of needle occur in this order in hay; false for an empty needle. Both of a-z."""
    return (F.length(needle) > 0) & F.rlike(hay, F.array_join(F.split(needle, ""), ".*"))


def acronym_variant(a: Column | str, b: Column | str) -> Column:
    """Equal names but for parentheses, each of which abbreviates the common name; symmetric."""
    base = strip_parens(a)
    letters = letters_of(F.regexp_replace(F.coalesce(_c(a), F.lit("")), r"\([^()]*\)", " "))
    inside = F.concat(paren_contents(a), paren_contents(b))
    return (base != "") & (base == strip_parens(b)) & (F.size(inside) > 0) & F.forall(inside, lambda p: is_subsequence(p, letters))


def year_tokens(x: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))))


def differs_by_year(a: Column | str, b: Column | str) -> Column:
    """Whether the sets of years 1900 to 2099 differ: editions of one name, not copies."""
    return year_tokens(a) != year_tokens(b)


def is_qid(x: Column | str) -> Column:
    return F.rlike(_c(x), F.lit("^Q[0-9]+$"))


# The entity types and the names that stand for one of them.
SANCTIONED_TYPES = ("ORG", "PER", "LOC", "EVENT", "POLICY", "LAW", "WORK", "PRODUCT")
TYPE_ALIASES = {"PROGRAM": "POLICY", "PROGRAMA": "POLICY", "DECRETO": "POLICY", "DECREE": "POLICY", "AWARD": "EVENT", "PREMIO": "EVENT", "PRÊMIO": "EVENT"}


def sanctioned_type(x: Column | str) -> Column:
    """The sanctioned type a label stands for, else null."""
    up = F.upper(F.trim(_c(x)))
    aliases = F.create_map(*[F.lit(v) for pair in TYPE_ALIASES.items() for v in pair])
    known = F.coalesce(F.element_at(aliases, up), up)
    return F.when(known.isin(*SANCTIONED_TYPES), known)


def first_object(x: Column | str) -> Column:
    """From the first opening to the last closing brace; "" without."""
    return F.regexp_extract(_c(x), r"(?s)(\{.*\})", 1)


def sentences(x: Column | str) -> Column:
    """Cut after ". ", "! " and "? "; only sentences of over 30 characters."""
    parts = F.split(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"([.!?]) ", "$1\u0001"), "\u0001", -1)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 30)


def word_count(x: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"\s+"), lambda w: w != ""))


def preview(x: Column | str, n: int) -> Column:
    return F.substring(_c(x), 1, n)


def prompt_hash(x: Column | str) -> Column:
    return F.sha2(_c(x), 256)


def clean_html(x: Column | str) -> Column:
    """Text of a page: without scripts, styles, comments and tags; common entities read; single spaces."""
    out = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r\f\x0b]+", " "))


def long_enough(x: Column | str, chars: int = 50, words: int = 3) -> Column:
    return (F.length(_c(x)) >= chars) & (word_count(x) >= words)


def has_temporal_term(x: Column | str) -> Column:
    """Whether a question asks for what is recent."""
    return F.rlike(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("recente|último|ultima|última|atual|hoje|novo|nova"))


def level1_code(x: Column | str) -> Column:
    """The first two-digit code of a reply: one that stands alone, else at the start, else any two digits."""
    text = F.coalesce(_c(x), F.lit(""))
    tries = (r"\b(\d{2})\b", r"^\s*(\d{2})", r"(\d{2})")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in tries])


def level_code(x: Column | str, level: int, default: str | None = None) -> Column:
    """The code of a level (two digits, dots between) in a free reply.

    In turn: one that stands alone, one at the start, one anywhere, the first digits whatever stands
    between them, the default.
    """
    text = F.coalesce(_c(x), F.lit(""))
    code = r"\d{2}" + r"\.\d{2}" * (level - 1)
    digits = F.regexp_replace(text, "[^0-9]", "")
    first = F.concat_ws(".", *[F.substring(digits, 2 * k + 1, 2) for k in range(level)])
    tries = [F.nullif(F.regexp_extract(text, p.format(code), 1), F.lit("")) for p in (r"\b({})\b", r"^\s*({})", r"({})")]
    return F.coalesce(*tries, F.when(F.length(digits) >= 2 * level, first), F.lit(default))


def hierarchy_holds(l1: Column | str, l2: Column | str, l3: Column | str) -> Column:
    """Each level's code starts with the one above; a missing level ends the check."""
    a, b, c = _c(l1), _c(l2), _c(l3)
    under = lambda child, parent: child.isNull() | (parent.isNotNull() & F.startswith(child, F.concat(parent, F.lit("."))))
    return F.coalesce(a.isNotNull() & under(b, a) & under(c, b), F.lit(False))


def truncation_variants(x: Column | str) -> Column:
    """Augmentation: the whole text, its first and middle paragraph, and the first half of its words."""
    text = F.coalesce(_c(x), F.lit(""))
    paragraphs, words = F.split(text, "\n\n", -1), F.split(text, " ", -1)
    half = F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))), " ")
    middle = F.get(paragraphs, F.floor(F.size(paragraphs) / 2).cast("int"))
    return F.array(*[
        F.struct(F.lit(k).alias("variant"), v.alias("text")) for k,
        v in (("whole", text), ("first", F.get(paragraphs, F.lit(0))), ("middle", middle), ("half", half))
    ])


#: Frequent words that full-text search ignores.
STOPWORDS = ("a", "as", "ao", "com", "da", "das", "de", "do", "dos", "e", "em", "na", "no", "o", "os", "para", "por", "que", "se", "um", "uma")


def light_stem(word: Column) -> Column:
    """Portuguese plural and adverb endings off words of over four letters."""
    out = word
    for ending, instead in (("oes$", "ao"), ("aes$", "ao"), ("ais$", "al"), ("eis$", "el"), ("mente$", ""), ("es$", ""), ("s$", "")):
        out = F.when(F.length(word) > 4, F.regexp_replace(out, ending, instead)).otherwise(out)
    return out


def search_terms(x: Column | str) -> Column:
    """Normalised, stemmed words of a text or question without stop words."""
    words = F.split(F.regexp_replace(normalize(x), "[^a-z0-9]+", " "), " ")
    return F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS)), light_stem)
