"""Text expressions: normal forms, tokens, counts and checks. All are Columns and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with diacritics and what they fold to, in step.
ACCENTED = "áàâãäåāéèêëēíìîïīóòôõöōúùûüūýÿñçšžčćđ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuyyncszccd"


def let(value: Column, f) -> Column:
    """f(value), with value computed once though f uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def fold(text: Column) -> Column:
    """Lower case without diacritics: index and query go through the same fold."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Dashes to "-", runs of blanks to one space, three or more newlines to two, ends stripped."""
    t = F.regexp_replace(text, "[\u2010-\u2015\u2212]", "-")
    t = F.regexp_replace(t, "[ \\t\u00a0]+", " ")
    return strip(F.regexp_replace(t, "\\n{3,}", "\n\n"))


def normalize(text: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))  # no white space is in \w


def char_shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-character pieces of the normal form; a shorter text as a whole; none of an empty one."""
    piece = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(c, i, F.lit(k)), "")))
    return let(F.filter(F.split(normalize(text), ""), lambda c: c != ""), lambda c: F.when(F.size(c) == 0, F.array().cast("array<string>")).otherwise(piece(c)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded: the full-text tokenizer."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stat_tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case words of more than two characters that aren't stop words or numbers, for counts and clouds."""
    return F.filter(countable(text), lambda w: ~w.isin(stop) & ~w.rlike("^[0-9]+$"))


def countable(text: Column) -> Column:
    """Lower-case runs of three or more letters, digits and underscores, before stop words and numbers go."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))


def bigrams(words: Column) -> Column:
    pair = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    return let(words, pair)


def entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the lower-case characters."""
    n = F.length(text)
    share = lambda chars, c: F.size(F.filter(chars, lambda x: x == c)) / n
    term = lambda chars, c: F.when(c == "", F.lit(0.0)).otherwise(share(chars, c) * F.log2(share(chars, c)))
    return let(F.split(F.lower(text), ""), lambda chars: F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - term(chars, c)))


def low_entropy(text: Column, threshold: float = 1.5) -> Column:
    return (F.length(text) >= 50) & (entropy(text) < threshold)


def corrupt(text: Column, threshold: float = 0.3) -> Column:
    """More than threshold of the characters are controls, private-use or replacement characters, in 20 or more."""
    bad = F.length(F.regexp_replace(text, "[^\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f\ue000-\uf8ff\ufffd]", ""))
    return (F.length(F.trim(text)) >= 20) & (bad / F.length(text) > threshold)


def display_name(path: Column, most: int = 500) -> Column:
    base = F.trim(F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"[\p{Cntrl}]", ""))
    return F.substring(F.when(base == "", F.lit("?")).otherwise(base), 1, most)


def blank_to_null(c: Column) -> Column:
    """Absent, empty and blank are the same in a catalog record."""
    return F.when(F.trim(c) != "", c)


def highlight(text: Column, word: str, around: int = 60) -> Column:
    """The first whole-word hit with around characters on both sides, white space collapsed, ellipses where it is cut."""
    at = F.regexp_instr(text, F.lit(rf"(?iU)(?<!\w)\Q{word}\E(?!\w)"))
    lo = F.greatest(at - around, F.lit(1))
    hi = F.least(at + len(word) - 1 + around, F.length(text))
    cut = F.trim(F.regexp_replace(text.substr(lo, hi - lo + 1), r"(?U)\s+", " "))
    return F.when(at > 0, F.concat(F.when(lo > 1, F.lit("…")).otherwise(F.lit("")), cut, F.when(hi < F.length(text), F.lit("…")).otherwise(F.lit(""))))


def normalize_ocr(text: Column) -> Column:
    """Runs of blanks to one space, three or more newlines to two, ends stripped; a blank text stays as it is, null is empty."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.when(strip(text) != "", strip(t)).otherwise(F.coalesce(text, F.lit("")))


def merged(base: Column, more: Column, most: int = 35) -> Column:
    """base, then those of more, trimmed, of at most 200 characters, that it lacks in any case, up to most in all."""

    def add(held: Column, v: Column) -> Column:
        fits = (v != "") & (F.length(v) <= 200) & (F.size(held) < most) & ~F.exists(held, lambda x: F.lower(x) == F.lower(v))
        return F.when(fits, F.array_append(held, v)).otherwise(held)

    none = F.array().cast("array<string>")
    return F.aggregate(F.transform(F.coalesce(more, none), lambda v: F.trim(F.coalesce(v, F.lit("")))), F.coalesce(base, none), add)
