"""Column functions on titles and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a title key leaves out.
STOPWORDS = (
    "the a an and or of to in on for with is are "
    "be as at by this that it its from new will has "
    "have was not but can how why says said after over"
).split()

WORD = r"[a-z0-9]+(\.[0-9]+)*"
VERSION = r"\b[0-9]+(\.[0-9]+)*\b"


def squeeze(text: Column) -> Column:
    """Spaces in a row become one, line ends stay, ends are trimmed; zero-width spaces go."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "​", ""), " ", " ")
    return F.trim(F.regexp_replace(plain, r"[ \t\r\f\x0B]+", " "))


def title_words(title: Column) -> Column:
    """Lower-case words and numbers with their versions; no stop words, no single letters."""
    found = F.regexp_extract_all(F.lower(squeeze(title)), F.lit(WORD), F.lit(0))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(found, lambda w: ~F.array_contains(stop, w) & ((F.length(w) > 1) | w.rlike("[0-9]")))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(title_words(title))


def title_key(title: Column) -> Column:
    """The sorted words with repeats: equal for titles that differ in order and stop words only."""
    return F.array_join(F.array_sort(title_words(title)), " ")


def versions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(VERSION), F.lit(0)))


def versions_conflict(a: Column, b: Column) -> Column:
    va, vb = versions(a), versions(b)
    return (F.size(va) > 0) & (F.size(vb) > 0) & ~F.arrays_overlap(va, vb)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)).cast("double"))


def coverage(a: Column, b: Column) -> Column:
    """Shared words over the shorter title's."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.least(F.size(a), F.size(b)).cast("double"))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The keywords with a space on either side; those that end in '-' or 'tun' anywhere."""
    padded = F.concat(F.lit(" "), F.lower(squeeze(text)), F.lit(" "))
    stems = [k for k in keywords if k.endswith(("-", "tun"))]
    plain = [k for k in keywords if k not in stems]
    hit = lambda k: (F.instr(padded, F.concat(F.lit(" "), k)) > 0) | (F.instr(padded, F.concat(k, F.lit(" "))) > 0)
    out = F.filter(F.array(*map(F.lit, plain)), hit) if plain else F.array().cast("array<string>")
    if stems:
        out = F.concat(out, F.filter(F.array(*[F.lit(k.rstrip("-")) for k in stems]), lambda k: F.instr(padded, k) > 0))
    return out


def plain_words(text: Column) -> Column:
    """array<string>: the runs of plain letters and digits of a lower-case text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))


def whole_word_hits(text: Column, keywords: list[str], words: Column | None = None) -> Column:
    """How many different keywords stand in a lower-case text as whole words; ``words`` are its ``plain_words``, if they are at hand."""
    import re

    plain = [k for k in dict.fromkeys(keywords) if re.fullmatch("[a-z0-9]+", k)]
    other = [F.when(text.rlike(f"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])"), 1).otherwise(0) for k in dict.fromkeys(keywords) if k not in plain]
    known = F.size(F.array_intersect(plain_words(text) if words is None else words, F.array(*map(F.lit, plain)))) if plain else F.lit(0)
    return sum(other, F.coalesce(F.when(text.isNotNull(), known), F.lit(0)))


def detect_language(text: Column) -> Column:
    """zh, ja, ko or en by the share of characters of the script."""
    t = squeeze(text)
    n = F.length(t)
    count = lambda chars: n - F.length(F.regexp_replace(t, f"[{chars}]", ""))
    return (
        F.when(count("一-鿿") >= F.greatest(F.lit(3), n * 0.05), "zh")
        .when(count("぀-ヿ") > n * 0.05, "ja")
        .when(count("가-힯") > n * 0.05, "ko")
        .otherwise("en")
    )


def redact(text: Column) -> Column:
    """E-mail addresses show their domain only; long keys are masked."""
    no_mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)", "***@$1")
    return F.regexp_replace(no_mail, r"\b(sk|ghp|xoxb)[-_][A-Za-z0-9_-]{8,}", "$1-***")


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after the last clause mark in the last two fifths if there is one."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    head = F.substring(flat, F.lit(1), F.lit(limit - 1))
    clause = F.regexp_extract(head, r"^(.*[.!?;,。！？；，])", 1)
    cut = F.when(F.length(clause) >= int(limit * 0.6), F.rtrim(F.regexp_replace(clause, r"[.!?;,。！？；，]$", ""))).otherwise(F.rtrim(head))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def escape_html(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16LE")) / 2).cast("int")


def strip_markup(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|svg|form|iframe)\b.*?</\1>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?i)</(p|div|li|h[1-6]|tr)>|<br\s*/?>", "\n")
    bare = F.regexp_replace(bare, r"<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t\r\f]+", " "), r" ?\n\s*", "\n"))
