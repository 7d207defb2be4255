"""Terms that a translation must keep, and words that it gets wrong."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The circled digits that stand for protected terms.
PLACEHOLDERS = [chr(c) for c in (*range(0x2460, 0x2474), *range(0x3251, 0x3260))]


def _whole(terms: list[str]) -> str:
    """Any of the terms as whole words, the longest first; hits with only spaces between them are one."""
    one = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return rf"(?<![A-Za-z0-9])(?:{one})(?![A-Za-z0-9])(?: +(?:{one})(?![A-Za-z0-9]))*"


def protect_terms(text: Column, terms: list[str]) -> Column:
    """struct<text, kept>: the text with a placeholder for each hit, and the hits; those beyond the placeholders stay."""
    pattern, most = _whole(terms), len(PLACEHOLDERS)
    marks = F.array(*map(F.lit, PLACEHOLDERS))
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    between = F.split(F.coalesce(text, F.lit("")), pattern)
    joined = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.when(i < F.size(hits), F.coalesce(F.get(marks, i), F.get(hits, i))).otherwise(F.lit("")))), "")
    return F.struct(joined.alias("text"), F.slice(hits, 1, most).alias("kept"))


def restore_terms(text: Column, kept: Column) -> Column:
    """The placeholders' terms back in their places."""
    for i, mark in enumerate(PLACEHOLDERS):
        text = F.replace(text, F.lit(mark), F.coalesce(F.get(kept, F.lit(i)), F.lit(mark)))
    return text


def kept_intact(text: Column, kept: Column) -> Column:
    """Whether a translation holds every placeholder that its source had."""
    marks = F.slice(F.array(*map(F.lit, PLACEHOLDERS)), F.lit(1), F.size(kept))
    return F.forall(marks, lambda m: F.contains(text, m))


def fix_wrong_sense(source: Column, translated: Column, senses: list[tuple[str, str, str]]) -> Column:
    """(evidence pattern in the source, wrong word, right word): replaced only where the source shows what was meant."""
    for evidence, wrong, right in senses:
        # Nothing replaces the empty string, so that the text stands once in the expression.
        translated = F.replace(translated, F.when(source.rlike(evidence), F.lit(wrong)).otherwise(F.lit("")), F.lit(right))
    return translated


def restore_proper_nouns(source: Column, translated: Column, nouns: dict[str, str]) -> Column:
    """Translated names become the source's own again, if the source has them as whole words."""
    return fix_wrong_sense(source, translated, [(rf"(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])", wrong, name) for wrong, name in nouns.items()])


#: What an entity may look like: a number, or a name, with or without its end mark.
_ENTITY = r"&(#[xX][0-9a-fA-F]{1,8};?|#[0-9]{1,9};?|[A-Za-z][A-Za-z0-9]{1,31};?)"


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _names(old: bool) -> Column:
    """Names of entities, as the standard library has them, with their characters: the old ones, which need no end mark, or all; a literal."""
    names = html.entities.html5
    first = {n: c for n, c in names.items() if n.rstrip(";") in names}
    return F.from_json(F.lit(json.dumps(first if old else names)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a number: those of the C1 range as Windows has them, nothing for controls, a sign for what is none."""
    windows = {str(c): bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
    table = F.from_json(F.lit(json.dumps(windows)), "map<string,string>")
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    control = (number < 9) | number.between(0x0E, 0x1F) | (number == 0x0B) | (number == 0x7F)
    bad = (number == 0) | number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    none = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)
    return F.when(bad, "\ufffd").when(number == 0x0D, "\r").otherwise(F.coalesce(F.try_element_at(table, number.cast("string")), F.when(control | none, "").otherwise(plain)))


def _resolved(entity: Column) -> Column:
    """What an entity, without its mark, stands for; itself with the mark where it is none."""
    bare = F.regexp_replace(entity, ";$", "")
    number = F.when(F.lower(F.substring(bare, 1, 2)) == "#x", F.conv(F.substring(bare, F.lit(3), F.length(bare)), 16, 10)).otherwise(F.substring(bare, F.lit(2), F.length(bare))).cast("long")

    def cut(names: Column) -> Column:
        # Old names hold without an end mark, also before more letters: the longest counts. They have six letters at most.
        heads = F.transform(F.sequence(F.least(F.length(entity), F.lit(7)), F.lit(2), F.lit(-1)), lambda n: F.substring(entity, F.lit(1), n))
        known = F.get(F.filter(heads, lambda h: F.try_element_at(names, h).isNotNull()), F.lit(0))
        return F.when(known.isNull(), F.concat(F.lit("&"), entity)).otherwise(F.concat(F.try_element_at(names, known), F.substring(entity, F.length(known) + 1, F.length(entity))))

    name = F.coalesce(F.try_element_at(_names(True), entity), F.try_element_at(_names(False), entity), _let(_names(True), cut))
    return F.when(F.startswith(entity, F.lit("#")), _character(number)).otherwise(name)


def _unescaped(text: Column) -> Column:
    between = F.split(text, _ENTITY, -1)
    # Each entity is resolved once, where it is found; looking them up by place would search the text anew for each.
    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), _resolved)
    return F.array_join(F.transform(F.arrays_zip(between.alias("part"), found.alias("sign")), lambda p: F.concat(p["part"], F.coalesce(p["sign"], F.lit("")))), "")


def resolve_entities(text: Column) -> Column:
    """Entities resolved twice, as feeds escape twice; a cut one or a mark alone at the end goes."""
    once = lambda t: F.when(t.rlike(_ENTITY), _unescaped(t)).otherwise(t)
    both = _let(text, lambda t: _let(once(t), once))
    return F.when(F.contains(text, F.lit("&")), F.regexp_replace(both, r"&#?[A-Za-z0-9]{0,8}\z", "")).otherwise(text)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def compatible(text: Column) -> Column:
    """NFKC, for texts that aren't plain ASCII."""
    odd = ~text.rlike(r"^[\x00-\x7F]*$")
    return F.when(odd, _nfkc(F.when(odd, text))).otherwise(text)


def first_json_object(text: Column) -> Column:
    """The first JSON object within talk or code fences, as its own text; null without one.

    From each opening brace on, braces outside strings are counted until they
    close; the first stretch that reads as an object counts.
    """
    pieces = r'"(?:[^"\\]|\\.)*"|[{}]|[^"{}]+|"'

    def closed(tail: Column) -> Column:
        tokens = F.regexp_extract_all(tail, F.lit(f"(?s)({pieces})"), F.lit(1))
        state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.lit(False).alias("done"))

        def step(s: Column, t: Column) -> Column:
            depth = s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
            return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["chars"] + F.length(t)).alias("chars"), (depth == 0).alias("done")))

        end = F.aggregate(tokens, state, step)
        return _let(end, lambda e: F.when(e["done"], F.substring(tail, F.lit(1), e["chars"])))

    def found(t: Column) -> Column:
        parts = F.split(t, r"\{", -1)
        tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.concat(F.lit("{"), F.array_join(F.slice(parts, n, F.size(parts)), "{")))
        objects = F.filter(F.transform(tails, closed), lambda o: F.json_object_keys(o).isNotNull())
        return F.when(F.contains(t, F.lit("{")), F.get(objects, F.lit(0)))

    return _let(text, found)
