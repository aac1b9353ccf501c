"""Scalars on answers and texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_value(answer: Column) -> Column:
    """The first number in an answer, times its scale word, rounded to cents (halves to even); a number in brackets is negative; else null."""
    low = F.lower(answer)
    scale = F.when(low.rlike(r"\b(billion|bn)\b"), 1e9).when(low.rlike(r"\b(million|mm|mil)\b"), 1e6).when(low.rlike(r"\b(thousand|k)\b"), 1e3).otherwise(1.0)
    plain = F.regexp_replace(answer, r"(?<=\d),(?=\d)", "")
    bracketed = F.regexp_extract(plain, r"\(\s*([\d,.]+)\s*\)", 1)
    text = F.when(bracketed != "", F.concat(F.lit("-"), bracketed)).otherwise(plain)
    number = F.replace(F.regexp_extract(text, r"-?[\d,.]+\.?\d*", 0), F.lit(","), F.lit(""))
    return F.bround(number.try_cast("double") * scale, 2)


def lenient_object(answer: Column, schema: str) -> Column:
    """A JSON object out of an answer: inside a fence if there is one, None as null, white space collapsed, trailing commas dropped."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(answer)
    body = F.regexp_replace(F.replace(body, F.lit("None"), F.lit("null")), r"\s+", " ")
    return F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), schema)


def display(value: Column, kind: str) -> Column:
    """A figure as statements print it: NA where it is null, two decimals for margins and ratios, else a whole number with separators."""
    shown = F.format_string("%.2f", value) if kind in ("margin", "ratio") else F.format_number(value, 0)
    return F.when(value.isNull(), "NA").otherwise(shown)


#: Fixed value: how a search for a figure is put, before and after the name.
_ASK, _TAIL = "Find the exact numeric value of '", ". Return only the numeric figure. If the value is presented with parentheses indicating a negative amount, treat it as negative."


def search_text(name: Column, synonyms: Column) -> Column:
    """The query for a metric: its name, then at most six other names, each once whatever its case; null synonyms count as none."""
    known = F.coalesce(synonyms, F.expr("cast(array() as array<string>)"))
    lower = F.transform(known, F.lower)
    first = F.filter(known, lambda s, i: (F.array_position(lower, F.lower(s)) == i + 1) & (F.lower(s) != F.lower(name)))
    others = F.when(F.size(first) > 0, F.concat(F.lit(" (also known as: "), F.array_join(F.slice(first, 1, 6), ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit(_ASK), name, F.lit("'"), others, F.lit(_TAIL))


def at_start(text: Column, title: Column, *, octets: bool = False) -> Column:
    """Whether ``text`` begins with ``title``, whatever its case and white space, with a wrong, missing or surplus sign for every eight, two at most.

    A title without signs begins nothing; nulls begin nothing and have no title. Of a text only as much as the title is
    compared, by edit distances that give up beyond two.

    With ``octets``, by the rules of the registered SQL: wrong octets of UTF-8 are counted, so that a missing letter with
    an accent is two, cases are those of single signs wherever they stand, and a vertical tab is no white space.
    """
    if octets:
        plain = lambda x: F.replace(F.replace(x, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
        space, units = r"[\t\n\f\r ]+", lambda x: F.decode(x.cast("binary"), "ISO-8859-1")
    else:
        plain, space, units = lambda x: x, r"\s+", lambda x: x
    squeeze = lambda x: F.regexp_replace(F.lower(plain(F.coalesce(x, F.lit("")))), space, "")

    def begins(x: Column) -> Column:
        text, title, size = x["text"], x["title"], F.length(x["title"])
        wrong = F.least(F.lit(2), F.floor(size / 8).cast("int"))
        near = F.exists(F.sequence(size - wrong, size + wrong), lambda n: F.levenshtein(units(F.substr(text, F.lit(1), n)), units(title), 2).between(0, wrong))
        return (size > 0) & (F.startswith(text, title) | ((wrong > 0) & near))

    # an array of one, so that both are squeezed once and not for every length
    return F.exists(F.array(F.struct(squeeze(text).alias("text"), squeeze(title).alias("title"))), begins)
