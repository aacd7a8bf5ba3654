"""Column functions over text: tokens, similarities, sentences, names and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOKEN = "[a-zA-Z0-9]+"
STOP_WORDS = "a an and are as at be by for from how in is it of on or the to what while with".split()
BOILERPLATE = [
    r"^pmbok(?:®)?\s*guide\b.*$",
    r"^project management institute\.?$",
    r"^pmi(?:®)?\.?$",
    r"^copyright\s*(?:©|\(c\))\s*.*$",
    r"^page\s+\d+\s+(?:of|/)\s+\d+$",
    r"^\d+(?:st|nd|rd|th)\s+edition$",
    r"^a guide to the project management body of knowledge\b.*$",
]
CROSS_REFERENCES = ["[Ss]ection", "[Cc]hapter", "[Ff]igure", "[Tt]able", "[Ee]xhibit"]
EMPTY_PAGE = "(empty page)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def token_set(text: Column) -> Column:
    """Distinct lower-cased ASCII tokens in the order in which they first come."""
    return F.array_distinct(token_list(text))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two token sets, 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0)), F.lit(0.0))


def containment(part: Column, whole: Column) -> Column:
    """Share of `part` that `whole` has, 0 for an empty part."""
    return F.coalesce(F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0)), F.lit(0.0))


#: All white space, and what ends a line.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(text, F.lit(WHITE))


def line_list(text: Column) -> Column:
    """The lines of a text, whichever way they end; one empty line for an empty text."""
    return F.split(text, LINE_END)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated words; none for a blank text."""
    return F.filter(F.split(squeezed(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences of the text with its white space squeezed; the text itself if it has none."""
    return F.split(squeezed(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")


def raw_sentences(text: Column) -> Column:
    """Sentences of the text as it stands; none for a blank text."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)(?<=[.!?])\s+")
    return F.filter(parts, lambda s: s != "")


def ended(sentence: Column) -> Column:
    """The sentence, with a full stop unless it has an end mark."""
    s = F.trim(sentence)
    return F.when(s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))


def meaningful(text: Column) -> Column:
    """Tokens, repeats kept, without stop words and single characters."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(token_list(text), lambda t: ~F.array_contains(stop, t) & (F.length(t) > 1))


def excerpt(text: Column, most: int) -> Column:
    """The first tokens and a full stop; empty for a text without tokens."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return bound(tokens, lambda t: F.when(F.size(t) == 0, "").otherwise(F.concat(F.array_join(F.slice(t, 1, most), " "), F.lit("."))))


def canonical_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+", " "))


def node_id(canonical: Column) -> Column:
    return F.concat(F.lit("node_"), F.substring(F.sha1(canonical), 1, 12))


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(F.lit("edge_"), F.substring(F.sha1(F.concat_ws("|", source, relation, target)), 1, 14))


def question_id(run: str, mark: str, question: Column) -> Column:
    return F.concat(F.lit(f"{run}:{mark}_"), F.substring(F.sha1(question), 1, 10))


def hex_number(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def value_scale(value: Column, magnitude: float) -> Column:
    """1 plus up to ten times the magnitude, by a hash of the value."""
    return F.lit(1.0) + (hex_number(F.sha1(value), 1, 6) % 11) * F.lit(magnitude)


def slug(value: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", "unknown").otherwise(s)


def section_name(text: Column) -> Column:
    return F.coalesce(F.nullif(squeezed(text), F.lit("")), F.lit("Unknown Section"))


def snippet(text: Column, most: int = 280) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def is_boilerplate(line: Column) -> Column:
    """Running heads, page numbers and lines of less than two characters."""
    s = stripped(line)
    return (F.length(s) < 2) | s.rlike(r"^\d+$") | s.rlike("(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE))


def page_text(text: Column) -> Column:
    """A page's lines, stripped, without blank ones and boilerplate."""
    lines = F.filter(F.transform(line_list(F.coalesce(text, F.lit(""))), stripped), lambda x: (x != "") & ~is_boilerplate(x))
    return bound(F.array_join(lines, "\n"), lambda t: F.when(t == "", EMPTY_PAGE).otherwise(t))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, stripped; null if there is none."""
    return F.get(F.filter(F.transform(line_list(text), stripped), lambda x: x != ""), F.lit(0))


def section_of(text: Column) -> Column:
    """A section's name from a page's first line: without a leading "Section N", at most 120 characters."""
    s = F.regexp_replace(first_line(text), r"(?i)^section\s+\d+[.:\-]?\s*", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^[ :-]+|[ :-]+$", ""), 1, 120), F.lit("")), F.lit("Section"))


def cross_references(text: Column) -> Column:
    """Numbered mentions of sections, chapters, figures, tables and exhibits, each named as a section, once."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(rf"{p}\s+(\d+(?:\.\d+)*)"), F.lit(1)), lambda n: F.concat(F.lit("Section "), n)) for p in CROSS_REFERENCES]
    return F.array_distinct(F.concat(*found))


def document_type(path: Column) -> Column:
    return F.when(F.lower(path).contains("pmbok"), "pmbok").otherwise("generic")


def number_or(value: Column, default: float = 0.0) -> Column:
    """A text as a number, the default for null, blank and anything else."""
    return F.coalesce(stripped(value.cast("string")).try_cast("double"), F.lit(float(default)))


def count_or(value: Column, default: int = 0) -> Column:
    """A text as a whole number, cut towards 0 and at least 0; the default where it is no number."""
    number = stripped(value.cast("string")).try_cast("double")
    return F.greatest(F.lit(0), F.coalesce(F.when(~F.isnan(number), number).try_cast("int"), F.lit(default)))


# Words for true and false.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off")


def flag(value: Column) -> Column:
    """True or false for the usual words, else null."""
    v = F.lower(stripped(value))
    return F.when(v.isin(*TRUE_WORDS), True).when(v.isin(*FALSE_WORDS), False)


def flag_or_error(value: Column, name: str) -> Column:
    """True or false for the usual words; any other value, null too, fails the query that reads it, with its name."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} is neither true nor false: "), F.coalesce(value, F.lit("null"))))
    return F.coalesce(flag(value), wrong.cast("boolean"))


def judge_score(raw: Column) -> Column:
    """The number on the first "score:" line, 5 if there is none, within 0 and 10."""
    found = F.regexp_extract(raw, r"(?im)^score[ \t]*:[ \t]*([0-9]+(?:\.[0-9]+)?)[ \t]*$", 1)
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(5.0))))


def judge_reason(raw: Column) -> Column:
    found = F.regexp_extract(raw, r"(?im)^reasoning[ \t]*:[ \t]*(.*)$", 1)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), F.trim(raw))


def roman_or_arabic(raw: Column) -> Column:
    """A page number in digits or in Roman numerals up to C; null if it is neither."""
    s = F.upper(F.trim(raw))
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).otherwise(0)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    add = lambda at, c: F.struct((at["total"] + F.when(value(c) < at["last"], -value(c)).otherwise(value(c))).alias("total"), value(c).alias("last"))
    roman = F.aggregate(F.reverse(F.split(s, "")), start, add, lambda at: at["total"])
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("int")).when(s.rlike("^[IVXLC]+$"), F.when(roman > 0, roman))


# Fixed values.
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
STORE_NAME = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$"
EMBEDDING_MODELS = ["embed", "embedding", "bge", "e5", "gte", "mxbai", "nomic-embed", "all-minilm"]


def is_run_id(name: Column) -> Column:
    """Letters, digits and . _ - from a letter or digit on, without two dots in a row."""
    s = F.trim(name)
    return s.rlike(RUN_ID) & ~s.contains("..")


def is_store_name(name: Column) -> Column:
    return F.trim(name).rlike(STORE_NAME)


def is_embedding_model(name: Column) -> Column:
    """Whether a model's name holds one of the usual keywords."""
    return F.lower(F.trim(name)).rlike("|".join(EMBEDDING_MODELS))


def model_variants(name: Column) -> Column:
    """A model's name with and without its tag; one without gets "latest"."""
    s = F.trim(name)
    return F.array(s, F.when(s.contains(":"), F.substring_index(s, ":", 1)).otherwise(F.concat(s, F.lit(":latest"))))


def is_diagram(width: Column, height: Column, least: float = 100, most_ratio: float = 8.0) -> Column:
    """Whether an image is large and not too narrow to be a diagram."""
    if least < 1:
        raise ValueError("least must be at least 1")
    return (width >= least) & (height >= least) & (F.greatest(width, height) / F.greatest(F.lit(1.0), F.least(width, height)) <= most_ratio)
