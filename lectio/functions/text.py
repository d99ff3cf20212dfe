"""Text functions, Column -> Column, evaluated in the JVM.

Patterns that Spark and a SQL oracle share avoid look-around and ask for Unicode classes by name,
since \\w and \\d are ASCII in Java.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

# Fixed values that results depend on: patterns, then word lists.
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
SENTENCE_END = r"""([.!?]["')\]]*\s+|\n{2,})"""
EXOTIC_SPACES = r"[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ROMAN = "^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
EDGE_SPACE = r"^\s+|\s+$"
_ALONE_BEFORE, _ALONE_AFTER = r"(?<![\p{L}\p{N}_-])", r"(?![\p{L}\p{N}_-])"
STANDALONE = f"{_ALONE_BEFORE}([A-Za-z]{{2,}}){_ALONE_AFTER}"
COMPOUND = f"{_ALONE_BEFORE}([A-Za-z]+-[A-Za-z]+){_ALONE_AFTER}"
HYPHEN_BREAK = r"([A-Za-z]+)-\n([a-z][A-Za-z]*)"
CITATION_ANY_BRACKET = r"[【〔［]\s*([\d\s,]+?)\s*[】〕］]"
CITATION = r"\[\s*([\d\s,]+?)\s*\]"
CITATION_STRICT = r"\[\d+(?:\s*,\s*\d+)*\]"
FUNCTION_WORDS = (
    "a an and are as at be been but by for from had has have in into is it its "
    "of on or that the this to was were which with not no than then they their "
    "these those there here when where who whom how what why can could may might "
    "must shall should will would do does did done using used use also such each "
    "any all both more most other some only own same so too very s t don now"
).split()
REFERRING_WORDS = (
    "it its they them their that those this these he him his she her one ones "
    "there both former latter same other another"
).split()
CONTINUATIONS = ["and", "but", "or", "so", "then", "also", "plus"]
HEADING_BAD_TAIL = ["and", "or", "the", "of", "a", "an", "with", "to", "for", "is", "are"]
#: The answer that says there is none.
REFUSAL = "The documents at hand hold no answer to this question."


def words_literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def squeeze(c: Column) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def each_match(text: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """regexp_replace with a function of the match in place of a template."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, F.transform(hits, replace), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def token_count(c: Column) -> Column:
    """A stand-in for a model's tokenizer: words and single marks. Adds up over spans."""
    return F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))


def sentences(c: Column) -> Column:
    """The text cut behind sentence ends and at blank lines; the parts make up the whole text."""
    return F.split(F.regexp_replace(c, SENTENCE_END, "$1\u0001"), "\u0001", -1)


def normalize_whitespace(c: Column, from_layout: Column | bool = True) -> Column:
    flag = from_layout if isinstance(from_layout, Column) else F.lit(from_layout)
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), EXOTIC_SPACES, " ")
    laid = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), r"(?m)^[^\S\n]+|[^\S\n]+$", "")
    written = F.regexp_replace(c, r"(?m)[^\S\n]+$", "")
    return strip(F.regexp_replace(F.when(flag, laid).otherwise(written), "\n{3,}", "\n\n"))


def mask_line(c: Column) -> Column:
    """One form for lines that differ in page numbers, roman ones included, and padding."""
    c = F.regexp_replace(F.lower(strip(c)), "[ \t]+", " ")
    return F.when((c != "") & c.rlike(ROMAN), "#").otherwise(F.regexp_replace(c, r"\p{Nd}+", "#"))


def words_ran_together(c: Column, config: Config = DEFAULT) -> Column:
    words = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    long = F.size(F.filter(words, lambda w: F.length(w) > config.runon_word_length))
    return (F.size(words) > 0) & (long > config.runon_max_fraction * F.size(words))


def standalone_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(STANDALONE), F.lit(1)))


def compounds(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(COMPOUND), F.lit(1)))


def hyphen_breaks(c: Column) -> Column:
    """Words broken at a line end, as they stand in the text."""
    return F.regexp_extract_all(c, F.lit(HYPHEN_BREAK), F.lit(0))


def replace_breaks(c: Column, words: Column) -> Column:
    """The text with its hyphen breaks replaced, in order, by an array of words."""
    return F.array_join(F.zip_with(F.split(c, HYPHEN_BREAK, -1), words, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def needs_condensing(c: Column, config: Config = DEFAULT) -> Column:
    """Whether a question leans on an earlier turn."""
    words = F.filter(F.split(squeeze(c), " "), lambda w: w != "")
    words = F.transform(words, lambda w: F.lower(F.regexp_replace(w, "^[.,!?;:]+|[.,!?;:]+$", "")))
    return (F.size(words) > 0) & (
        F.get(words, 0).isin(CONTINUATIONS) | (
            F.size(words) <= config.short_question_words
        ) | F.arrays_overlap(words, words_literal(REFERRING_WORDS))
    )


def normalize_citations(c: Column) -> Column:
    return each_match(
        c,
        CITATION_ANY_BRACKET,
        lambda m: F.concat(F.lit("["), squeeze(F.regexp_extract(m, CITATION_ANY_BRACKET, 1)), F.lit("]")),
    )


def cited_markers(c: Column) -> Column:
    groups = F.regexp_extract_all(c, F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(numbers, lambda n: n.try_cast("int")), lambda n: n.isNotNull())))


def clean_lines(c: Column) -> Column:
    """A model's reply as lines without list markers and quotes. A marker needs a blank behind it,
    so that "3.5 turbo" and "-Xmx" keep their first characters."""
    lines = F.transform(
        F.split(c, "\r\n|\r|\n"),
        lambda line: strip(
            F.regexp_replace(strip(F.regexp_replace(line, r"^\s*(?:[-*•]|\d+[.)])\s+", "")), '^"+|"+$', "")
        ),
    )
    return F.filter(lines, lambda line: line != "")


def content_words(c: Column) -> Column:
    return F.array_except(tokenize(F.regexp_replace(c, CITATION_STRICT, " ")), words_literal(FUNCTION_WORDS))


def verdicts(reply: Column) -> tuple[Column, Column]:
    """Numbers of supported and unsupported claims in a judge's reply."""
    lines = F.transform(F.split(reply, "\r\n|\r|\n"), lambda line: F.upper(F.regexp_replace(line, r"^[-*•\s]+", "")))
    return F.size(F.filter(lines, lambda x: x.startswith("SUPPORTED"))), F.size(F.filter(lines, lambda x: x.startswith("UNSUPPORTED")))


def confidence(score: Column, method: Column, config: Config = DEFAULT) -> Column:
    """A score that no judge gave is medium at best."""
    band = F.when(score >= config.confidence_high, "high").when(score >= config.confidence_medium, "medium").otherwise("low")
    return F.when(score.isNull(), None).when((method != "judge") & (band == "high"), "medium").otherwise(band)


def slug(name: Column) -> Column:
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.when(cut == "", "doc").otherwise(cut)


def document_id(name: Column, content: Column) -> Column:
    return F.concat(slug(name), F.lit("-"), F.substring(F.sha2(content, 256), 1, 8))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def similarity(dot: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))


def l2_normalize(v: Column) -> Column:
    doubles = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(doubles, lambda x: x / norm)).otherwise(doubles)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def word_start(text: Column, position: Column, limit: Column) -> Column:
    """The first word start at or after a 0-based position, not beyond limit."""
    rest = F.substring(text, position + 1, limit - position)
    inside = (position > 0) & (position < limit) & ~F.substring(text, position, F.lit(1)).rlike(r"\s")
    return F.when(inside, position + F.length(F.regexp_extract(rest, r"^\S*\s*", 0))).otherwise(position)
