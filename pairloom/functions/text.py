"""Scalar text functions as column expressions; all stay in the JVM.

A null is read as the text "None" wherever a value is turned into text (``as_text``), and elsewhere stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates tokens, the articles, the literals and entities, and the punctuation rules.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ARTICLES = ("a", "an", "the")
SPECIAL = ("<pad>", "</s>")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
PUNCTUATION = (
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def as_text(c: Column) -> Column:
    """Any value as text; null gives "None"."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    """The runs of characters between white space."""
    return F.filter(F.split(c, SPACE + "+"), lambda t: t != "")


def collapse(c: Column) -> Column:
    """Tokens joined by single spaces."""
    return F.array_join(tokens(c), " ")


def drop_literals(c: Column, literals=SPECIAL) -> Column:
    for x in literals:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def drop_punctuation(c: Column) -> Column:
    """Without the 32 ASCII punctuation characters; nothing takes their place."""
    return F.regexp_replace(c, r"\p{Punct}", "")


def drop_articles(c: Column) -> Column:
    """Each article that stands as a word of its own (letters, numbers and _ make words) becomes a space."""
    return F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(ARTICLES)})(?![\p{{L}}\p{{N}}_])", " ")


def normalise(c: Column) -> Column:
    """Lower case, without special literals, punctuation and articles, white space collapsed."""
    return collapse(drop_articles(drop_punctuation(drop_literals(F.lower(c)))))


def unescape(c: Column) -> Column:
    """The four entities as characters, the ampersand last."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def join_lines(c: Column) -> Column:
    """Without <skipped> marks and end-of-line hyphens; other line ends are spaces."""
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def split_punctuation(c: Column) -> Column:
    """Spaces around punctuation, except periods and commas between digits and hyphens not after one."""
    for pattern, new in PUNCTUATION:
        c = F.regexp_replace(c, pattern, new)
    return c


def scored_tokens(c: Column, *, preserve_case: bool = False, nonorm: bool = False, listed: bool = False) -> Column:
    """Tokens for the smoothed score; nonorm takes white space tokens as they are. With ``listed`` the column is an array of
    strings, joined by spaces first (nulls in it are left out); nonorm takes texts only."""
    if nonorm and listed:
        raise ValueError("nonorm takes texts, not lists")
    if nonorm:
        return tokens(c)
    c = joined(c) if listed else c
    c = F.concat(F.lit(" "), unescape(join_lines(c)), F.lit(" "))
    return tokens(split_punctuation(c if preserve_case else F.lower(c)))


def joined(c: Column) -> Column:
    """An array of strings as one string."""
    return F.array_join(c, " ")


def prefix(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def escape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("\\n"))
