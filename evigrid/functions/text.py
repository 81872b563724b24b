"""Words, stems and terms as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, words about the question, suffixes with their replacements.
STOPWORDS = """
a about after all allow allowed also an and any are as at be been before but by can could did do
does done for from had has have how i if in into is it its last many may me more most much my no not
of on or our over same should so some than that the their them then there these they this to under
up use used uses using was we were what when where which while who why will with would you your
service services s new get got""".split()
META_WORDS = """
true false claim include includes say says said given apply applies applied skill skills code
doc docs page pages wiki disagree disagreement agree environment branch release production prod
experiment experimental version""".split()
SUFFIXES = (("ization", ""), ("ation", ""), ("ize", ""), ("ies", "y"), ("ied", "y"), ("ing", ""), ("es", ""), ("ed", ""), ("s", ""))


@cache
def _bare_letters() -> tuple[str, str]:
    """All letters (of alphabets, up to U+2FFF) that are another letter and marks, with that letter; then the marks themselves, which have no counterpart."""
    letters, marks = {}, []
    for code in range(0xC0, 0x3000):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif c.isalpha():
            base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
            if len(base) == 1 and base[0] != c:
                letters[c] = base[0]
    return "".join([*letters, *marks]), "".join(letters.values())


def without_marks(text: Column) -> Column:
    """Letters of any script without accents and other marks."""
    return F.translate(text, *_bare_letters())


def words(text: Column) -> Column:
    """ASCII words, camel case split, lower-cased. Only a text with camel case pays for its splitting."""
    split = F.when(text.rlike("[a-z0-9][A-Z]"), F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")).otherwise(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(F.lower(split), F.lit("[a-z0-9]+"), F.lit(0))


def stem(token: Column) -> Column:
    """The first listed suffix that leaves three letters is replaced."""
    out = token
    for suffix, put in reversed(SUFFIXES):
        cut = F.concat(F.substring(token, F.lit(1), F.length(token) - len(suffix)), F.lit(put))
        out = F.when(token.endswith(suffix) & (F.length(token) - len(suffix) >= 3), cut).otherwise(out)
    return out


def forms(term: str) -> set[str]:
    """All tokens that could have a term as their stem."""
    return {term, *(term.removesuffix(put) + suffix for suffix, put in SUFFIXES if term.endswith(put))}


def content_terms(text: Column) -> Column:
    """Distinct stems of words that are neither stop words nor numbers, in order."""
    kept = F.filter(words(text), lambda w: ~w.isin(STOPWORDS) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(kept, stem))


def subject_terms(text: Column) -> Column:
    """Content terms outside parentheses that are not words about the question."""
    return F.array_except(content_terms(F.regexp_replace(text, r"\([^)]*\)", " ")), F.transform(F.array(*(F.lit(w) for w in META_WORDS)), stem))


def inflections(token: Column) -> Column:
    """The other form of a word in a literal index: ies and y, with and without s."""
    plain, n = F.substring(token, F.lit(1), F.length(token) - 1), F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("y") & (n > 3), F.when(~token.endswith("ies"), F.concat(plain, F.lit("ies"))))
        .when(token.endswith("s") & ~token.endswith("ss") & (n > 3), plain)
        .when((n > 2) & ~token.rlike("^[0-9]+$"), F.concat(token, F.lit("s")))
    )


# The same for DuckDB, whose regular expressions have no look-behind.
def sql_words(text: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"


def sql_stem(token: str) -> str:
    cases = " ".join(f"WHEN ends_with({token}, '{s}') AND length({token}) - {len(s)} >= 3 THEN left({token}, length({token}) - {len(s)}) || '{put}'" for s, put in SUFFIXES)
    return f"(CASE {cases} ELSE {token} END)"


SQL_STOPWORDS = ", ".join(f"'{w}'" for w in STOPWORDS)
