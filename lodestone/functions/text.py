"""Text shaping and query terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a keyword query leaves out.
STOP_WORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with how what where when why do does i me".split()
)

# The kinds of identifier in a query (camel, Pascal, snake case, dotted paths, codes, capitals, versions).
IDENTIFIERS = (
    r"\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+\b",
    r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b",
    r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b",
    r"\b[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+\b",
    r"\b[A-Z]{2,}(?:[._-]?[0-9]+)+\b",
    r"\b[A-Z]{3,}\b",
    r"\bv?\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9.]+)?\b",
)
_EDGE = r"[ \t\n\x0B\f\r\x{00A0}]+"


def identifiers(query: str) -> list[str]:
    """Identifiers and quoted phrases of a query, of two characters at least, in order, each once."""
    found = [m for p in IDENTIFIERS for m in re.findall(p, query, re.ASCII)]
    found += [x.strip() for x in re.findall(r'"([^"]+)"', query)]
    return list(dict.fromkeys(x for x in found if len(x) > 1))


def terms(query: str) -> list[str]:
    """The query's distinct words of more than one character, lower-cased."""
    return list(dict.fromkeys(x for x in re.split(r"[^a-z0-9_.]+", query.strip().lower()) if len(x) > 1))


def keywords(query: str) -> list[str]:
    """The terms without stop words, unless an identifier is one."""
    keep = {x.lower() for x in identifiers(query)}
    return [t for t in terms(query) if t not in STOP_WORDS or t in keep]


def terms_of(query: Column) -> Column:
    """``terms`` of a column of queries."""
    return F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9_.]+"), lambda x: F.length(x) > 1))


def identifiers_of(query: Column) -> Column:
    """``identifiers`` of a column of queries."""
    quoted = F.transform(F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.trim(x))
    found = F.concat(*(F.regexp_extract_all(query, F.lit(p), F.lit(0)) for p in IDENTIFIERS), quoted)
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def keywords_of(query: Column) -> Column:
    """``keywords`` of a column of queries."""
    keep = F.transform(identifiers_of(query), lambda x: F.lower(x))
    return F.array_except(terms_of(query), F.array_except(F.array(*map(F.lit, sorted(STOP_WORDS))), keep))


def tokens(text: Column) -> Column:
    """A text's words as the keyword index sees them."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_.]+"), lambda x: x != "")


def trim(text: Column) -> Column:
    """Without white space at both ends, all kinds of it."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_EDGE}", ""), f"{_EDGE}$", "")


def truncate(text: Column, n: int, keep: str = "middle") -> Column:
    """At most n characters of a longer text, and a mark: its head, its tail, or both without the middle."""
    if n <= 0:
        return text
    if keep == "head":
        cut = F.concat(F.substring(text, 1, n), F.lit(" …"))
    elif keep == "tail":
        cut = F.concat(F.lit("… "), F.substring(text, -n, n))
    else:
        room = n - 3
        if room <= 0:
            return F.when(F.length(text) <= n, text).otherwise(F.substring(text, 1, n))
        head, tail = -(-room // 2), room // 2
        end = F.substring(text, -tail, tail) if tail else F.lit("")
        cut = F.concat(F.substring(text, 1, head), F.lit("\n…\n"), end)
    return F.when(F.length(text) <= n, text).otherwise(cut)


# What is cut or replaced in markup, in this order.
MARKUP = (
    (r"(?is)<script.*?</script>", ""),
    (r"(?is)<style.*?</style>", ""),
    (r"(?s)<[^>]+>", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&nbsp;", " "),
    (r"[ \t\n\x0B\f\r\x{00A0}]{2,}", " "),
)


def strip_markup(html: Column) -> Column:
    """The text of a page: scripts, styles and tags cut, common entities decoded once, white space squeezed."""
    for pattern, by in MARKUP:
        html = F.regexp_replace(html, pattern, by)
    return trim(html)


def strip_markup_sql(html: str) -> str:
    for pattern, by in MARKUP:
        flags = "g" + "".join(sorted(set(re.match(r"\(\?(\w+)\)", pattern)[1]) if pattern.startswith("(?") else ""))
        body = re.sub(r"^\(\?\w+\)", "", pattern).replace("'", "''")
        html = f"regexp_replace({html}, '{body}', '{by.replace(chr(39), chr(39) * 2)}', '{flags}')"
    return f"regexp_replace(regexp_replace({html}, '^{_EDGE}', ''), '{_EDGE}$', '')"


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def whole_word(text: Column, word: str) -> Column:
    """Whether the text has the word, in either case, not as a part of a longer one (ASCII letters, digits, _)."""
    return text.rlike(f"(?i)(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")


def whole_word_sql(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(^|[^A-Za-z0-9_]){re.escape(word)}([^A-Za-z0-9_]|$)', 'i')"


def chunk_id(project: Column, path: Column, start: Column, end: Column, raw: Column) -> Column:
    """The stable id of a chunk: where it stands and the first 16 digits of its content's hash."""
    return F.sha2(F.concat_ws("|", project, path, start.cast("string"), end.cast("string"), F.substring(F.sha2(raw, 256), 1, 16)), 256)
