"""Text expressions: every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that Java, RE2 and Python read alike.
WORD = r"[\p{L}\p{N}_]+"
BLANK = r" \t\n\r\f"
SPACED_TOKEN = rf"[^{BLANK}]+[{BLANK}]*"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def words(text: Column) -> Column:
    """Lower-cased Unicode word runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{BLANK}]+$", "")


def collapse(text: Column) -> Column:
    """Every run of blanks becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{BLANK}]+", " "))


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, '' if the base name has none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def glob_regex(pattern: str) -> str:
    """Shell pattern as an anchored regular expression (case-sensitive)."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = end + 1
        else:
            out.append(c if c.isalnum() or c in "_/ " else "\\" + c)
    return "(?s)^(?:" + "".join(out) + ")$"


def matches_any(name: Column, patterns: list[str] | str) -> Column:
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    cond = F.lit(False)
    for pattern in patterns:
        cond = cond | name.rlike(glob_regex(pattern))
    return cond


# Tags that end a line of text.
BLOCK_TAGS = (
    "p|div|br|hr|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|main|"
    "title|head|body|html|blockquote|pre"
)
# Entity to character; the ampersand comes last.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&middot;": "·",
    "&copy;": "©",
    "&ndash;": "–",
    "&mdash;": "—",
    "&hellip;": "…",
    "&amp;": "&",
}


def html_text(html: Column) -> Column:
    """Readable text of a web page: one line per block element."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(?:script|style)\b.*?</(?:script|style)[^>]*>", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return strip(t)


def first_sentence(text: Column) -> Column:
    """Up to the first sentence mark in the first 500 characters, else 200 characters."""
    head = F.replace(F.substring(text, 1, 500), F.lit("\n"), F.lit(" "))
    sentence = F.regexp_extract(head, r"(?s)^(.*?[.!?])[ \t\r\f]", 1)
    return strip(F.when(sentence != "", sentence).otherwise(F.substring(head, 1, 200)))


def slug(title: Column) -> Column:
    s = F.regexp_replace(title, r"[^A-Za-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 80)
    return F.when(s == "", F.lit("article")).otherwise(s)


def first_number(reply: Column) -> Column:
    """First unsigned decimal number in the text, else 0.0."""
    number = F.regexp_extract(reply, r"[0-9]+(?:\.[0-9]+)?", 0)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def sub_queries(reply: Column, query: Column, limit: int) -> Column:
    """The question followed by at most ``limit`` cleaned reply lines."""
    def clean(line: Column) -> Column:
        line = F.regexp_replace(strip(line), r"^[-*]+|[-*]+$", "")
        return strip(F.regexp_replace(line, r"^[0-9.) ]+", ""))

    own = F.lower(strip(query))
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), LINE_BREAK), clean)
    kept = F.filter(lines, lambda x: (x != "") & (F.lower(x) != own))
    return F.concat(F.array(query), F.slice(kept, 1, limit))
