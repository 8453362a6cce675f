"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore; alike in the JVM, RE2 and Python up to newly added scripts.
TOKEN = r"[\p{L}\p{N}_]+"

# Lower-cased markers of an answer that declines.
REFUSAL_MARKERS = (
    "i do not have enough information",
    "i don't have enough information",
    "i could not find anything",
    "je ne dispose pas",
    "je n'ai pas suffisamment",
    "je ne trouve rien",
)

# Patterns of planted instructions, tried in this order.
INJECTION_PATTERNS = {
    "override": r"(?i)\b(ignore|disregard|forget)\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier)\s+(instructions|rules|prompts?)\b",
    "prompt_probe": r"(?i)\b(reveal|print|repeat|show|output)\s+(your|the)\s+(full\s+)?(system\s+prompt|instructions)\b",
    "role_marker": r"(?im)^\s*(system|assistant)\s*:",
}

# A citation marker and the numbers in it.
CITATION = r"\[[ \t]*(\d{1,3}(?:[ \t]*[,;–-][ \t]*\d{1,3})*)[ \t]*\]"


# Letters that a letter-by-letter upper case, as of SQL, leaves as they are, and those that it gives another one letter,
# where the JVM's writes several letters (STRASSE) or knows a newer alphabet.
_PLACES = (0xDF, 0x149, 0x19B, 0x1F0, 0x264, 0x390, 0x3B0, 0x587, 0x1C8A, *range(0x1E96, 0x1E9B), *range(0x1F50, 0x1F58, 2), *range(0x1F80, 0x1FB0), 0x1FB2, 0x1FB3, 0x1FB4, 0x1FB6, 0x1FB7, 0x1FBC, 0x1FC2, 0x1FC3, 0x1FC4, 0x1FC6, 0x1FC7, 0x1FCC)
_PLACES += (0x1FD2, 0x1FD3, 0x1FD6, 0x1FD7, 0x1FE2, 0x1FE3, 0x1FE4, 0x1FE6, 0x1FE7, 0x1FF2, 0x1FF3, 0x1FF4, 0x1FF6, 0x1FF7, 0x1FFC, 0xA7CD, 0xA7DB, *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), *range(0x10D70, 0x10D86))
_OTHERS = {0xDF: 0x1E9E, 0x1FB3: 0x1FBC, 0x1FC3: 0x1FCC, 0x1FF3: 0x1FFC, **{a + k: a + k + 8 for a in (0x1F80, 0x1F90, 0x1FA0) for k in range(8)}}
SINGLE = "".join(map(chr, _PLACES))
SINGLE_UPPER = "".join(chr(_OTHERS.get(c, c)) for c in _PLACES)


def upper(text: Column) -> Column:
    """Upper case letter by letter: a text keeps its length, and every offset into it its place."""
    parts = F.split(text, f"(?<=[{SINGLE}])|(?=[{SINGLE}])", -1)
    mixed = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{SINGLE}]$"), F.translate(p, SINGLE, SINGLE_UPPER)).otherwise(F.upper(p))), "")
    return F.when(text.rlike(f"[{SINGLE}]"), mixed).otherwise(F.upper(text))


def tokens(text: Column) -> Column:
    """Lower-cased words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def collapse(text: Column) -> Column:
    """White space runs become one space; case is kept."""
    return F.trim(F.regexp_replace(text, r"[\s\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " "))


def doc_type(path: Column) -> Column:
    """First folder of a relative path, or ``root``."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("root")


def injection(text: Column) -> Column:
    """Name of the first pattern that a text matches, else null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(INJECTION_PATTERNS.items()):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def is_refusal(answer: Column) -> Column:
    low = F.lower(answer)
    hit = F.lit(False)
    for marker in REFUSAL_MARKERS:
        hit = hit | F.contains(low, F.lit(marker))
    return hit


def parse_queries(text: Column, limit: int) -> Column:
    """Queries of a model's answer, one a line: a bullet or number and quotes go, blank lines and preambles are left out."""

    def clean(line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, r"^\s*(?:\d+[.)]|[-*•])\s*", ""))
        return F.trim(F.regexp_replace(F.regexp_replace(bare, "^[\"']+", ""), "[\"']+$", ""))

    lines = F.transform(F.split(text, "\r\n|[\n\r]"), clean)
    return F.slice(F.filter(lines, lambda s: (s != "") & ~s.endswith(":")), 1, limit)


def strip_html(html: Column) -> Column:
    """Comments, images and tags out, links to their text, trailing blanks and empty lines folded."""
    for pattern, to in (
        (r"(?s)<!--.*?-->", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"</?(?!https?:)[a-zA-Z][^<>]*>", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)[ \t]+$", ""),
        (r"\n{3,}", "\n\n"),
    ):
        html = F.regexp_replace(html, pattern, to)
    return F.trim(html)


def cost_usd(prompt_tokens: Column, completion_tokens: Column, usd_in: float | None, usd_out: float | None) -> Column:
    """Price of a call, null unless both prices are known."""
    if usd_in is None or usd_out is None:
        return F.lit(None).cast("double")
    return (F.coalesce(prompt_tokens, F.lit(0)) * usd_in + F.coalesce(completion_tokens, F.lit(0)) * usd_out) / 1_000_000
