"""Extraction, normalisation, redaction and licence rules as column expressions.

Rules are data: ordered (name, pattern, replacement) entries that are folded into one expression.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and lists that decide results.
TAG = r"<[^>\n]{1,80}>"
ENTITY = r"&(?:[a-zA-Z]{2,10}|#\d{2,5}|#x[0-9a-fA-F]{2,5});"
BOILERPLATE = (
    r"^\s*(home|about( us)?|contact( us)?|privacy policy|terms( (of|&) (use|service))?|"
    r"copyright ©?.*|cookie policy|subscribe|read more)\s*$"
)
NOISE = {
    0xFEFF: "bom", 0x200B: "zero_width_space", 0x200E: "ltr_mark", 0x200F: "rtl_mark", 0x00AD: "soft_hyphen", 0x2060: "word_joiner",
    0x202A: "lre", 0x202B: "rle", 0x202C: "pdf", 0x202D: "lro", 0x202E: "rlo", 0x2066: "lri", 0x2067: "rli", 0x2068: "fsi", 0x2069: "pdi",
    0xFFFD: "replacement",
}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
PRIVATE_USE = r"[\uE000-\uF8FF]"
JOINERS = r"[\u200C\u200D]"
GHOST_MARKS = (
    r"(?i)\[(USER|ASSISTANT|SYSTEM|HUMAN|BOT)\]",
    r"(?i)<\|(user|assistant|system|im_start|im_end|endoftext)\|>",
    r"(?i)###\s*(Human|Assistant)\s*:",
    r"(?i)</?(human|bot|assistant|user|system)>",
)
ROLE_NAMES = {"user": ("user", "human", "instruction"), "assistant": ("assistant", "bot", "response"), "system": ("system",)}
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:(?:\+91|91|0)[\s\-]?)?\b([6-9]\d{9})\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
PII_RULES = (
    ("email", EMAIL, "[EMAIL]"),
    ("phone", PHONE, "[PHONE]"),
    ("ip", IPV4, "[IP]"),
)
ADMISSION_PII_RULES = (
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<redacted:email>"),
    ("aadhaar", r"(?<![\d-])\d{4} ?\d{4} ?\d{4}(?![\d-])", "<redacted:aadhaar>"),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", "<redacted:pan>"),
    ("phone", r"(?<!\d)(?:\+?91[ -]?)?[6-9]\d{9}(?!\d)", "<redacted:phone>"),
    ("ipv4", r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)", "<redacted:ip>"),
)
ALLOWED_LICENSES = ("cc-by-4.0", "apache-2.0", "mit", "cc0-1.0", "odc-by")
COPYLEFT_LICENSES = ("agpl-3.0", "gpl-3.0", "gpl-2.0", "lgpl-3.0")

_PROTECTED = re.compile(r"```.*?```|`[^`\n]{1,200}`|(?i:<\|[a-z_]{1,20}\|>)", re.DOTALL)
HIGH_CONFIDENCE_NAMES = (
    "రాజేష్", "సురేష్", "లక్ష్మి", "ప్రియ", "వెంకటేష్", "శ్రీను", "మహేష్", "నరేష్", "కిరణ్", "అనిత", "సునీత", "పద్మ", "శ్రీనివాస్", "వెంకట్",
    "రజనీకాంత్", "చిరంజీవి", "పవన్", "నాగార్జున", "బాలకృష్ణ", "సునీల్",
)
AMBIGUOUS_NAMES = ("రాజు", "బాబు", "అమ్మ", "చిన్ని")
NAME_MARK = "[NAME]"

Rule = tuple[str, str, str]


def name_pattern() -> str:
    """One alternation of all listed names, the longest first, so that a name never loses to a shorter one that begins it."""
    return "|".join(sorted((*HIGH_CONFIDENCE_NAMES, *AMBIGUOUS_NAMES), key=lambda n: (-len(n), n)))


def names_found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(name_pattern()), F.lit(0))


def redact_names(text: Column) -> Column:
    return F.regexp_replace(text, name_pattern(), NAME_MARK)


def apply_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """Each rule rewrites what the previous one left."""
    return functools.reduce(lambda t, r: F.regexp_replace(t, r[1], r[2]), rules, text)


def rule_counts(text: Column, rules: Sequence[Rule]) -> dict[str, Column]:
    """Matches of each rule in the text that it sees, after the rules before it."""
    counts, now = {}, text
    for name, pattern, replacement in rules:
        counts[name] = F.regexp_count(now, F.lit(pattern)).cast("long")
        now = F.regexp_replace(now, pattern, replacement)
    return counts


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def drop_boilerplate_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike("(?i)" + BOILERPLATE)), "\n")


def boilerplate_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike("(?i)" + BOILERPLATE))).cast("long")


def page_body(html_text: Column) -> Column:
    """Markup without scripts, styles, comments and meta elements."""
    for element in ("script", "style"):
        html_text = F.regexp_replace(html_text, f"(?is)<{element}.*?</{element}>", "")
    return F.regexp_replace(html_text, "(?is)<!--.*?-->|<meta[^>]*>", "")


def visible_text(html_text: Column) -> Column:
    """Words of a page outside scripts, styles and tags, joined by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(page_body(html_text), "(?s)<[^>]*>", " "), r"[ \t\n\r]+", " "))


def absolute_link(href: Column, base: Column) -> Column:
    """A link made absolute against scheme and host of its page."""
    origin = F.concat(F.lit("https://"), base)
    return (
        F.when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("./"), F.concat(origin, F.lit("/"), F.substr(href, F.lit(3))))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(href)
    )


def tidy_markdown(text: Column) -> Column:
    """No-break spaces as spaces, no trailing blanks, at most three line ends in a row."""
    return apply_rules(text, (("nbsp", "\u00a0", " "), ("trailing", r"(?m)[ \t]+$", ""), ("newlines", r"\n{4,}", "\n\n\n")))


def noise_counts(text: Column) -> dict[str, Column]:
    return {name: F.length(text) - F.length(F.replace(text, F.lit(chr(cp)), F.lit(""))) for cp, name in NOISE.items()}


def strip_noise(text: Column) -> Column:
    """Without invisible format characters, control characters and private-use characters; joiners stay."""
    text = F.translate(text, "".join(map(chr, NOISE)), "")
    return F.regexp_replace(F.regexp_replace(text, CONTROL, ""), PRIVATE_USE, "")


def collapse_space(text: Column) -> Column:
    """Runs of blanks as one space, at most one empty line in a row, no white space at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\u00a0]{2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def ghost_marks(text: Column) -> Column:
    """Number of chat markers of any dialect."""
    return functools.reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in GHOST_MARKS]).cast("long")


def ghost_rules() -> list[Rule]:
    """Rewrites of every dialect's markers to <|role|> and <|end|>, in the order in which they apply."""
    rules: list[Rule] = []

    def per_role(dialect: str, pattern: str, names: set[str], after: str = "", flags: str = "(?i)"):
        for role, known in ROLE_NAMES.items():
            use = [n for n in known if n in names]
            if use:
                shown = [n.upper() for n in use] if flags == "(?m)" else use
                rules.append((dialect, flags + pattern.replace("ROLE", "(?:" + "|".join(shown) + ")"), f"<|{role}|>{after}"))

    turn, chat = {"user", "assistant", "system"}, {"user", "assistant", "system", "human", "bot"}
    per_role("im_start", r"<\|im_start\|>[ \t]*ROLE\b", turn)
    rules.append(("im_end", r"(?i)<\|im_end\|>", "<|end|>"))
    rules.append(("endoftext", r"(?i)<\|endoftext\|>", "<|end|>"))
    per_role("bracket", r"\[ROLE\]", chat)
    per_role("hash", r"###[ \t]*ROLE[ \t]*:", {"human", "assistant", "instruction", "response"})
    per_role("xml", r"</?ROLE>", chat)
    per_role("prefix", r"^ROLE[ \t]*:[ \t]*", turn, " ", "(?m)")
    return rules


def unify_ghost_marks(text: Column) -> Column:
    return apply_rules(text, ghost_rules())


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def strip_markup_outside_code(text: pd.Series) -> pd.Series:
    """Tags become spaces, except in code fences, inline code and chat markers."""
    tag = re.compile(TAG)

    def clean(t):
        if t is None:
            return None
        out, at = [], 0
        for m in _PROTECTED.finditer(t):
            out += [tag.sub(" ", t[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, tag.sub(" ", t[at:])])

    return text.map(clean)


@F.pandas_udf(T.StringType())
def collapse_space_outside_code(text: pd.Series) -> pd.Series:
    """collapse_space that leaves fenced code byte for byte as it is."""
    fence = re.compile(r"(```.*?```)", re.DOTALL)

    def clean(t):
        if t is None:
            return None
        parts = fence.split(t)
        parts[::2] = [re.sub("\n{3,}", "\n\n", re.sub("[ \t\u00a0]{2,}", " ", p)) for p in parts[::2]]
        return "".join(parts).strip()

    return text.map(clean)


def license_status(license_name: Column) -> Column:
    """CLEAN for names on the allow-list; BLOCKED_* for missing, copyleft and unknown ones."""
    name = F.lower(license_name)
    return (
        F.when(F.coalesce(license_name, F.lit("")) == "", "BLOCKED_MISSING")
        .when(license_name.isin(*COPYLEFT_LICENSES), "BLOCKED_COPYLEFT")
        .when(name.isin(*ALLOWED_LICENSES), "CLEAN")
        .otherwise("BLOCKED_UNKNOWN")
    )
