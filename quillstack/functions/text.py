"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations in journal titles and what they may stand for.
ABBREVIATIONS = (
    ("trans.", ("transactions",)), ("biomed.", ("biomedical",)), ("eng.", ("engineering",)), ("j.", ("journal",)), ("proc.", ("proceedings",)), ("int.", ("international",)),
    ("sci.", ("science", "sciences")), ("rev.", ("review", "reviews")), ("lett.", ("letters",)), ("comput.", ("computer", "computing", "computational")), ("med.", ("medicine", "medical")),
    ("phys.", ("physics", "physical")), ("chem.", ("chemistry", "chemical")), ("appl.", ("applied",)), ("res.", ("research",)), ("biol.", ("biology", "biological")), ("conf.", ("conference",)),
    ("symp.", ("symposium",)), ("ann.", ("annual", "annals")), ("eur.", ("european",)), ("am.", ("american",)), ("nat.", ("national", "nature", "natural")), ("tech.", ("technology", "technical")),
    ("syst.", ("systems",)), ("commun.", ("communications",)), ("electr.", ("electrical", "electronic", "electronics")), ("rehabil.", ("rehabilitation",)), ("neurosci.", ("neuroscience",)),
    ("cardiovasc.", ("cardiovascular",)), ("physiol.", ("physiology", "physiological")),
)
# Words in a heading that tell its section, in the order in which they count.
SECTION_WORDS = (
    ("results", ("result", "findings", "outcomes")),
    ("conclusion", ("conclusion", "concluding")),
    ("methods", ("method", "materials", "experimental", "procedure", "protocol", "design", "participants", "subjects")),
    ("abstract", ("abstract",)),
    ("background", ("background", "literature review", "related work")),
    ("discussion", ("discussion",)),
    ("introduction", ("introduction",)),
    ("appendix", ("appendix", "supplementa", "acknowledgment", "acknowledgement", "grant", "funding", "disclosure", "conflict of interest")),
    ("references", ("reference", "bibliography")),
)
SUMMARY_OF_RESULTS = ("statistics", "table", "data", "results summary")
# Control characters, and fonts that draw symbols with them.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SYMBOL_FONTS = r"(?i)symbol|greek|math|cmsy|cmex|cmmi|msam|msbm"
# Ligatures by code point.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized_title(c: Column) -> Column:
    """Lower case, ``& : - /`` as blanks, blanks collapsed."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(c), r"[&:\-/]", " "), r"(?U)\s+", " "))


def title_expansions(c: Column) -> Column:
    """All full forms of an abbreviated title, normalised: the first place of each abbreviation is replaced in every way."""
    forms = F.array(F.lower(c))
    for short, fulls in ABBREVIATIONS:
        forms = F.flatten(F.transform(forms, _replacer(short, fulls)))
    return F.array_distinct(F.transform(forms, normalized_title))


def _replacer(short: str, fulls: tuple[str, ...]):
    def replaced(e: Column) -> Column:
        at = F.locate(short, e)
        head, tail = F.substring(e, F.lit(1), at - 1), F.substring(e, at + len(short), F.length(e))
        return F.when(at > 0, F.array(*[F.concat(head, F.lit(full), tail) for full in fulls])).otherwise(F.array(e))

    return replaced


def heading_text(c: Column) -> Column:
    """A heading without marks of Markdown, section numbers and list letters."""
    c = F.regexp_replace(c, r"^#{1,6}\s*", "")
    c = F.regexp_replace(c, r"[*_]+", "")
    c = F.regexp_replace(stripped(c), r"^(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.)\s+", "")
    return stripped(F.regexp_replace(c, r"^\([a-z]\)\s*", ""))


def section_of(heading: Column) -> Column:
    """Section a heading opens, null if its words tell none. The heading is worked out once, however many words are looked for."""
    return F.get(F.transform(F.array(F.lower(heading)), _told), F.lit(0))


def _told(h: Column) -> Column:
    holds = lambda words: functools.reduce(lambda a, b: a | b, [F.contains(h, F.lit(w)) for w in words])
    found = F.when(F.lit(False), F.lit(""))
    for label, words in SECTION_WORDS:
        found = found.when(holds(words), F.lit(label))
    summary = F.contains(h, F.lit("summary"))
    return found.when(summary & holds(SUMMARY_OF_RESULTS), "results").when(summary, "conclusion")


def looks_numeric(c: Column) -> Column:
    return stripped(F.regexp_replace(c, "[*†‡§№]+", "")).rlike("^[0-9.−\\-+, ]+$")


def without_ligatures(c: Column) -> Column:
    for glyph, letters in LIGATURES:
        c = F.replace(c, F.lit(glyph), F.lit(letters))
    return c


def without_controls(c: Column, font: Column) -> Column:
    """Control characters dropped, unless the font (of the nearest text) draws symbols with them."""
    return F.when(F.coalesce(font.rlike(SYMBOL_FONTS), F.lit(False)), c).otherwise(F.regexp_replace(c, CONTROLS, ""))


def clean_cell(c: Column) -> Column:
    """A table cell: ligatures resolved, split minus signs and leading zeros of numbers restored, blanks and minus signs unified."""
    c = without_ligatures(c)
    t = stripped(c)
    split_decimal = r"^(\d+)\s*[−\-]\s*\.\s*(\d*).*$"
    negative = r"^[−\-]\s*(\d[\d.]*).*$"
    c = F.when(looks_numeric(c) & t.rlike(split_decimal), F.regexp_replace(t, split_decimal, "-$1.$2")).when(looks_numeric(c) & t.rlike(negative), F.regexp_replace(t, negative, "-$1")).otherwise(c)
    c = F.when(looks_numeric(c), F.regexp_replace(c, r"(^|(?<=\s))\.(\d)", "$10.$2")).otherwise(c)
    c = stripped(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), "  +", " "))
    return F.replace(c, F.lit("−"), F.lit("-"))


def clean_table(rows: Column) -> Column:
    return F.transform(rows, lambda row: F.transform(row, clean_cell))


def tokens(c: Column) -> Column:
    return F.filter(F.split(stripped(c), r"(?U)\s+"), lambda w: w != "")


def is_garbled(c: Column) -> Column:
    """Words without a hyphen are longer than 25 characters on average; Greek letters and signs of mathematics excuse it."""
    words = F.filter(tokens(c), lambda w: ~F.contains(w, F.lit("-")))
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    math = c.rlike("[Α-ω∀-⋿=±×÷²³]")
    return F.coalesce(~math & (F.size(words) > 0) & (total > 25 * F.size(words)), F.lit(False))


def is_interleaved(c: Column) -> Column:
    """More than two fifths of the tokens are single letters, in a cell of enough tokens."""
    words = tokens(c)
    single = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}$")))
    enough = F.size(words) >= F.greatest(F.lit(5), F.floor(F.length(c) / 10))
    return F.coalesce(enough & (single > 0.4 * F.size(words)), F.lit(False))


def has_ligatures(c: Column) -> Column:
    return F.coalesce(c.rlike("[ﬀ-ﬄ]"), F.lit(False))


def has_terms(c: Column, terms: list[str]) -> Column:
    """All terms stand in the text as whole words, whatever their case."""
    found = F.lit(True)
    for term in terms:
        found = found & c.rlike("(?iuU)\\b" + "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E" + "\\b")
    return found


def bare_doi(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^https?://(?:dx\.)?doi\.org/", "")


def year_prefix(c: Column) -> Column:
    """The number at the start of the first four characters, 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.substring(c, 1, 4), r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))


def author_label(count: Column, last: Column, first: Column, lead: Column) -> Column:
    """One author: last name and initial; several: the first one's last name and et al."""
    initial = F.when(F.coalesce(first, F.lit("")) != "", F.concat(F.lit(", "), F.substring(first, 1, 1), F.lit("."))).otherwise("")
    return F.when(count == 1, F.concat(last, initial)).otherwise(F.concat(lead, F.lit(" et al.")))

