"""Text scalars as Catalyst expressions: nothing here leaves whole-stage codegen but the
higher-order functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ranges in which every character is a token of its own.
CJK = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF"
# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Glyphs that open a list item.
BULLETS = "\\u2022\\u25E6\\u2023\\u00B7\\u2043\\u2219\\u2013\\u2014*-"
# Words that open a numbered section, and words that open a caption.
SECTION_WORDS = ("chapter", "section", "appendix")
CAPTION_WORDS = ("figure", "fig", "table", "tbl", "exhibit", "listing", "plate", "chart", "scheme", "equation", "eq")
#: A list number: up to three digits, one letter, or a Roman numeral of seven digits at most in one case.
LIST_NUMBER = "(?:[0-9]{1,3}|[A-Za-z]|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})"
_BULLET = f"^(?U:\\s*)[{BULLETS}](?U:\\s)"
_BRACKETED = f"(?:\\((?U:\\s*){LIST_NUMBER}(?U:\\s*)\\)|\\[(?U:\\s*){LIST_NUMBER}(?U:\\s*)\\])"
_NUMBERED = f"^(?U:\\s*)(?:{_BRACKETED}|{LIST_NUMBER}[.)])(?U:\\s)"


def estimate_tokens(text: Column) -> Column:
    """Tokens a text will take: a run of letters and digits counts (length + 2) div 4, one at
    least; every other visible character, and every CJK character, counts one."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"([\\p{{IsAlphabetic}}\\p{{N}}&&[^{CJK}]]+)"), F.lit(1))
    words = F.aggregate(F.transform(runs, lambda r: F.greatest(F.lit(1), F.floor((F.length(r) + 2) / 4).cast("int"))), F.lit(0).cast("long"), lambda a, x: a + x)
    rest = F.length(F.regexp_replace(text, f"(?U)[\\s\\p{{IsAlphabetic}}\\p{{N}}&&[^{CJK}]]", ""))
    return (words + rest).cast("long")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences: a break follows . ! or ? before white space."""
    parts = F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])(?=(?U)\\s)")
    return F.filter(F.transform(parts, lambda s: collapse_space(s)), lambda s: s != "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_hyphenated(text: Column) -> Column:
    """'exam- ple' -> 'example' where a lower-case letter goes on."""
    return F.regexp_replace(text, "(?U)(?<=\\p{IsAlphabetic})-\\s+(?=\\p{Lower})", "")


def expand_ligatures(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def running_key(text: Column) -> Column:
    """What a running header keeps from page to page: no digits, single spaces, lower case."""
    return collapse_space(F.regexp_replace(ascii_lower(text), "[0-9]", ""))


def digit_shape(text: Column) -> Column:
    """Digits become #, other letters lower case, runs of anything else one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "#"), "[^\\p{L}\\p{N}#]+", " "))


def search_key(text: Column) -> Column:
    """Normal form for search: end-of-line hyphens go, ligatures expand, space collapses."""
    return F.lower(collapse_space(expand_ligatures(F.regexp_replace(text, "-\\n", ""))))


def alnum_key(text: Column) -> Column:
    """ASCII letters and digits in lower case, one space between."""
    return F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))


def is_bullet(text: Column) -> Column:
    """A bullet, one white space and something else."""
    return text.rlike(f"{_BULLET}(?U:\\S)")


def is_enumerated(text: Column) -> Column:
    """(1) [a] 1. a) iv. and white space."""
    return text.rlike(_NUMBERED)


def is_section_heading(text: Column) -> Column:
    """A section word with a number or letter, or a dotted number of 12 characters at most, and
    white space."""
    return text.rlike(f"^(?U:\\s*)(?:(?i:{'|'.join(SECTION_WORDS)}) (?U:\\s*)[0-9A-Za-z]|[0-9][0-9.]{{0,11}}(?U:\\s))")


def is_caption(text: Column) -> Column:
    """A caption word, a dot or white space, and a digit or letter."""
    return text.rlike(f"^(?U:\\s*)(?i:{'|'.join(CAPTION_WORDS)})(?=\\.|(?U:\\s))\\.*(?U:\\s*)[0-9A-Za-z]")


def page_number(text: Column) -> Column:
    """The number of a line that is only a page number: 7, vii, page 7, 7 of 9, 7/9; null for others."""
    bare = F.regexp_replace(ascii_lower(text), "^(?U:\\s*)(?:page (?U:\\s*))?|(?U:\\s*)$", "")
    core = F.regexp_extract(bare, "^((?U:(?!/| of ).)*)", 1)
    core = F.regexp_replace(core, "(?U)^\\s+|\\s+$", "")
    roman = roman_value(core)
    return F.when(core.rlike("^[0-9]{1,12}$"), core.try_cast("long")).when((F.length(core) <= 12) & (roman > 0), roman.cast("long"))


def ends_sentence(text: Column) -> Column:
    return text.rlike("[.!?:]\\s*$")


def is_numeric_cell(text: Column) -> Column:
    """Digits and signs of numbers only, and a digit at least."""
    return text.rlike("^(?U:\\s*)(?=[^0-9]*[0-9])[-0-9.,+$%()/]+(?U:\\s*)$")


def strip_marker(text: Column) -> Column:
    """A list item without its bullet or number."""
    return F.regexp_replace(text, f"(?:{_BULLET}|{_NUMBERED})(?U:\\s*)", "")


def strip_heading_marks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "^#+", ""))


def heading_context(path: Column) -> Column:
    """['A', 'B'] -> '# A > ## B', six marks at most."""
    return F.array_join(F.transform(path, lambda t, i: F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), t)), " > ")


def roman_value(text: Column) -> Column:
    """Subtractive value of a Roman numeral; null if it is none."""
    at = F.create_map(*[F.lit(x) for pair in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in pair])
    digits = F.transform(F.filter(F.split(ascii_lower(text), ""), lambda c: c != ""), lambda c: at[c])
    after = F.concat(F.slice(digits, F.lit(2), F.greatest(F.size(digits), F.lit(1))), F.array(F.lit(0)))
    value = F.aggregate(F.zip_with(digits, after, lambda a, b: F.when(b > a, -a).otherwise(a)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(ascii_lower(text).rlike("^[ivxlcdm]+$"), value)


def escape_markdown(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, "([\\\\`*_\\[\\]<>|])", "\\\\$1"), "\n", " ")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def span_markdown(text: Column, bold: Column, italic: Column, link: Column) -> Column:
    """A span of text with its emphasis, inside of its link."""
    marks = F.concat(F.when(bold, "**").otherwise(""), F.when(italic, "*").otherwise(""))
    marked = F.concat(marks, escape_markdown(text), marks)
    address = F.replace(F.replace(link, F.lit(" "), F.lit("%20")), F.lit(")"), F.lit("%29"))
    return F.when(text == "", "").when(link.isNull(), marked).otherwise(F.concat(F.lit("["), marked, F.lit("]("), address, F.lit(")")))


# Raised digits and what they stand for, and other signs of footnotes.
RAISED = {"⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9"}
NOTE_SIGNS = "*†‡"


def footnote_mark(text: Column) -> Column:
    """The label of the first footnote sign inside of a line, or null."""
    sign = F.regexp_extract(text, f"([{''.join(RAISED)}{NOTE_SIGNS}])", 1)
    return F.when(sign != "", F.translate(sign, "".join(RAISED), "".join(RAISED.values())))


def footnote_label(text: Column) -> Column:
    """The label that a footnote's text opens with: a sign, or digits and white space, a dot or a bracket."""
    label = F.regexp_extract(text, f"^(?U:\\s*)(?:([{NOTE_SIGNS}])|([0-9]+)(?=(?U:\\s)|[.)\\]]|\\z))", 0)
    return F.nullif(F.regexp_replace(label, "(?U)\\s", ""), F.lit(""))


# Elements of tagged documents by the blocks they make, and those that make none.
PARAGRAPH_TAGS = ("P", "Note", "BlockQuote", "Quote")
BLOCK_TAGS = {"Title": "title", "L": "list", "LI": "list_item", "Figure": "figure", "Caption": "caption", "Table": "table"}
CONTAINER_TAGS = ("TOC", "TOCI", "Artifact", "Lbl", "LBody", "TR", "TH", "TD", "THead", "TBody", "TFoot")


def tag_block(tag: Column, text: Column, most_level: int = 6) -> Column:
    """struct(kind, level) of a tagged element, null for containers and for others without text."""
    level = F.regexp_extract(tag, "^H[+]?([0-9]{1,3})$", 1).try_cast("int")
    made = F.create_map(*[F.lit(x) for pair in BLOCK_TAGS.items() for x in pair])[tag]
    has_text = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s", "") != ""
    kind = F.when(made.isNotNull(), made).when((tag == "H") | (level <= 255), "heading").when(tag.isin(*CONTAINER_TAGS), None).when(tag.isin(*PARAGRAPH_TAGS) | has_text, "paragraph")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(tag == "H", 1).when(kind == "heading", F.least(F.greatest(level, F.lit(1)), F.lit(most_level))).alias("level")))


def csv_quote(text: Column) -> Column:
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def safe_filename(path: Column) -> Column:
    """The last path component without control and separator characters."""
    last = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    name = F.trim(F.regexp_replace(last, "[\\x00-\\x1F\\x7F:]", ""))
    return F.when(name.rlike("^\\.*$"), F.lit("attachment.bin")).otherwise(name)


def rtl_share(text: Column) -> Column:
    """Share of right-to-left letters among all letters."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    rtl = F.length(F.regexp_replace(text, "[^\\u0590-\\u08FF\\uFB1D-\\uFDFF\\uFE70-\\uFEFF]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(rtl / letters)


def script(text: Column) -> Column:
    """The script of the first letter that tells one."""
    return (
        F.when(text.rlike("[\\u3040-\\u30FF]"), "ja").when(text.rlike("[\\uAC00-\\uD7AF]"), "ko").when(text.rlike("[\\u4E00-\\u9FFF]"), "zh")
        .when(text.rlike("[\\u0400-\\u04FF]"), "ru").when(text.rlike("[\\u0590-\\u05FF]"), "he").when(text.rlike("[\\u0600-\\u06FF]"), "ar").otherwise("latin")
    )


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; an empty reference is matched by nothing else."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / n)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of words over the reference's words; an empty reference is matched by nothing
    else. Distinct words become characters, so that the distance is the built-in one."""

    def rate(words: Column) -> Column:
        a, b = words[0], words[1]

        def coded(known: Column) -> Column:
            # code points from 0x10000 on: no surrogates among the numbers of a million words
            char = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")
            return F.levenshtein(F.array_join(F.transform(a, char), ""), F.array_join(F.transform(b, char), ""))

        distance = F.transform(F.array(F.array_distinct(F.concat(a, b))), coded)[0]
        return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 0.0).otherwise(1.0)).otherwise(distance / F.size(a))

    split = lambda t: F.filter(F.split(t, "(?U)\\s+"), lambda w: w != "")
    return F.transform(F.array(F.array(split(reference), split(hypothesis))), rate)[0]


def accuracy(error_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - error_rate)
