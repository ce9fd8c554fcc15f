"""Text functions as column expressions: each takes and returns Columns, and none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
WORDS = "[a-z0-9]+"
COMPOUND = r"\b(figure|fig|table|tab)\s*(\d+)\b"
REFERENCE = r"(?i)\b(fig(?:ure)?|tab(?:le)?)\.?\s*(\d+)\b"
CAPTION = r"(?i)^(?:#+\s*)?(?:\*\*)?(Figure|Fig\.?|Table)\s*(\d+)[a-z]?\s*[:.]\s*(?:\*\*)?\s*(\S.*)$"
MENTION = r"(?i)\b(Figure|Fig\.?|Table)\s*(\d+)\b"
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
ABSTAINS = r"(?i)not answerable|cannot be answered|does not contain|no information"
LEAD_IN = r"(?i)^(the )?(answer|final answer)( is)?[:\s]+"
ABBREVIATION = r"(?:^|[\s.])[A-Za-z]\.$"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NUMBER = r"-?\d+(?:\.\d+)?"
SPECIAL_TOKENS = r"<\|(?:im_end|endoftext)\|>"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    """Lines as Python's splitlines cuts them: an end of line at the end adds no empty line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _compounds(c: Column) -> Column:
    kinds, numbers = (F.regexp_extract_all(F.lower(c), F.lit(COMPOUND), F.lit(i)) for i in (1, 2))

    def forms(m: Column) -> Column:
        bare = F.regexp_replace(m["1"], "^0+(?=.)", "")
        figure = m["0"].startswith("fig")
        long, short = F.when(figure, "figure").otherwise("table"), F.when(figure, "fig").otherwise("tab")
        out = []
        for n in (m["1"], bare, F.when(F.length(bare) < 2, F.lpad(bare, 2, "0")).otherwise(bare)):
            out += [F.concat(long, n), F.concat(short, n)]
        return F.array(*out)

    return F.flatten(F.transform(F.arrays_zip(kinds.alias("0"), numbers.alias("1")), forms))


def tokens(c: Column) -> Column:
    """Distinct search tokens in order of first occurrence: words, then figureN / figN / tableN / tabN forms."""
    words, low = F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0)), F.lower(c)
    # few texts name a figure or a table, and a search for the letters is cheaper than two for the pattern
    named = F.contains(low, F.lit("fig")) | F.contains(low, F.lit("tab"))
    return F.array_distinct(F.when(named, F.concat(words, _compounds(c))).otherwise(words))


def references(c: Column) -> Column:
    """array<struct<kind, number>> of the figures and tables that a text refers to, each once, in order."""
    kinds, numbers = (F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(i)) for i in (1, 2))
    one = lambda m: F.struct(F.when(F.lower(m["0"]).startswith("tab"), "Table").otherwise("Figure").alias("kind"), m["1"].cast("int").alias("number"))
    return F.array_distinct(F.transform(F.arrays_zip(kinds.alias("0"), numbers.alias("1")), one))


def fixed(c: Column, digits: int = 3) -> Column:
    """A number from 0 to 10^9 with 1 to 4 decimals as C's printf writes it: Java rounds the shortest decimal that stands for a double (1.0545 up to 1.055), C the double itself, and
    exact ties to the even digit. Fractions are cut in two at 26 bits, so that each part times 10^digits is exact, as is each comparison."""
    unit, ten = F.lit(float(1 << 26)), F.lit(10**digits)
    whole = F.floor(c)
    bits = (c - whole) * unit
    high = F.floor(bits)
    low = (bits - high) * ten
    kept = F.shiftright(high * ten, 26)
    half = F.lit(1 << 25) - (high * ten - F.shiftleft(kept, 26))
    up = (low > half) | ((low == half) & (kept % 2 == 1))
    n = kept + F.when(up, 1).otherwise(0)
    parts = (whole + F.floor(n / ten)).cast("string"), F.lpad((n % ten).cast("string"), digits, "0")
    return F.concat_ws(".", *parts)


def norm_caption(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), " +", " "))  # only spaces are left to squeeze


def norm_quote(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9%$., ]+", " "), " +", " "))


def caption(line: Column) -> Column:
    """struct<kind, text> of a caption line, or null: the canonical text is cut at 200 characters."""
    s = strip(line)
    part = lambda i: F.regexp_extract(s, CAPTION, i)
    kind = F.when(F.lower(part(1)).startswith("tab"), "Table").otherwise("Figure")
    rest = strip(F.regexp_replace(strip(part(3)), r"\*+$", ""))
    text = F.substring(F.concat(kind, F.lit(" "), part(2).cast("int").cast("string"), F.lit(": "), rest), 1, 200)
    return F.when(s.rlike(CAPTION), F.struct(kind.alias("kind"), text.alias("text")))


def mention_numbers(line: Column, table: bool) -> Column:
    kinds, numbers = (F.regexp_extract_all(line, F.lit(MENTION), F.lit(i)) for i in (1, 2))
    own = F.filter(F.arrays_zip(kinds.alias("0"), numbers.alias("1")), lambda m: F.lower(m["0"]).startswith("tab") == F.lit(table))
    return F.transform(own, lambda m: m["1"].cast("int"))


def verified(hint: Column, page: Column, least: int = 12) -> Column:
    """Whether a proposed caption stands on the page: its normalised start of up to 60 characters is looked for."""
    return stands(hint, norm_caption(page), least)


def stands(hint: Column, text: Column, least: int = 12) -> Column:
    """``verified`` on a page's normalised text."""
    h = norm_caption(hint)
    probe = F.substring(h, F.lit(1), F.greatest(F.lit(least), F.least(F.length(h), F.lit(60))))
    return (F.length(h) >= least) & F.contains(text, probe)


def normalize_answer(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, ""), r"(?U)\b(a|an|the)\b", " "))


def remove_quotes(c: Column) -> Column:
    """Without a pair of equal quotes around the text."""
    return F.regexp_replace(strip(c), "(?s)^(['\"])(.*)\\1$", "$2")


def clean_str(c: Column) -> Column:
    s = strip(F.lower(remove_quotes(c)))
    s = F.regexp_replace(s, r"\s*\(.*?\)\s*$", "")
    return strip(F.regexp_replace(s, "[$%]", ""))


def to_float(c: Column) -> Column:
    """The first number of a text, or null; million and billion are dropped, not multiplied."""
    s = strip(F.regexp_replace(F.regexp_replace(strip(c), "[$%,()]", ""), "million|billion", ""))
    return F.nullif(F.regexp_extract(s, NUMBER, 0), F.lit("")).cast("double")


def extract_answer(c: Column) -> Column:
    p = strip(c)
    body = strip(F.regexp_replace(p, LEAD_IN, ""))
    cut = F.when(body.rlike(ABBREVIATION), body).otherwise(F.regexp_replace(body, r"\.+$", ""))
    return F.when(p.rlike(ABSTAINS), "Not answerable").otherwise(cut)


def clean_reply(content: Column, thinking: Column, finish: Column) -> Column:
    """struct<answer, truncated>: what follows the reasoning, or nothing if the reply ended within it."""
    s = F.regexp_replace(content, SPECIAL_TOKENS, "")
    answer = (
        F.when(~thinking, strip(s)).when(finish == "length", "").when(F.contains(s, F.lit("</think>")), strip(F.substring_index(s, "</think>", -1)))
        .when(F.contains(s, F.lit("\n\n\n")), strip(F.substring_index(s, "\n\n\n", -1))).otherwise("")
    )
    truncated = thinking & ((finish == "length") | ~(F.contains(s, F.lit("</think>")) | F.contains(s, F.lit("\n\n\n"))))
    return F.struct(answer.alias("answer"), truncated.alias("truncated"))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, group)))


def parse_extraction(c: Column) -> Column:
    return F.struct(_found(c, r"Extracted answer:\s*(.+)").alias("answer"), _found(c, r"Answer format:\s*\[?([A-Za-z]+)").alias("format"))


def parse_verdict(c: Column) -> Column:
    verdict = F.initcap(_found(c, r"(?i)Verdict:\s*\[?\s*(Correct|Incorrect)"))
    return F.struct(_found(c, r"Extracted answer:\s*(.+)").alias("answer"), verdict.alias("verdict"), F.coalesce(_found(c, r"Reason:\s*(.+)"), F.lit("")).alias("reason"))


def truncate(c: Column, most: int, marker: str = " ...[truncated]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def headings(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.startswith("#")))


# The texts of page flags.
EMPTY_FLAG = "EMPTY_OR_NEAR_EMPTY (page content not captured as text; needs image inspection)"
OCR_FLAG = "OCR_ONLY (no native text layer; text comes from RapidOCR)"
LOSS_FLAG = "TEXT_LOSS (docling captured <40% of native text)"


def page_flag(parsed: Column, native: Column) -> Column:
    """Why a parsed page needs a look, by its characters and those of the native text; null if it does not."""
    return F.when(parsed < 40, EMPTY_FLAG).when(native == 0, OCR_FLAG).when(parsed < 0.4 * native, LOSS_FLAG)


def title_of(md: Column, page: Column) -> Column:
    first = F.element_at(F.filter(F.transform(lines(md), strip), lambda x: x != ""), 1)
    return F.coalesce(F.substring(F.regexp_replace(first, "^#+\\s*", ""), 1, 120), F.concat(F.lit("Page "), page.cast("string")))


def decode_list(c: Column) -> Column:
    """A list given as JSON text; a text that does not decode raises, as a null would hide it."""
    got = F.from_json(c, "array<string>")
    return F.when(c.isNull() | (c == "null"), F.array().cast("array<string>")).when(got.isNull(), F.raise_error(F.concat(F.lit("no JSON list: "), c))).otherwise(got)


def mask_arguments(c: Column) -> Column:
    """A command line without the values of any API key flag."""
    return F.regexp_replace(c, r"(--[a-z-]*api-key)([= ])\S+", "$1$2***")
