"""Text, key, date and hash expressions. All are built-in Spark functions, so they stay in generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space with U+001C to U+001F, and the line breaks among it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Fixed values that stand for a missing text.
MISSING = ("", "-", "n/a", "na", "none", "not applicable", "unknown")
#: Fixed values of Chinese numerals.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_lines(text: Column) -> Column:
    """Stripped lines that are not blank, one to a line."""
    return F.array_join(F.filter(F.transform(F.split(text, BREAK), strip), lambda x: x != ""), "\n")


def optional_text(text: Column) -> Column:
    """Collapsed, and null where the text says that there is none."""
    plain = collapse(text)
    return F.when(~F.lower(plain).isin(*MISSING), plain)


def non_blank(text: Column) -> Column:
    """Stripped, and null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def excerpt(text: Column, limit: int = 1000) -> Column:
    """Collapsed; a longer text is cut and ends with an ellipsis."""
    plain = collapse(text)
    return F.when(F.length(plain) > limit, F.concat(F.rtrim(F.substring(plain, 1, limit)), F.lit("…"))).otherwise(plain)


def bounded(text: Column, limit: int, marker: str = "\n[…]\n") -> Column:
    """At most `limit` characters: two thirds of what the marker leaves from the head, the rest from the tail (P5)."""
    room = max(limit - len(marker), 0)
    head = room * 2 // 3
    cut = F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(room - head)))
    return F.when(F.length(text) <= limit, text).otherwise(cut if room else F.substring(text, 1, limit))


def limited(text: Column, limit: int) -> Column:
    """The first characters; 0 is no limit."""
    return F.substring(text, 1, limit) if limit else text


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def folded(text: Column) -> Column:
    """Compatibility forms made plain and case folded, which Spark has no expression for; for keys that are made once, when an index is built."""
    return _folded(text)


def match_key(text: Column) -> Column:
    """Lower-cased letters and digits (P7); give it folded text where compatibility forms matter."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def strict_key(text: Column) -> Column:
    """Lower-cased without white space."""
    return F.regexp_replace(F.lower(text), f"{SPACE}+", "")


def lines(*parts: Column, separator: str = "\n") -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def iso_date(text: Column) -> Column:
    """A date of any of four written forms as ISO text, else null."""
    plain = strip(text)
    return F.coalesce(*(F.date_format(F.try_to_date(plain, p), "yyyy-MM-dd") for p in ("d.M.yyyy", "d-M-yyyy", "yyyy-M-d", "d/M/yyyy")))


def utc_now() -> Column:
    """The time of the query as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the parts joined by a double colon (P20)."""
    return F.substring(F.sha1(F.concat_ws("::", *parts)), 1, 16)


def relation_id(prefix: str, *parts: Column) -> Column:
    """A prefix and 20 hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 20))


def ordered_distinct(values: Column) -> Column:
    """Stripped texts of an array, without blanks and repeats, in order of first sight."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "")))


def merged_distinct(old: Column, new: Column, limit: int) -> Column:
    """Old values, then new ones, each once, at most `limit`."""
    return F.slice(F.array_distinct(F.concat(old, new)), 1, limit)


def token_estimate(text: Column, safety_percent: int = 120) -> Column:
    """Estimated tokens (T1): 0.1 a white-space character, 0.25 a word character, 0.5 another ASCII one, 1 any other; times the safety factor, rounded up.

    In whole twentieths, as a floating sum depends on its order.
    """
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))
    space, word = count(SPACE), count("[A-Za-z0-9_]")
    other = F.length(F.regexp_replace(text, rf"[\x00-\x7f{SPACE[1:-1]}]+", ""))
    ascii_rest = F.length(text) - space - word - other
    twentieths = 2 * space + 5 * word + 10 * ascii_rest + 20 * other
    return F.ceil((twentieths * safety_percent).cast("double") / 2000).cast("int")


def chinese_number(text: Column) -> Column:
    """A Chinese or Arabic numeral as an int (P25); null if it holds anything else."""
    digit = F.create_map(*(F.lit(x) for kv in DIGITS.items() for x in kv))
    unit = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"))

    def step(state: Column, c: Column) -> Column:
        u = F.try_element_at(unit, c)
        return F.struct(
            F.when(u.isNotNull(), state["total"] + F.greatest(state["now"], F.lit(1)) * u).otherwise(state["total"]).alias("total"),
            F.when(u.isNotNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at(digit, c), F.lit(0))).alias("now"),
        )

    letters = "".join([*DIGITS, *UNITS])
    read = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda s: s["total"] + s["now"])
    return F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int")).when(text.rlike(f"^[{letters}]+$"), read)


def keyword_match(text: Column, keyword: str) -> Column:
    """Whether a lower-cased text holds a keyword: a phrase anywhere, a single word between word edges."""
    if " " in keyword or "-" in keyword:
        return text.contains(keyword)
    return text.rlike(rf"(?U)\b{_quoted(keyword)}\b")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def keyword_rules(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The rules of which a keyword occurs, with the keywords found, in the order given.

    One pattern finds all keywords of one word: it looks on only where a word begins with a letter that a keyword begins
    with. Phrases and others are looked for each.
    """
    single = sorted({k for ks in rules.values() for k in ks if k.replace("_", "a").isalnum() and k == k.lower()})
    pattern = rf"(?U)(?=[{''.join(sorted({_quoted(k[0]) for k in single}))}])(?<!\w)(?:{'|'.join(map(_quoted, single))})(?!\w)"

    def read(low: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), 0)) if single else F.array().cast("array<string>")
        return F.struct(low.alias("low"), words.alias("words"))

    def found(own: Column) -> Column:
        has = lambda k: F.array_contains(own["words"], k) if k in single else keyword_match(own["low"], k)
        each = [F.struct(F.lit(name).alias("label"), F.array_compact(F.array(*(F.when(has(k), F.lit(k)) for k in keywords))).alias("terms"), F.lit("heuristic").alias("confidence")) for name, keywords in rules.items()]
        return F.filter(F.array(*each), lambda x: F.size(x["terms"]) > 0)

    # the text is made once: an expression outside of a lambda would be made again for each use within it
    return F.element_at(F.transform(F.transform(F.array(F.lower(text)), read), found), 1)


def looked_up(label: Column, table: Mapping[str, str]) -> Column:
    """The value of a lower-cased label; a bare two-letter code stands for itself."""
    plain = F.lower(collapse(label))
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(known, plain), F.when(F.trim(label).rlike("^[A-Za-z]{2}$"), F.upper(F.trim(label))))


def blocked_page(url: Column, content: Column, markers: Sequence[str]) -> Column:
    """Whether an access gate answered: a marker in the URL or the first 20,000 characters (H9)."""
    low = F.lower(F.concat_ws("\n", url, F.substring(content, 1, 20_000)))
    out = F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return out


def html_plain(html: Column) -> Column:
    """Text of a page by patterns alone: no scripts or styles, a line for each tag, common references decoded (H1)."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "\n")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return normalize_lines(out)


def title_of(html: Column) -> Column:
    """The page's title element, collapsed; null if there is none."""
    return F.nullif(collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
