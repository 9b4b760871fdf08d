"""Text expressions: pure functions from Columns to Columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters and their Latin spelling; a capital letter takes a capital first letter.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
LATIN = LETTERS | {c.upper(): spelled.capitalize() for c, spelled in LETTERS.items()}
#: Letters spelled with several or none, and those spelled with one (as two strings of like length).
DIGRAPHS = tuple((c, spelled) for c, spelled in LATIN.items() if len(spelled) != 1)
SINGLE = ("".join(c for c, spelled in LATIN.items() if len(spelled) == 1), "".join(spelled for spelled in LATIN.values() if len(spelled) == 1))


def squeeze(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends. Most texts have nothing to replace, which is told faster."""
    odd = text.rlike("[\\s\\x0B\u00a0]{2}|[\\t\\n\\x0B\\f\\r\u00a0]")
    return F.trim(F.when(odd, F.regexp_replace(text, "[\\s\\x0B\u00a0]+", " ")).otherwise(text))


def lines(text: Column) -> Column:
    """Squeezed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\f]"), squeeze), lambda x: x != "")


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*$", ""), F.lit("…")))


def compact(text: Column, most: int) -> Column:
    """As clip, without punctuation before the ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"[ .,:;]+\z", ""), F.lit("…")))


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(made == "", "item").otherwise(made)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def token_estimate(text: Column) -> Column:
    """Runs of letters and digits cost a quarter of their length, other signs one each."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + F.when(x.rlike(r"^[\p{L}\p{N}_]"), F.ceil(F.length(x) / 4)).otherwise(F.lit(1).cast("long")))


def transliterate(text: Column) -> Column:
    for cyrillic, latin in DIGRAPHS:
        text = F.replace(text, F.lit(cyrillic), F.lit(latin))
    return F.translate(text, *SINGLE)


def cells(line: Column) -> Column:
    """A line's cells: parted by two spaces, tabs or bars; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(line, r" {2,}|\t+|\|"), lambda x: F.trim(x)), lambda x: x != "")
