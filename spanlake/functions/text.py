"""String expressions of benchmark generation and scoring, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEGIN_TOKEN = "<|begin_of_text|>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flattened(x: Column | str) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(x), r"[ \t\n\r\f\x0B]+", " "), "^ | $", "")


def scored_prediction(x: Column | str) -> Column:
    """A prediction before scoring: control characters become line breaks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(x)), r"[\x00-\x1F]", "\n"), r"^\s+|\s+$", "")


def clean_prediction(x: Column | str) -> Column:
    """A model's answer: a leading ``: `` or ``:`` goes, with white space at both ends; then, of any answer, one dot at the end, with white space before it."""
    c = _col(x)
    cut = F.when(c.startswith(":"), F.regexp_replace(F.regexp_replace(c, "^: ?", ""), r"^\s+|\s+$", "")).otherwise(c)
    return F.when(cut.endswith("."), F.regexp_replace(F.substring(cut, F.lit(1), F.length(cut) - 1), r"\s+$", "")).otherwise(cut)


def one_begin(x: Column | str, token: str = BEGIN_TOKEN) -> Column:
    """If the begin token stands more than once, it once and the text after the last."""
    c = _col(x)
    many = F.size(F.split(c, F.lit("\\Q" + token + "\\E"), -1)) > 2
    return F.when(many, F.concat(F.lit(token), F.substring_index(c, token, -1))).otherwise(c)


def words(x: Column | str) -> Column:
    return F.filter(F.split(flattened(x), " "), lambda w: w != "")


def token_count(x: Column | str) -> Column:
    """Words as a stand-in for tokens."""
    return F.size(words(x)).cast("long")


def matched_share(prediction: Column | str, references: Column | str) -> Column:
    """Share of references that the prediction holds, ignoring case."""
    p, r = F.lower(_col(prediction)), _col(references)
    return F.size(F.filter(r, lambda x: F.contains(p, F.lower(x)))) / F.size(r)


def matched_any(prediction: Column | str, references: Column | str) -> Column:
    p = F.lower(_col(prediction))
    return F.exists(_col(references), lambda x: F.contains(p, F.lower(x))).cast("double")


def depths(count: int = 40) -> Column:
    """Evenly spaced whole depths from 0 to 100."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(i * 100 / (count - 1)).cast("int"))


def seeded_number(key: Column, seed: int, digits: int = 7) -> Column:
    """A number of that many digits from a seeded hash of the key; the same on every run and in SQL."""
    low = 10 ** (digits - 1)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 12), 16, 10).cast("long")
    return low + F.pmod(h, F.lit(9 * low))


def html_text(x: Column | str) -> Column:
    """Visible text of a page: scripts, styles and comments go, blocks break lines, tags go, common entities are resolved."""
    c = F.regexp_replace(_col(x), r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|title)>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def model_size(x: Column | str) -> Column:
    """Billions of parameters in a model's name, null if it names none."""
    return F.nullif(F.regexp_extract(_col(x), r"(\d+(?:\.\d+)?)[bB](?![a-zA-Z])", 1), F.lit("")).cast("double")
