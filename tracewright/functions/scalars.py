"""Scalar functions as column expressions. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CVSS 3.1 base-metric weights.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "PR_U": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_C": {"N": 0.85, "L": 0.68, "H": 0.5},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def slug(text: Column) -> Column:
    """Lower case, each run of other than letters and digits one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def compact(text: Column, limit: int = 500) -> Column:
    """Runs of blanks as one, trimmed, at most limit characters."""
    return F.substring(F.regexp_replace(F.trim(text), "\\s+", " "), 1, limit)


def positive_int(text: Column) -> Column:
    """The integer a text holds, 0 if it holds none or is not above 0."""
    return F.greatest(F.coalesce(text.cast("string").try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def digest(prefix: str, *parts: Column, length: int = 20) -> Column:
    """Content identity: prefix and leading hex digits of SHA-256 over the NUL-joined parts; a null part is a SUB character,
    so it differs from the empty text."""
    joined = F.concat_ws(chr(0), *[F.coalesce(p.cast("string"), F.lit(chr(26))) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def fingerprint(unique: Column, *parts: Column) -> Column:
    """Digest of the lower-cased parts; where one is missing, of the row's own unique key instead."""
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, digest("", *[F.lower(p.cast("string")) for p in parts], length=64)).otherwise(digest("unique_", unique, length=57))


def deterministic_index(text: Column, n: int) -> Column:
    """The first eight digest bytes as an unsigned number, modulo n."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("long")


def reduction_percent(after: Column, before: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise(F.round((1 - after / before) * 100, 2))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson score interval, rounded to six places; null without trials."""
    p, n = hits / n.cast("double"), n.cast("double")
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda x: F.when(n > 0, F.round(x / (1 + z * z / n), 6))
    return bound(centre - spread), bound(centre + spread)


def cvss_base(vector: Column) -> Column:
    """CVSS 3.1 base score of a vector like AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H; null where a metric is missing."""
    part = lambda k: F.try_element_at(F.str_to_map(vector, F.lit("/"), F.lit(":")), F.lit(k))

    def weight(table: str, key: str) -> Column:
        out = F.lit(None).cast("double")
        for letter, value in CVSS[table].items():
            out = F.when(part(key) == letter, F.lit(value)).otherwise(out)
        return out

    changed = part("S") == "C"
    iss = 1 - (1 - weight("CIA", "C")) * (1 - weight("CIA", "I")) * (1 - weight("CIA", "A"))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15)).otherwise(6.42 * iss)
    access = F.when(changed, weight("PR_C", "PR")).otherwise(weight("PR_U", "PR"))
    ease = 8.22 * weight("AV", "AV") * weight("AC", "AC") * access * weight("UI", "UI")
    total = F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease)
    raw = F.when(total > 10, F.lit(10.0)).otherwise(total)  # least() would skip a null
    # Round up to one place on a fixed grid, so that 4.02 in binary isn't taken for more than 4.02.
    up = F.ceil(F.round(raw * 100000) / 10000) / 10
    return F.when(impact <= 0, F.lit(0.0)).otherwise(up)


def severity(score: Column) -> Column:
    return F.when(score == 0, "none").when(score < 4, "low").when(score < 7, "medium").when(score < 9, "high").when(score.isNotNull(), "critical")


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of all rules that hold, in order, joined by commas."""
    return F.concat_ws(",", *[F.when(condition, F.lit(name)) for name, condition in rules])


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])
