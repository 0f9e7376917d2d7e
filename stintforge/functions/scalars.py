"""Column functions of the domain; all stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(clock: Column) -> Column:
    """``PT06M17.00S`` to seconds; null where the text has another form."""
    form = r"^PT(\d+)M(\d+(?:\.\d+)?)S$"
    part = lambda i: F.nullif(F.regexp_extract(clock, form, i), F.lit("")).cast("double")
    return part(1) * 60 + part(2)


def regulation_left(period: Column, clock: Column) -> Column:
    return F.when(period <= 4, (4 - period) * 720 + clock).otherwise(0.0)


def garbage_time(period: Column, margin: Column, clock: Column) -> Column:
    """Fourth period, and 20 ahead, or 15 ahead in its last six minutes."""
    return (period == 4) & ((F.abs(margin) >= 20) | ((F.abs(margin) >= 15) & (clock < 360)))


def minutes(text: Column) -> Column:
    """``24:06`` to 24.1; blank to 0."""
    parts = F.split(text, ":")
    whole = F.coalesce(F.try_to_number(F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit("")), F.lit("999999")).cast("double"), F.lit(0.0))
    rest = F.coalesce(F.try_to_number(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), F.lit("99")).cast("double"), F.lit(0.0))
    return whole + rest / 60


def season_label(year: Column) -> Column:
    """2014 to ``2013-14``."""
    return F.concat((year - 1).cast("string"), F.lit("-"), F.lpad((year % 100).cast("string"), 2, "0"))


def season_of_game(game_id: Column) -> Column:
    """Season from the hundred-thousands of a game id (digits 4 and 5 of ten); 90 and later belong to the 1900s."""
    two = (F.call_function("div", game_id.cast("long"), F.lit(100000)) % 100).cast("int")
    return F.when(two >= 90, 1900 + two).otherwise(2000 + two) + 1


def _accents() -> tuple[str, str, str]:
    """Letters that decompose to a plain one, these plain letters, and the marks that combine."""
    found = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    plain = {c: "".join(x for x in d if not unicodedata.combining(x)).lower() for c, d in found.items()}
    kept = {c: x for c, x in plain.items() if x.isascii() and len(x) == 1 and x.isalpha()} | LIKE
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(kept), "".join(kept.values()), marks


#: Letters with a stroke, which do not decompose, and the plain letters they are taken for.
LIKE = {"đ": "d", "Đ": "d", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "ħ": "h", "ı": "i"}
ACCENTED, PLAIN, MARKS = _accents()


def unaccented(text: Column) -> Column:
    """Lower case, with every Latin letter that decomposes as its plain letter; marks that combine go."""
    return F.lower(F.translate(text, ACCENTED + MARKS, PLAIN))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(unaccented(text), "[^a-z]", "")


def name_key(text: Column) -> Column:
    """Lower case without accents, punctuation, generation suffix or doubled blanks."""
    plain = F.regexp_replace(unaccented(text), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat(plain, F.lit(" ")), " (jr|sr|ii|iii|iv) +$", " "), " +", " "))


def shrink(n: Column, rate: Column, k: Column | float, target: Column) -> Column:
    """(n rate + k target) / (n + k), the target where nothing was seen."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.when(n + k > 0, (n * F.coalesce(rate, F.lit(0.0)) + k * target) / (n + k)).otherwise(target)


def half_life(distance: Column, life: float, start: float = 0.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.abs(distance) - start, F.lit(0.0)) / life)


def ramp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def logit(p: Column, edge: float = 1e-6) -> Column:
    own = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(own / (1 - own))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear between knots, flat outside."""
    out = F.lit(knots[-1][1])
    for (a, fa), (b, fb) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(x < b, F.lit(fa) + (x - a) * ((fb - fa) / (b - a))).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(knots[0][1])).otherwise(out)


def step_value(x: Column, steps: list[tuple[int, float]]) -> Column:
    """The value of the last step at or before x."""
    out = F.lit(None).cast("double")
    for first, value in steps:
        out = F.when(x >= first, F.lit(value)).otherwise(out)
    return out


def bin_index(x: Column, edges: list[float]) -> Column:
    """Number of inner edges below x, so bins are closed on the right; null stays null."""
    return F.when(x.isNotNull(), sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0)))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, by the rational approximation of the error function with error under 1.5e-7."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, summed in order."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def concentration(values: Column) -> Column:
    """Sum of squared shares."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / (total * total))
