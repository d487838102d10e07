"""Column expressions: labelling rules, gaps, display formats, activations.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Severity buckets of the result cards, applied to the rounded gap:
# gap > 0.15 -> "Critical", gap > 0.08 -> "High", otherwise "Moderate".
SEVERITY_CRITICAL_ABOVE = 0.15
SEVERITY_HIGH_ABOVE = 0.08
SEVERITY_LABELS = ("Critical", "High", "Moderate")
# Default name of a side effect without an entry in the name table.
UNKNOWN_SE_PREFIX = "Unknown SE #"
# Number of results kept per screened pair.
TOP_RESULTS = 30
# Display decimals: score 2, gap 3 (with a leading "+"), API values 4.
ROUND_API = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def predicted_label(score, thr) -> Column:
    """Scoring rule: interaction (1) iff ``score < thr``, strictly.

    A missing score or threshold gives 0 (NaN < x is false in the reference).
    """
    return F.coalesce(_c(score) < _c(thr), F.lit(False)).cast("int")


def calibration_label(score, thr) -> Column:
    """Calibration rule: 0 iff ``score > thr``, else 1 (so score == thr is 1,
    and a missing or NaN score is 1)."""
    above = (_c(score) > _c(thr)) & ~F.isnan(_c(score).cast("double"))
    return (~F.coalesce(above, F.lit(False))).cast("int")


def gap(score, thr) -> Column:
    """Distance of the score from the threshold, ``|score - thr|``."""
    return F.abs(_c(score) - _c(thr))


def mean_of_orientations(a, b) -> Column:
    return (_c(a) + _c(b)) / 2


def capitalize(x) -> Column:
    """First character upper, the rest lower ("PGE2" -> "Pge2"); not per word."""
    s = _c(x)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def json_text(x) -> Column:
    """A string as JSON text: quoted and escaped."""
    s = F.to_json(F.array(_c(x)))
    return F.substr(s, F.lit(2), F.length(s) - 2)


def round_places(x, places: int = ROUND_API) -> Column:
    """Round to ``places`` decimals with IEEE operations only
    (``floor(x * 10^p + 0.5) / 10^p``): equal to Python's ``round`` except on
    exact decimal ties, and bit-equal across engines."""
    v = _c(x)
    k = float(10 ** places)
    return F.when(F.abs(v) < 1e15, F.floor(v * k + 0.5) / k).otherwise(v)


def severity(rounded_gap) -> Column:
    g = _c(rounded_gap)
    return (F.when(g > SEVERITY_CRITICAL_ABOVE, F.lit(SEVERITY_LABELS[0]))
            .when(g > SEVERITY_HIGH_ABOVE, F.lit(SEVERITY_LABELS[1]))
            .otherwise(F.lit(SEVERITY_LABELS[2])))


def se_display_name(name, se) -> Column:
    """Name of a side effect, or ``Unknown SE #<id>``, then capitalised."""
    return capitalize(F.coalesce(_c(name), F.concat(F.lit(UNKNOWN_SE_PREFIX), _c(se).cast("string"))))


def score_text(score) -> Column:
    """Two decimals. The value is rounded first (``round_places``) so the text
    does not depend on how an engine rounds half-way decimal expansions."""
    return F.format_string("%.2f", round_places(score, 2))


def gap_text(g) -> Column:
    return F.format_string("+%.3f", round_places(g, 3))


def drug_menu_text(name, drug_id) -> Column:
    return F.format_string("%s (CID: %d)", _c(name), _c(drug_id))


def summary_sentence(total) -> Column:
    t = _c(total)
    return (F.when(t == 0, F.lit("No significant side effect interactions predicted"))
            .otherwise(F.format_string("Found %d potential adverse reactions", t)))


def request_id_cast(x) -> Column:
    """JSON ids are cast with ``int()``; here a failed cast is NULL (-> reject)."""
    return F.expr(f"try_cast({x} as bigint)") if isinstance(x, str) else x.try_cast("bigint")


# ------------------------------------------------------------------ activations
def elu(x) -> Column:
    v = _c(x)
    return F.when(v > 0, v).otherwise(F.exp(v) - 1)


def relu(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def tanh10(x) -> Column:
    return 10 * F.tanh(_c(x))


def clip(x, lo: float = -2.0, hi: float = 2.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def safe_ratio(num, den) -> Column:
    """``num / den`` with NULL instead of a division-by-zero error (NumPy: NaN)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
