"""SQL text of scalar expressions shared by the operators."""

from __future__ import annotations

_ISO = r"^(\\d{4}-\\d{2}-\\d{2})[ T](\\d{2}:\\d{2}:\\d{2})(?:[.](\\d{1,9}))?(Z|[+-]\\d{2}:?\\d{2})?$"
_CLOCK = r"^([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d[.]\\d{1,9}$"


def iso_to_ns(text: str) -> str:
    """ISO date and time (UTC unless an offset is given) to epoch nanoseconds; null if unreadable.

    The fraction never passes through a timestamp, which would cut it to microseconds."""

    def part(i: int) -> str:
        return f"regexp_extract({text}, '{_ISO}', {i})"

    seconds = f"unix_seconds(try_to_timestamp(concat({part(1)}, ' ', {part(2)}), 'yyyy-MM-dd HH:mm:ss'))"
    fraction = f"cast(rpad({part(3)}, 9, '0') as bigint)"
    minutes = f"(cast(substr({part(4)}, 2, 2) as int) * 60 + cast(right({part(4)}, 2) as int))"
    offset = (
        f"if(length({part(4)}) > 1, if(left({part(4)}, 1) = '-', -1, 1) * {minutes}, 0) * 60"
    )
    return f"({seconds} - {offset}) * 1000000000L + {fraction}"


def clock_hour(text: str) -> str:
    """Hour of an ``HH:MM:SS.fraction`` time of day; null for any other text."""
    return f"if(regexp_like({text}, '{_CLOCK}'), cast(left({text}, 2) as int), null)"


def local_time(ts: str, zone: str = "America/New_York") -> str:
    """Epoch nanoseconds to wall-clock timestamp of ``zone`` (microseconds)."""
    return f"from_utc_timestamp(timestamp_micros({ts} div 1000), '{zone}')"


def utc_date(ts: str) -> str:
    """UTC date of epoch nanoseconds as ``yyyy-MM-dd`` text."""
    return f"date_format(timestamp_seconds(({ts} - pmod({ts}, 1000000000)) div 1000000000), 'yyyy-MM-dd')"


def wilson(rate: str, n: str, sign: str, z: float = 1.96) -> str:
    """Lower (sign ``-``) or upper (``+``) end of the Wilson score interval."""
    zz = z * z
    centre = f"({rate} + {zz} / (2 * {n})) / (1 + {zz} / {n})"
    half = f"{z} * sqrt({rate} * (1 - {rate}) / {n} + {zz} / (4.0 * {n} * {n})) / (1 + {zz} / {n})"
    end = f"greatest(0, {centre} {sign} {half})"
    return end if sign == "-" else f"least(1, {end})"


def _horner(x: str, coefficients: list[str]) -> str:
    text = coefficients[0]
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c})"
    return text


# Hart's rational approximation of the normal distribution function.
_HART_P = [
    "3.52624965998911e-2", "0.700383064443688e0", "6.37396220353165e0", "33.912866078383e0",
    "112.079291497871e0", "221.213596169931e0", "220.206867912376e0",
]
_HART_Q = [
    "8.83883476483184e-2", "1.75566716318264e0", "16.064177579207e0", "86.7807322029461e0",
    "296.564248779674e0", "637.333633378831e0", "793.826512519948e0", "440.413735824752e0",
]

# Acklam's rational approximation of the normal quantile function.
_ACKLAM_A = [
    "-3.969683028665376e1", "2.209460984245205e2", "-2.759285104469687e2",
    "1.383577518672690e2", "-3.066479806614716e1", "2.506628277459239e0",
]
_ACKLAM_B = [
    "-5.447609879822406e1", "1.615858368580409e2", "-1.556989798598866e2",
    "6.680131188771972e1", "-1.328068155288572e1", "1e0",
]
_ACKLAM_C = [
    "-7.784894002430293e-3", "-3.223964580411365e-1", "-2.400758277161838e0",
    "-2.549732539343734e0", "4.374664141464968e0", "2.938163982698783e0",
]
_ACKLAM_D = ["7.784695709041462e-3", "3.224671290700398e-1", "2.445134137142996e0", "3.754408661907416e0", "1e0"]


def normal_cdf(z: str) -> str:
    """Standard normal distribution function, double precision up to |z| = 7."""
    a = f"abs({z})"
    near = f"exp(-{a} * {a} / 2) * {_horner(a, _HART_P)} / {_horner(a, _HART_Q)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65e0))))) / 2.506628274631e0"
    tail = f"(case when {a} > 37 then 0e0 when {a} < 7.07106781186547e0 then {near} else {far} end)"
    return f"(case when {z} > 0 then 1 - {tail} else {tail} end)"


def normal_quantile(p: str) -> str:
    """Standard normal quantile, relative error below 1.2e-9."""
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    middle = f"{_horner(r, _ACKLAM_A)} * {q} / {_horner(r, _ACKLAM_B)}"

    def tail(x: str) -> str:
        return f"{_horner(x, _ACKLAM_C)} / {_horner(x, _ACKLAM_D)}"

    return (
        f"(case when {p} < 0.02425e0 then {tail(low)} when {p} > 0.97575e0 then -({tail(high)}) else {middle} end)"
    )


def kolmogorov_tail(t: str, terms: int = 20) -> str:
    """Asymptotic p-value of the Kolmogorov statistic ``t = sqrt(n) * D``."""
    series = " ".join(f"{'+' if k % 2 else '-'} exp(-{2 * k * k}e0 * {t} * {t})" for k in range(1, terms + 1))
    return f"(case when {t} < 0.2e0 then 1e0 else least(1e0, greatest(0e0, 2e0 * (0e0 {series}))) end)"
