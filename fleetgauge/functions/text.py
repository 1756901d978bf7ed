"""Number-to-text expressions.

``format_string`` and ``bround`` round the printed decimal, so 0.15 becomes "0.2" although the stored
double lies below 0.15. Reports need the exact binary value rounded, ties to even.
"""

from __future__ import annotations

# The unit ladder of byte sizes, 1024 apart.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def literal(text: str) -> str:
    """SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def array_of(items) -> str:
    return f"array({', '.join(items)})"


def round_to(x: str, digits: int) -> str:
    """Correctly rounded double, ties to even on the exact value; ``digits`` is 0 to 2.

    Scaling by 10^digits is itself rounded. That matters only where the product lands on a tie, and there
    the sign of its error decides. The error comes out exactly, because every partial difference is exact.
    """
    x = f"double({x})"
    if digits == 0:
        return f"rint({x})"
    scale = f"{10**digits}.0D"
    product = f"({x} * {scale})"
    if digits == 1:
        error = f"(({x} * 8.0D - {product}) + {x} * 2.0D)"
    else:
        error = f"((({x} * 64.0D - {product}) + {x} * 32.0D) + {x} * 4.0D)"
    tie = f"{product} - floor({product}) = 0.5D"
    return (
        f"(CASE WHEN {tie} AND {error} < 0 THEN floor({product}) WHEN {tie} AND {error} > 0"
        f" THEN ceil({product}) ELSE rint({product}) END / {scale})"
    )


def fixed(x: str, digits: int) -> str:
    """Text of ``x`` with 0 to 2 decimals, rounded like :func:`round_to`; null stays null."""
    return _printed(f"%.{digits}f", x, digits)


def grouped(x: str, digits: int) -> str:
    """:func:`fixed` with a comma between groups of three digits."""
    return _printed(f"%,.{digits}f", x, digits)


def _printed(pattern: str, x: str, digits: int) -> str:
    return f"if(({x}) IS NULL, NULL, format_string('{pattern}', {round_to(x, digits)}))"


def shortest(x: str) -> str:
    """Shortest decimal text that reads back as the same double, never in exponent form."""
    decimals = f"regexp_replace(string(cast(string({x}) AS decimal(38,18))), '0+$', '')"
    plain = f"if(abs({x}) BETWEEN 1e-3D AND 1e6D, string({x}), {decimals})"
    return f"if({x} = floor({x}), concat(string(bigint({x})), '.0'), {plain})"


def format_bytes(n: str) -> str:
    """Byte count in the largest unit below 1024, one decimal."""
    last = len(BYTE_UNITS) - 1
    steps = " ".join(f"WHEN abs({n}) < {1024 ** (i + 1)}.0D THEN {i}" for i in range(last))
    step = f"CASE {steps} ELSE {last} END"
    # powers of 1024 divide exactly, so one division equals the repeated one
    divisors = array_of(f"{1024**i}.0D" for i in range(last + 1))
    units = array_of(literal(u) for u in BYTE_UNITS)
    return f"concat({fixed(f'{n} / get({divisors}, {step})', 1)}, ' ', get({units}, {step}))"


def quoted_list(names: str) -> str:
    """Array of strings as ``['a', 'b']``; a name holding an apostrophe is put in double quotes."""
    escaped = r"replace(replace(replace(s, '\\', '\\\\'), '\n', '\\n'), '\t', '\\t')"
    single = rf"concat('\'', replace({escaped}, '\'', '\\\''), '\'')"
    double = f"concat('\"', {escaped}, '\"')"
    quote = rf"if(contains(s, '\'') AND NOT contains(s, '\"'), {double}, {single})"
    return f"concat('[', array_join(transform({names}, s -> {quote}), ', '), ']')"
