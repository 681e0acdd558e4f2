"""Column builders shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """Luhn over the digits of ``value``, of which there must be at least 12."""
    return let(digits(value), lambda d: (F.length(d) >= 12) & F.call_function("luhn_check", d))


def iban_ok(value: Column) -> Column:
    """ISO 13616: blanks removed, upper case, 15 to 34 characters, remainder 1 modulo 97."""

    def remainder(plain: Column) -> Column:
        turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

        def step(total: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

        parts = F.filter(F.split(turned, ""), lambda c: c != "")
        shaped = plain.rlike("^[0-9A-Z]{15,34}$")
        return F.when(shaped, F.aggregate(parts, F.lit(0), step) == 1).otherwise(False)

    return let(F.upper(F.replace(value, F.lit(" "), F.lit(""))), remainder)


CHECKSUMS: dict[str, Callable[[Column], Column]] = {"luhn": luhn_ok, "iban-mod97": iban_ok}


def casefold_de(value: Column) -> Column:
    """Case folding as far as German text needs it."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def ratio(part: Column, whole: Column, places: int = 3) -> Column:
    """Half-even rounded share; null over nothing."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), places)


def duration_seconds(text: Column) -> Column:
    """``30s``, ``1m``, ``24h``, ``180d`` in seconds; null for anything else."""
    amount = F.regexp_extract(text, r"^([0-9]+)[smhd]$", 1)
    unit = F.create_map(*[F.lit(x) for pair in (("s", 1), ("m", 60), ("h", 3600), ("d", 86400)) for x in pair])
    return F.when(amount != "", amount.cast("long") * unit[F.right(text, F.lit(1))])


def fingerprint(body: Column) -> Column:
    """``SHA256:`` and unpadded base64 of the digest."""
    return F.concat(F.lit("SHA256:"), F.rtrim(F.base64(F.unhex(F.sha2(body, 256))), F.lit("=")))


def canonical_json(text: Column) -> Column:
    """Sorted keys, no blanks."""
    return F.to_json(F.parse_json(text))


TRACEPARENT = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"


def trace_id(header: Column) -> Column:
    """The trace id of a valid traceparent header (lower-cased, not all zero), else null."""
    low = F.lower(F.trim(header))
    trace, span = (F.regexp_extract(low, TRACEPARENT, i) for i in (1, 2))
    return F.when((trace != "") & (trace != "0" * 32) & (span != "0" * 16), trace)


def strict_timestamp(text: Column) -> Column:
    """A timestamp that names its zone; others are null."""
    return F.when(text.rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def failure_code(outcomes: list[tuple[Column, int, str]]) -> Column:
    """The first failing check, in order of evaluation, as ``struct<status, code>``; null if none fails."""
    result = F.lit(None).cast("struct<status:int,code:string>")
    for failed, status, code in reversed(outcomes):
        result = F.when(failed, F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))).otherwise(result)
    return result
