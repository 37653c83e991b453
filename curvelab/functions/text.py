"""Text functions: recognised numbers, axis labels and units, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvelab.functions.arrays import let

# fixed values: what recognition confuses with digits, and what it stands for
CONFUSED, MEANT = "OolI|SsBZzGg,", "001115582269."

# fixed values: units in the order in which they are looked for
UNITS = [r"\(([^)]+)\)", r"\[([^\]]+)\]", r"(kN/m²|kN/m2)", r"(MPa)", r"(%)", r"(mm)"]


def repaired(text: Column) -> Column:
    """A recognised token with confused characters replaced."""
    return F.translate(F.trim(text), CONFUSED, MEANT)


def clean_number(text: Column) -> Column:
    """The repaired token without anything but digits, dots and minus signs; dots after the first go; of several minus signs only a leading one stays."""
    def one_dot(kept: Column) -> Column:
        at = F.instr(kept, ".")
        return F.when(at > 0, F.concat(F.substring(kept, F.lit(1), at), F.replace(F.substring(kept, at + 1, F.char_length(kept)), F.lit("."), F.lit("")))).otherwise(kept)

    def signed(d: Column) -> Column:
        plain = lambda p: F.when(F.char_length(d) - F.char_length(p) < 2, d).when(F.startswith(d, F.lit("-")), F.concat(F.lit("-"), p)).otherwise(p)
        return let(F.replace(d, F.lit("-"), F.lit("")), plain)

    return let(F.regexp_replace(repaired(text), "[^0-9.\\-]", ""), lambda kept: let(one_dot(kept), signed))


def parse_number(text: Column) -> Column:
    """The cleaned token as a double; null if it is none."""
    return clean_number(text).try_cast("double")


def axis_label(text: Column) -> Column:
    """struct(label, unit): the first unit found, in the fixed order, and the text before it; without a unit the whole text is the label."""
    t = F.trim(text)
    found = F.lit(None).cast("struct<label:string,unit:string>")
    for pattern in reversed(UNITS):
        at = F.regexp_instr(t, F.lit(pattern))
        label = F.trim(F.substring(t, F.lit(1), at - 1))
        hit = F.struct(F.when(label != "", label).alias("label"), F.trim(F.regexp_extract(t, pattern, 1)).alias("unit"))
        found = F.when(at > 0, hit).otherwise(found)
    whole = F.struct(F.when(t != "", t).alias("label"), F.lit(None).cast("string").alias("unit"))
    return F.coalesce(found, whole)


def fixed(value: Column, decimals: int) -> Column:
    """A number with so many decimals, no grouping."""
    return F.format_string(f"%.{decimals}f", value)


def percent(value: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", value * 100)


def short_id(value: Column) -> Column:
    return F.substring(value, 1, 8)


def megabytes(size: Column) -> Column:
    return size / 1048576


def comma_list(text: Column) -> Column:
    """The non-empty trimmed items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda v: v != "")


def shown_method(method: Column) -> Column:
    return F.regexp_replace(method, "_", " ")


def shown_time(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, hh:mm a")


def is_plain_number(text: Column) -> Column:
    return text.rlike(r"^-?\d+\.?\d*$")
