"""Column functions over vectors (arrays of double) and texts, and vectors as a matrix inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays of double, summed from left to right; null if the sizes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)


def checked(v: Column, size: int) -> Column:
    """The vector, if it has so many numbers; else the query fails."""
    return F.when(F.size(v) == size, v).otherwise(F.raise_error(F.lit(f"a vector does not have {size} numbers")))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(vecs: pa.ChunkedArray) -> np.ndarray:
    """A column of lists, which have one size, as the rows of a matrix."""
    sizes = pc.list_value_length(vecs).to_numpy()
    if len(sizes) and not (sizes == sizes[0]).all():
        raise ValueError("vectors are missing or not of one size")
    return pc.list_flatten(vecs).to_numpy().astype(np.float64, copy=False).reshape(len(vecs), int(sizes[0]) if len(sizes) else 0)


def signature_difference(a: Column, b: Column) -> Column:
    """1 - cosine, at least 0; by mean distance / 255 if a vector is zero; 1 if one is missing or sizes differ."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x) / F.size(a) / 255
    cosine = F.greatest(F.lit(0.0), 1 - dot(a, b) / (norm(a) * norm(b)))
    known = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(~known | known.isNull(), 1.0).when((norm(a) == 0) | (norm(b) == 0), apart).otherwise(cosine)


#: White space as reports strip it: Unicode's, and the separators of files, groups, records and units.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def text_key(text: Column) -> Column:
    """A text without white space, in lower case: the key by which lines count as the same."""
    return F.lower(F.regexp_replace(text, WHITE, ""))


def stable_hue(text: Column) -> Column:
    """A colour angle from 0 to 359 that only depends on the text; 205 for null."""
    folded = F.aggregate(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(360)))
    return F.when(text.isNull(), 205).otherwise(folded)


def parsed_json(text: Column, schema: str) -> Column:
    """JSON, also where it stands in a fenced block."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    plain = F.get_json_object(text, "$").isNotNull()
    return F.from_json(F.when(plain, text).otherwise(F.nullif(fenced, F.lit(""))), schema)


def data_uri(mime: str, content: Column) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def from_data_uri(uri: Column) -> Column:
    """The bytes of a data URI or of plain base 64."""
    return F.unbase64(F.element_at(F.split(uri, ","), -1))


def colour_class(r: Column, g: Column, b: Column) -> Column:
    """One of eleven colour names from red, green and blue (0 to 255), by hue, saturation and value."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    hue = F.when(span == 0, 0.0).when(hi == r, F.pmod(60.0 * (g - b) / span, F.lit(360.0))).when(hi == g, 60.0 * (b - r) / span + 120).otherwise(60.0 * (r - g) / span + 240)
    sat, val = F.when(hi == 0, 0.0).otherwise(span / hi), hi / 255
    warm = (hue < 45) | (hue >= 345)
    return (
        F.when(val < 0.2, "black").when((sat < 0.15) & (val > 0.8), "white").when(sat < 0.15, "gray")
        .when(warm & (val < 0.5) & (sat > 0.3), "brown").when((hue < 15) | (hue >= 345), "red").when(hue < 45, "orange")
        .when(hue < 65, "yellow").when(hue < 170, "green").when(hue < 255, "blue").when(hue < 290, "purple").otherwise("pink")
    )


# Names of colours.
COLOURS = {"红": "red", "橙": "orange", "黄": "yellow", "绿": "green", "蓝": "blue", "紫": "purple", "粉": "pink", "白": "white", "灰": "gray", "黑": "black", "棕": "brown"}


def colour_matches(found: Column, wanted: Column) -> Column:
    """Whether a colour is the one asked for, in either language; false where none was found."""
    names = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    asked = F.lower(F.trim(F.coalesce(wanted, F.lit(""))))
    return F.coalesce(found == F.coalesce(F.element_at(names, asked), asked), F.lit(False))


def class_set(text: Column) -> Column:
    """The names in a comma-separated list, without white space around them; empty ones are passed over."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
