"""Column functions on ids, barcodes, names and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_cell_id(c: Column) -> Column:
    """One text form of an id: '12.0' is '12', blank and NaN are null, other text is trimmed."""
    t = F.trim(c.cast("string"))
    whole = F.regexp_extract(t, r"^([+-]?[0-9]+)\.0+$", 1)
    return F.when(t.isNull() | (t == "") | F.lower(t).isin("nan", "none", "null"), F.lit(None)).when(whole != "", whole).otherwise(t)


def format_barcode(row: Column, col: Column) -> Column:
    return F.format_string("s_002um_%05d_%05d-1", row, col)


def parse_barcode(barcode: Column) -> tuple[Column, Column]:
    """(row, col) of a square barcode, null when it is none."""
    parts = [F.regexp_extract(barcode, r"^s_002um_([0-9]+)_([0-9]+)-1$", i) for i in (1, 2)]
    return tuple(F.when(p != "", p.cast("int")) for p in parts)


def grid_of(barcode: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Barcode coordinates, else round(y / 2), round(x / 2) to even."""
    row, col = parse_barcode(barcode)
    return F.coalesce(row, F.rint(y / 2).cast("int")), F.coalesce(col, F.rint(x / 2).cast("int"))


def notebook_bin(name: Column) -> tuple[Column, Column]:
    """(x, y) = (2 c - 1, 2 r - 1) of a name with _RRRRR_CCCCC."""
    r, c = (F.regexp_extract(name, r"_([0-9]{5})_([0-9]{5})", i) for i in (1, 2))
    return F.when(c != "", c.cast("int") * 2 - 1), F.when(r != "", r.cast("int") * 2 - 1)


def slugify(c: Column, default: str = "item") -> Column:
    s = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"))
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def hash_rank_key(seed: int | str, key: Column) -> Column:
    """sha256('seed:key') as hex: a seeded, engine-independent order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_uniform(seed: int | str, *key: Column) -> Column:
    """A uniform draw in [0, 1) from the first 13 hexadecimal digits of the seeded hash."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def method_token(name: Column, tokens: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first token that the name contains; the order of tokens decides."""
    out = F.lit(default)
    for token, label in reversed(tokens):
        out = F.when(F.contains(F.lower(name), F.lit(token)), F.lit(label)).otherwise(out)
    return out


def variant_name(prefix: str, **parts: Column) -> Column:
    """prefix_key1.5_...: parameters as tokens."""
    return F.concat_ws("_", F.lit(prefix), *[F.concat(F.lit(k), v.cast("string")) for k, v in parts.items()])


def parse_list(c: Column) -> Column:
    """Comma list to trimmed, non-empty items."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_remap(c: Column) -> Column:
    """'a=b,c=d' to a map; a key with two values raises."""
    pairs = F.array_distinct(F.transform(parse_list(c), lambda p: F.struct(F.trim(F.split(p, "=", 2)[0]).alias("key"), F.trim(F.get(F.split(p, "=", 2), 1)).alias("value"))))
    conflict = F.size(pairs) != F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"])))
    checked = F.when(conflict, F.raise_error(F.lit("a key is mapped to two values")).cast("array<struct<key:string,value:string>>")).otherwise(pairs)
    return F.map_from_entries(checked)


def cell_list(c: Column) -> Column:
    """JSON array text to an array of strings."""
    return F.from_json(c, "array<string>")


def to_cell_list(c: Column) -> Column:
    return F.to_json(c)


def json_number(c: Column) -> Column:
    """Number for JSON: NaN and infinities are null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def decode_bytes(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def natural_key(c: Column) -> Column:
    """Sort key: digit ids first in numeric order, then text."""
    digits = c.rlike("^[0-9]+$")
    return F.struct((~digits).alias("text_last"), F.when(digits, c.cast("decimal(38,0)")).alias("number"), c.alias("id"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)


def safe_path(path: Column) -> Column:
    """True for a relative path without parent steps."""
    return ~(path.startswith("/") | F.coalesce(F.array_contains(F.split(path, "/"), ".."), F.lit(False)) | path.rlike(r"^[A-Za-z]:") | F.contains(path, F.lit("\\")))


def markdown_row(*cells: Column) -> Column:
    """| a | b |, numbers with four decimals, pipes escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
